"""Cohort, timeline and phenotype analytics written as Spark DataFrame jobs."""

"""Operators: each takes DataFrames and returns DataFrames; nothing here runs a job unless said so."""

"""Concept rules: from a source label and unit to a shared concept."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortline.functions import text

# Concept, pattern that must be found, pattern that must not. The first match wins.
CONCEPT_RULES = (
    ("heart_rate", r"\b(heart rate|heartrate)\b", r"alarm|variability"),
    ("respiratory_rate", r"\b(respiratory rate|respiration|resprate)\b", r"alarm|set|ventilator"),
    ("oxygen_saturation", r"\b(spo2|sao2|o2 saturation|oxygen saturation|o2sat)\b",
     r"alarm|limit|venous|mixed venous"),
    ("systolic_blood_pressure",
     r"\b(systolic blood pressure|blood pressure systolic|systemic systolic|non invasive blood pressure systolic"
     r"|nbp systolic|sbp)\b", r"alarm|pulmonary"),
    ("diastolic_blood_pressure",
     r"\b(diastolic blood pressure|blood pressure diastolic|systemic diastolic|non invasive blood pressure diastolic"
     r"|nbp diastolic|dbp)\b", r"alarm|pulmonary"),
    ("mean_arterial_pressure",
     r"\b(mean arterial pressure|arterial blood pressure mean|systemic mean|mean blood pressure"
     r"|non invasive blood pressure mean|nbp mean|map)\b", r"alarm|pulmonary"),
    ("temperature", r"\b(body temperature|temperature|temperature celsius|temperature fahrenheit)\b",
     r"alarm|device|blood warmer|environment|corrected|correction"),
    ("neutrophil_percent", r"neutrophils?.*(percent|/leukocytes)|\bneutrophils?\b|\bpolys\b",
     r"absolute|count|bands|fluid|csf|ascites"),
    ("lymphocyte_absolute_count", r"lymphocytes?.*(absolute|#/volume)|absolute lymphocyte",
     r"percent|/leukocytes"),
    ("eosinophil_percent", r"eosinophils?.*(percent|/leukocytes)|\beosinophils?\b",
     r"absolute|count|fluid|csf|ascites"),
    ("white_blood_cell_count", r"\b(wbc|white blood cells?|leukocytes?)\b",
     r"urine|csf|fluid|stool|neutrophil|lymphocyte|eosinophil|basophil|monocyte"),
    ("hemoglobin", r"\b(hemoglobin|hgb|hb)\b", r"a1c|glycated|plasma free|urine"),
    ("platelet_count", r"\b(platelet|platelets|plt)\b", r"mean|mpv|immature|distribution"),
    ("total_protein", r"\b(total protein|protein \[mass/volume\])\b", r"urine|csf|fluid|ascites|pleural"),
    ("albumin", r"\balbumin\b", r"urine|csf|fluid|ascites|pleural|gradient"),
    ("alanine_aminotransferase", r"alanine aminotransferase|\balt\b", None),
    ("aspartate_aminotransferase", r"aspartate aminotransferase|asparate aminotransferase|\bast\b", None),
    ("alkaline_phosphatase", r"alkaline phosphatase|alkaline phos\.?|\balp\b", None),
    ("gamma_glutamyl_transferase", r"gamma.?glutamyl|\bggt\b|\bgamma gt\b", None),
    ("direct_bilirubin", r"(bilirubin.*\bdirect\b|\bdirect\b.*bilirubin)", r"indirect"),
    ("total_bilirubin", r"(bilirubin.*total|total bilirubin)", r"direct|indirect"),
    ("bile_acid", r"\bbile acids?\b", None),
    ("creatinine", r"\bcreatinine\b", r"clearance|urine|dialysis|ratio|fluid|ascites|pleural"),
    ("glucose", r"\bglucose\b", r"urine|csf|fluid|ascites|pleural|estimated|mean"),
    ("triglyceride", r"\btriglycerides?\b", r"fluid"),
    ("cholesterol", r"\bcholesterol\b", r"hdl|ldl|ratio|fluid"),
    ("urate", r"\b(urate|uric acid)\b", r"urine|fluid"),
    ("prothrombin_time", r"prothrombin time|\bpt\b", r"inr|ptt|partial"),
    ("inr", r"\binr\b", None),
    ("ammonia", r"\bammonia\b", None),
    ("tacrolimus", r"\btacrolimus\b", None),
    ("cyclosporine", r"\bcyclosporine\b", None),
    ("sirolimus", r"\bsirolimus\b", None),
    ("cmv_dna", r"cytomegalovirus.*dna|\bcmv.?dna\b", None),
    ("ebv_dna", r"epstein.*barr.*dna|\bebv.?dna\b", None),
    ("hbv_dna", r"hepatitis b virus.*dna|\bhbv.?dna\b", None),
)

_CELLS = ("k/ul", "k/mcl", "10^9/l", "10*9/l", "10e9/l", "thousand/ul")
_MICROMOL = ("umol/l", "mg/dl")
# Units (as `unit_key_loose` gives them) a concept may be counted in.
COMPATIBLE_UNITS = {
    "heart_rate": ("bpm", "beats/min", "beats per minute"),
    "respiratory_rate": ("breaths/min", "insp/min", "resp/min", "bpm"),
    "oxygen_saturation": ("%", "percent"),
    "systolic_blood_pressure": ("mmhg", "mm hg"),
    "diastolic_blood_pressure": ("mmhg", "mm hg"),
    "mean_arterial_pressure": ("mmhg", "mm hg"),
    "temperature": ("c", "f", "°c", "°f", "deg c", "deg f"),
    "white_blood_cell_count": _CELLS,
    "neutrophil_percent": ("%", "percent"),
    "lymphocyte_absolute_count": _CELLS,
    "eosinophil_percent": ("%", "percent"),
    "hemoglobin": ("g/l", "g/dl"),
    "platelet_count": _CELLS,
    "total_protein": ("g/l", "g/dl"),
    "albumin": ("g/l", "g/dl"),
    "alanine_aminotransferase": ("u/l", "iu/l"),
    "aspartate_aminotransferase": ("u/l", "iu/l"),
    "alkaline_phosphatase": ("u/l", "iu/l", "units/l"),
    "gamma_glutamyl_transferase": ("u/l", "iu/l"),
    "direct_bilirubin": _MICROMOL,
    "total_bilirubin": _MICROMOL,
    "bile_acid": ("umol/l", "mcmol/l", "nmol/ml"),
    "creatinine": _MICROMOL,
    "glucose": ("mmol/l", "mg/dl"),
    "triglyceride": ("mmol/l", "mg/dl"),
    "cholesterol": ("mmol/l", "mg/dl"),
    "urate": _MICROMOL,
    "prothrombin_time": ("s", "sec", "secs", "second", "seconds"),
    "inr": ("", "inr", "ratio"),
    "ammonia": ("umol/l", "ug/dl"),
    "tacrolimus": ("ng/ml", "mcg/l"),
    "cyclosporine": ("ng/ml", "mcg/l"),
    "sirolimus": ("ng/ml", "mcg/l"),
    "cmv_dna": ("copies/ml",),
    "ebv_dna": ("copies/ml",),
    "hbv_dna": ("iu/ml",),
}


def concept_of(seen: Column, rules=CONCEPT_RULES) -> Column:
    """First rule whose include pattern is found and whose exclude pattern is not, in a label made `rule_text`.

    The rules are one constant list that is searched, so the expression's code doesn't grow with them.
    """
    listed = F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(i).alias("include"), F.lit(e).cast("string").alias("exclude")) for c, i, e in rules])
    fits = F.filter(listed, lambda r: F.rlike(seen, r["include"]) & ~F.coalesce(F.rlike(seen, r["exclude"]), F.lit(False)))
    return F.get(fits, F.lit(0))["concept"]


def classify_labels(df: DataFrame, label: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Add `concept`. The patterns run once per distinct label, not once per row.

    The labels come from the item dictionary where there is one, so the rows are not read an extra time. The patterns see an
    aggregate of the label, so the filter on what they give stays above the grouping.
    """
    labels = (df if dictionary is None else dictionary).select(label).where(F.col(label).isNotNull()).distinct()
    seen = labels.groupBy(label).agg(F.min(label).alias("_label")).withColumn("_seen", text.rule_text(F.col("_label")))
    concepts = seen.select(label, concept_of(F.col("_seen")).alias("concept")).where(F.col("concept").isNotNull())
    return df.join(concepts, label)


def allowed_units(spark: SparkSession) -> DataFrame:
    pairs = [(concept, unit) for concept, units in COMPATIBLE_UNITS.items() for unit in units]
    return spark.createDataFrame(pairs, "concept string, unit_loose string")


def with_compatible_unit(df: DataFrame, unit: str) -> DataFrame:
    """Keep rows whose (concept, unit) is allowed; the pair table is a fixed value, hence the broadcast."""
    keyed = df.withColumn("unit_loose", text.unit_key_loose(F.col(unit)))
    return keyed.join(F.broadcast(allowed_units(df.sparkSession)), ["concept", "unit_loose"], "left_semi")

"""CSV sources: projected scans, gzip fallback, mixed encodings and headers, tagged unions."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortline.functions import text
from cohortline.operators.labels_followup import label_columns

NO_BREAK_SPACE = " "


def scan_csv(spark: SparkSession, folder: str, table: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns of `{table}.csv` or its gzip form under a folder, with a declared schema (no inference pass).

    A gzip file is read by one task; persist such a source as Parquet before working on it.
    """
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", f"{table}.csv*").option(
        "recursiveFileLookup", True
    ).csv(folder)
    return rows.select(*present_columns(rows, columns)) if columns else rows


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that the source has."""
    return [c for c in wanted if c in df.columns]


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """Header bytes and encoding of each file, from one pass over its lines.

    Lines are read byte for byte (as ISO-8859-1); a file is UTF-8 if all its lines are.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    placed = lines.select(
        "line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    is_utf8 = F.is_valid_utf8(F.encode(F.col("line"), "ISO-8859-1").cast("string"))
    return placed.groupBy("file").agg(
        F.min_by("line", F.when(F.col("start") == 0, F.col("id"))).alias("header"), F.min(is_utf8).alias("is_utf8")
    )


@F.pandas_udf(T.StringType())
def _gb18030(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda raw: None if raw is None else raw.encode("iso-8859-1").decode("gb18030", "replace"))


def decoded(column: Column) -> Column:
    """Text whose GB18030 bytes were read one by one; only cells with a byte over 0x7F go through Python.

    Bytes that are no GB18030 become U+FFFD.
    """
    return F.coalesce(_gb18030(F.when(column.rlike(r"[^\x00-\x7F]"), column)), column)


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files under a path as one table of strings: encodings by file, headers joined by name.

    Files are grouped by (encoding, header); there is one read per group, not per file. A quote inside quotes is
    doubled, in headers too, and a backslash is plain text: it may be the second byte of a GB18030 character.
    """
    kinds = file_kinds(spark, path).where(F.col("header").isNotNull())
    groups = kinds.groupBy("header", "is_utf8").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for group in sorted(groups, key=lambda g: (g["header"], g["is_utf8"])):
        raw = group["header"].encode("iso-8859-1")
        names = next(csv.reader([raw.decode("utf-8-sig" if group["is_utf8"] else "gb18030").rstrip("\r")]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        encoding = "UTF-8" if group["is_utf8"] else "ISO-8859-1"
        rows = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"').csv(sorted(group["files"]))
        source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")
        cells = [F.col(f"`{n}`") for n in names]
        shown = cells if group["is_utf8"] else [decoded(c).alias(n) for c, n in zip(cells, names, strict=True)]
        parts.append(rows.select(*cells, source).select(*shown, "source_file"))
    return reduce(lambda a, x: a.unionByName(x, allowMissingColumns=True), parts)


def labelled_union(parts: Sequence[DataFrame], whitelist: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Tables of differing headers as one, with the label columns found and the whitelisted ones missing."""
    merged = reduce(lambda a, x: a.unionByName(x, allowMissingColumns=True), parts)
    found, missing = label_columns(merged.columns, whitelist)
    return merged, found, missing


def tagged_union(
    tables: Mapping[str, DataFrame], keys: Sequence[str], blacklist: Sequence[str] = (), subject: str = "subject_id"
) -> DataFrame:
    """Rows of many tables as (keys, file_name, attrs): dictionaries (`d_*`), blacklisted tables and tables without the subject are left out.

    Every column becomes text in a map; no-break spaces become spaces.
    """
    parts = []
    for name, table in sorted(tables.items()):
        if name.startswith("d_") or name in blacklist or subject not in table.columns:
            continue
        attrs = F.map_from_entries(F.array(*[
            F.struct(F.lit(c).alias("key"), _plain(F.col(f"`{c}`")).alias("value")) for c in table.columns
        ]))
        key_columns = [F.col(k).cast("string").alias(k) if k in table.columns else F.lit(None).cast("string").alias(k) for k in keys]
        parts.append(table.select(*key_columns, F.lit(name).alias("file_name"), attrs.alias("attrs")))
    return reduce(lambda a, x: a.unionByName(x), parts)


def _plain(value: Column) -> Column:
    return F.translate(value.cast("string"), NO_BREAK_SPACE, " ")


def check_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Fail on a source whose columns are not exactly the expected ones."""
    if list(df.columns) != list(expected):
        raise ValueError(f"expected columns {list(expected)}, found {df.columns}")
    return df


def read_vocabulary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated vocabulary table, cells trimmed; quotes are plain text."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return rows.select(*[F.trim(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema])


def exam_lists(details: DataFrame) -> DataFrame:
    """Distinct exam names per note from a field/value table."""
    exams = details.where(F.col("field_name") == "exam_name").where(text.clean_text(F.col("field_value")) != "")
    return exams.select("note_id", "field_value").distinct().groupBy("note_id").agg(
        F.array_sort(F.collect_list("field_value")).alias("exams")
    )

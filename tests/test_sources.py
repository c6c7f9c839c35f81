"""Sources and sinks on small files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cohortline.operators import labels_followup as lf, phenotype as ph
from cohortline.sources import delimited, refresh, tables
from cohortline.sources.versions import VersionedTable
from cohortline.streaming import jobs


def test_plain_or_gzip_csv(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b string").schema
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as out:
        out.write("a,b\n2,y\n")
    assert delimited.scan_csv(spark, str(tmp_path), "plain", schema).collect() == [(1, "x")]
    assert delimited.scan_csv(spark, str(tmp_path), "packed", schema, ["b", "c"]).collect() == [("y",)]


def test_mixed_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿天数,WBC_label\n3,1\n4,\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("天数,ALB_label\n30,死亡\n".encode("gb18030"))
    (tmp_path / "c.csv").write_bytes("天数,WBC_label\n5,阴性\n".encode("gb18030"))
    rows = delimited.read_mixed(spark, f"{tmp_path}/*.csv")
    got = sorted((r["天数"], r["WBC_label"], r["ALB_label"], r["source_file"]) for r in rows.collect())
    assert got == [("3", "1", None, "a.csv"), ("30", None, "死亡", "b.csv"), ("4", None, None, "a.csv"), ("5", "阴性", None, "c.csv")]


def test_mixed_encodings_hard_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"a,b",c\n1,"say ""乗"" \\"\n'.encode())
    (tmp_path / "b.csv").write_bytes('id,c\n1,"乗"\n2,"x\\"\n3,plain\n'.encode("gb18030"))
    (tmp_path / "d.csv").write_bytes(b"id,c\n4,\xff\n5,\xc4\xe3\n")
    got = {(r["source_file"], r["a,b"], r["id"], r["c"]) for r in delimited.read_mixed(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {
        ("a.csv", "1", None, 'say "乗" \\'), ("b.csv", None, "1", "乗"), ("b.csv", None, "2", "x\\"), ("b.csv", None, "3", "plain"),
        ("d.csv", None, "4", "\ufffd"), ("d.csv", None, "5", "你"),
    }


def test_label_discovery():
    assert lf.label_columns(["x", "b_label", "a_label"]) == (["a_label", "b_label"], [])
    assert lf.label_columns(["x", "b_label"], ["b_label", "c_label"]) == (["b_label"], ["c_label"])


def test_labelled_union(spark):
    parts = [spark.createDataFrame([(1, "p")], "d int, A_label string"), spark.createDataFrame([(2, "q")], "d int, B_label string")]
    merged, found, missing = delimited.labelled_union(parts, ["B_label", "Z_label"])
    assert merged.count() == 2 and found == ["B_label"] and missing == ["Z_label"]


def test_tagged_union_skips_dictionaries(spark):
    rows = spark.createDataFrame([(1, "a b")], "subject_id int, note string")
    merged = delimited.tagged_union({"labs": rows, "d_items": rows, "bad": rows, "other": rows.drop("subject_id")}, ["subject_id"], ["bad"])
    assert [(r["file_name"], r["attrs"]["note"]) for r in merged.collect()] == [("labs", "a b")]


def test_strict_columns(spark):
    with pytest.raises(ValueError):
        delimited.check_schema(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    assert ph.duplicate_keys(spark.createDataFrame([(1,), (1,), (2,)], "a int"), ["a"]).collect() == [(1, 2)]


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "t1"), (2, "val", "t1"), (3, "val", "t2")], "sample int, split string, task string")
    tables.write_index(rows, str(tmp_path / "i"))
    got = tables.read_index(spark, str(tmp_path / "i"), "sample int, split string, task string", ["val"], ["t1"])
    assert [r["sample"] for r in got.collect()] == [2]
    tables.write_index(rows.where("sample = 3").withColumn("sample", F.lit(9)), str(tmp_path / "i"))
    left = tables.read_index(spark, str(tmp_path / "i"), "sample int, split string, task string")
    assert sorted(r["sample"] for r in left.collect()) == [1, 2, 9]


def test_index_of_a_hot_task_has_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        rows = spark.range(40_000).selectExpr("id AS sample", "'train' AS split", "IF(id < 39990, 't1', 't2') AS task", "uuid() AS note")
        tables.write_index(rows, str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "i/split=train/task=t1").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "i")).select("sample").distinct().count() == 40_000


def test_json_array_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "label": "[3, 1]"}, {"id": 2, "label": "4"}, {"id": 3, "label": "x"}]))
    rows = tables.parsed_labels(tables.read_records(spark, str(tmp_path / "r.json"), "id int, label string", array_file=True))
    assert {r["id"]: r["labels"] for r in rows.collect()} == {1: [3, 1], 2: [4], 3: []}


def test_refresh_rebuilds_only_changes(spark, tmp_path):
    folder, output = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n2\n")
    (folder / "b.csv").write_text("x\n5\n")
    read = lambda: spark.read.schema("x int").option("header", True).csv(str(folder))
    build = lambda rows: rows.groupBy("source").agg(F.sum("x").alias("total"))
    totals = lambda: sorted(r["total"] for r in refresh.current(spark, output).collect())
    assert refresh.refresh(spark, read(), {"v": 1}, build, output) == 2
    assert refresh.refresh(spark, read(), {"v": 1}, build, output) == 0
    (folder / "b.csv").write_text("x\n5\n70\n")
    assert refresh.refresh(spark, read(), {"v": 1}, build, output) == 1
    assert totals() == [3, 75]
    assert refresh.refresh(spark, read(), {"v": 2}, build, output) == 2
    (folder / "b.csv").write_text("x\n")  # read as a file without rows
    (folder / "c.csv").write_text("x\n8\n")
    assert refresh.refresh(spark, read(), {"v": 2}, build, output) == 1
    assert totals() == [3, 8]
    few = lambda rows: build(rows.where("x < 8"))
    assert refresh.refresh(spark, read(), {"v": 3}, few, output) == 2
    assert totals() == [3]
    (folder / "c.csv").write_text("x\n7\n")
    assert refresh.refresh(spark, read(), {"v": 3}, few, output) == 1
    assert totals() == [3, 7]
    (folder / "a.csv").unlink()
    assert refresh.refresh(spark, read(), {"v": 3}, few, output) == 0
    assert totals() == [7]


def test_stream_keeps_newest_counts(spark, tmp_path):
    folder = tmp_path / "s"
    for i in range(3):
        spark.createDataFrame([("d", "t", "i", "u", str(v)) for v in range(i + 1)], "dataset string, `table` string, item string, unit string, value string") \
            .coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    stream = jobs.count_stream(jobs.file_stream(spark, str(folder), "*.parquet", schema, 1))
    keys = ["dataset", "table", "item", "unit"]
    jobs.keep_latest(stream, str(tmp_path / "o"), str(tmp_path / "c"), keys).awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "o"), keys).collect()
    assert [r["count"] for r in got] == [6]


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    from cohortline.plans.files import bucketed_pair

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks, people = bucketed_pair(spark, sf_dir)
        found = blocks.join(people, "subject_id").groupBy("subject_id").count()
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_refresh_that_breaks_off_shows_nothing(spark, tmp_path, monkeypatch):
    """Broken off before any of its writes and before its commit, a refresh leaves the whole version of before; done again, the next."""
    folder, output = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, values in (("a", "1 2"), ("b", "5"), ("c", "9")):
        (folder / f"{name}.csv").write_text("x\n" + "\n".join(values.split()) + "\n")
    read = lambda: spark.read.schema("x int").option("header", True).csv(str(folder))
    build = lambda rows: rows.groupBy("source").agg(F.sum("x").alias("total"))
    seen = lambda: sorted(r["total"] for r in refresh.current(spark, output).collect())
    assert refresh.refresh(spark, read(), {}, build, output) == 3 and seen() == [3, 5, 9]
    held = refresh.current(spark, output)
    (folder / "a.csv").write_text("x\n1\n20\n")
    (folder / "b.csv").unlink()
    for broken in ("data", "manifest", "commit"):
        with monkeypatch.context() as patch:
            write, commit = VersionedTable.new_run, VersionedTable.commit

            def new_run(self, rows, name="run", partition_by=(), write=write, broken=broken):
                found = write(self, rows, name, partition_by)
                if name == broken:
                    raise OSError("lost")  # after the folder was written
                return found

            def late(self, *args, commit=commit, broken=broken):
                if broken == "commit":
                    raise OSError("lost")
                return commit(self, *args)

            patch.setattr(VersionedTable, "new_run", new_run)
            patch.setattr(VersionedTable, "commit", late)
            with pytest.raises(OSError, match="lost"):
                refresh.refresh(spark, read(), {}, build, output)
        assert seen() == [3, 5, 9]
    assert refresh.refresh(spark, read(), {}, build, output) == 1 and seen() == [9, 21]
    assert sorted(r["total"] for r in held.collect()) == [3, 5, 9]  # a reader of the version before goes on
    monkeypatch.setattr(refresh, "MOST_RUNS", 1)
    (folder / "c.csv").write_text("x\n10\n")
    assert refresh.refresh(spark, read(), {}, build, output) == 1 and seen() == [10, 21]
    assert sum(n.startswith("data") for n in VersionedTable(spark, output).version().runs) == 1


def test_streamed_files_grow_in_number(spark, sf_dir, tmp_path, monkeypatch):
    from cohortline.plans import files

    monkeypatch.setattr(files, "scratch_path", lambda _, name: str(tmp_path / name))
    stream, seen = files.streamed_lines(spark, sf_dir, file_lines=400), []
    note = lambda batch, _: seen.append(batch.count())
    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    held = [spark.read.parquet(str(p)).count() for p in (tmp_path / "stream").glob("*.parquet")]
    assert len(seen) == files.BATCHES and sum(seen) == sum(held) > 5000
    assert max(held) < 800

"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "cohortline") -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cohortline-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


#: Folders that this process has named, in order
_NAMED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, where every executor can reach it."""
    folder = f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"
    _NAMED.append(folder)
    return f"{folder}/{name}"


def scratch_mark() -> int:
    """Where the list of scratch folders stands, for `drop_scratch`."""
    return len(_NAMED)


def drop_scratch(spark: SparkSession, mark: int, kept: str | None = None) -> None:
    """Remove the scratch folders named since `mark`, but for the one that holds `kept`.

    For jobs of several steps, once a step's result is written: no table read from those folders may be used any more.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _NAMED[mark:]:
        if kept is None or not kept.startswith(f"{folder}/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    _NAMED[mark:] = [folder for folder in _NAMED[mark:] if kept is not None and kept.startswith(f"{folder}/")]


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back.

    Lineage ends there: after an executor loss later steps read the same rows. Unlike an RDD checkpoint the
    table is columnar and compressed, later reads are pruned to their columns, and its size is known to
    the optimizer.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

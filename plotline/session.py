"""Session helpers shared by every operator: where intermediate tables go, and how to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plotline")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Settings of Python workers: a task computes in one thread, as cores are shared by tasks, and freed memory goes back to the system at once. Workers live as long as the session, and what they keep adds up.
WORKER_MEMORY = {"OPENBLAS_NUM_THREADS": "1", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 18), "MALLOC_TRIM_THRESHOLD_": str(1 << 18), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the caller only changed its own sys.path, and give memory back as soon as it is free."""
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if REPO not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *have])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> SparkSession:
    """Let rows go to Python workers in batches of at most ``size`` bytes: texts differ in length, so a number of rows bounds nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


#: Rows that a task sorts at most, about: some 200 MB of rows of a few columns.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` with rows of equal keys in one task, in as many tasks as its rows need: a fixed number of shuffle partitions lets tasks grow with the table.

    ``rows`` is the number of rows, where counting them would repeat work."""
    tasks = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests, one machine) a new folder under /tmp is taken."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, and go when the plan is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/plotline-{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back, so that its size is known to the optimizer."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)

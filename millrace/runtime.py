"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that an operator may broadcast.
BROADCAST_LIMIT = 16 << 20


def local_session(cpus: int = 8, name: str = "millrace", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once in an application, so that no node needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    sc.addPyFile(str(to))
    sc._millrace_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in a local session where that is unset, one of our own."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or conf.get("spark.millrace.shared.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'millrace-shared')}"


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that the table can feed several branches and survives lost executors. The files
    are deleted when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again, before the application ends."""
    path = getattr(df, "_millrace_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings, with ``__`` for dots, for what is written in here."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())


def measured_bytes(df: DataFrame) -> int:
    """The bytes of a table's values in memory: its rows times their fixed part, and all that varies."""
    fixed, varying = 8, F.lit(0)
    for name, kind in df.dtypes:
        fixed += 16
        if kind in ("string", "binary"):
            varying = varying + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map")):
            varying = varying + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.sum(varying.cast("long")).alias("v")).first()
    return row["n"] * fixed + (row["v"] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only of a table that was measured to be small; otherwise leave the join to shuffle. The optimizer's
    estimate, which is of compressed files, only tells which tables are worth measuring."""
    return F.broadcast(df) if estimated_bytes(df) <= limit and measured_bytes(df) <= limit else df


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key; redelivered exact copies disappear."""
    return df.dropDuplicates(list(keys))


def salted(key: Column | str, buckets: int) -> Column:
    """A deterministic salt in ``[0, buckets)`` from another column."""
    return F.pmod(F.xxhash64(F.lit(77), key), F.lit(buckets)).cast("int")

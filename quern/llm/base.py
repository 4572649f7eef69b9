"""Shared helpers: table access, scratch tables in the shared folder, word rules."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark then deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of rows that a Python worker gets at once. Spark's own 64 MB are held two to three times: while the JVM's buffer
#: doubles, as the sent message, and in the worker.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, as in tests.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    place = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors. The files go
    at the end of the Python process; the shuffle files of the write, which
    nothing needs once the table stands, go at once. Python workers get rows of
    BATCH_BYTES at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    own = {_CLEANUP: "true", _BATCH_BYTES: str(BATCH_BYTES)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLocalProperty("spark.job.description", label)  # for the reader of the event log
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def release(*settled: DataFrame) -> None:
    """Delete tables of ``settle`` that nothing to come reads."""
    for df in settled:
        _written.remove((df.sparkSession, df._settled))
        _delete(df.sparkSession, df._settled)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage between the phases of a long operator.

    Broadcasts, shuffle state and plans that nothing refers to go only then, on
    the driver and on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_settled() -> None:
    """Delete what ``settle`` wrote, as far as the session still lives."""
    while _written:
        _delete(*_written.pop())


atexit.register(drop_settled)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column in a type; null if it is missing.

    Names are matched literally, and without regard to case only when no exact
    match exists.
    """
    exact = {c: c for c in df.columns}
    loose = {c.lower(): c for c in reversed(df.columns)}
    found = exact.get(name) or loose.get(name.lower())
    return (F.col(f"`{found}`") if found else F.lit(None)).cast(kind)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Exactly the named columns with their types; other columns are left behind."""
    return df.select(*[column(df, name, kind).alias(name) for name, kind in types.items()])


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(seed: str, *parts: Column) -> Column:
    """A repeatable draw from (0, 1), fixed by the parts: 52 bits of an MD5."""
    whole = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(whole, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))

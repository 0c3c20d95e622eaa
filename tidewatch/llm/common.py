"""Helpers shared by the training-data operators: tables, shared storage, words."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Spark's regular expressions.
SQL_SPACE = r"[\x20\x09-\x0D]+"

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the
    master is local, as in tests, a folder of this process takes its place and goes with it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_ROWS = 500  # texts in an Arrow batch of a pipeline's stage; both sides of the pipe hold whole batches

_stage: list[str] | None = None  # paths stored since the stage that runs began
_before: list[str] = []  # and by the stage before it


def put(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; also the path, for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _stage is not None:
        _stage.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``put`` without the path: a lost executor costs no recomputation."""
    return put(df, name, **options)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that are gone: Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def staged(spark: SparkSession, make: Callable[[], DataFrame], last: bool = False) -> DataFrame:
    """``make()`` as a stage of a pipeline whose result is written before the next stage begins: what the stage before
    this one stored has been read by then, and is deleted.  What the ``last`` stage stored stays for its reader.
    The session's Arrow batches get ``_ARROW_ROWS`` rows at most, and keep that, as results are computed by their readers."""
    global _stage, _before
    discard(spark, *_before)
    if not 0 < int(spark.conf.get(_ARROW)) <= _ARROW_ROWS:
        spark.conf.set(_ARROW, _ARROW_ROWS)
    _stage, _before = [], []
    try:
        return make()
    finally:
        _before, _stage = [] if last else _stage, None


def grows(df: DataFrame) -> DataFrame:
    """``df``, marked so that a join shuffles it: a table that grows with the input would fill the driver as a broadcast,
    which holds many times its stored size there, long before that size reaches Spark's limit for broadcasts."""
    return df.hint("merge")


def texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut so that only a few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(mod: int):
    """Column: crc32 of the decimal doc_id is divisible by ``mod`` (null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0

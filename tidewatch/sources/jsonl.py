"""JSON-lines scans: tolerant, counting and strict; streams with metadata; thresholds; ids done before.

Lines are read by Spark's text source, so any store that Spark reads will do.  Line
order is time order: ``_metadata`` gives a line's file and block, and ``numbered``
ranks lines within blocks, so no task orders a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import records
from tidewatch.operators import decisions

#: Files of a stream folder that are no streams.
METADATA, PERTURBED = "_meta", "adversarial_text_stream_input"


def lines(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """Columns file, value of every line."""
    read = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    return read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``line``, the place of a line in its file from 0.

    A task numbers the lines that it reads in order (``monotonically_increasing_id``);
    blocks of a file follow each other by their counts.
    """
    from pyspark.sql import Window

    from tidewatch.storage import stored

    kept = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "lines")
    blocks = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    based = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return kept.join(based, ["file", "block"]).withColumn("line", F.col("_base") + F.col("_id") - F.col("_first")).drop("_id", "_first", "_base", "block")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Normalised records of all files under ``path``; blank and malformed lines are dropped."""
    return records.normalise(lines(spark, path).drop("block"))


def load_counting(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows, parse errors and the sorted names of all its keys."""
    rows = lines(spark, path, True).where(F.trim("value") != "")
    value = F.try_parse_json("value")
    bad = value.isNull()
    keys = F.when(F.schema_of_variant(value).like("OBJECT%"), F.json_object_keys("value"))
    some = rows.select("file", bad.alias("bad"), keys.alias("keys"))
    named = some.select("file", F.explode("keys").alias("key")).distinct().groupBy("file").agg(F.sort_array(F.collect_list("key")).alias("columns"))
    counts = some.groupBy("file").agg(F.count_if(~F.col("bad")).alias("n"), F.count_if("bad").alias("parse_errors"))
    return counts.join(named, "file", "left")


def load_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of ``schema``; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files under ``path`` and its folders, by path; an error if there are none."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    got = read.select(F.col("_metadata.file_path").alias("file"), "length").orderBy("file")
    if got.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {path}")
    return got


def is_stream(name: Column) -> Column:
    """Is a file of this name a stream (and no metadata or text for scoring)?"""
    return name.endswith(".jsonl") & ~name.contains(METADATA) & ~name.contains(PERTURBED)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """stream and drift_point of the side-car files of a folder; a missing or null point is null."""
    rows = spark.read.option("pathGlobFilter", f"*{METADATA}.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    stream = F.regexp_replace("name", f"{METADATA}\\.json$", "")
    return rows.select(stream.alias("stream"), F.get_json_object("value", "$.drift_point").try_cast("long").alias("drift_point"))


def load_streams(spark: SparkSession, path: str) -> DataFrame:
    """Records of all streams of a folder with stream, line and the drift point; a stream without side-car has none."""
    rows = numbered(lines(spark, path, pattern="*.jsonl")).withColumn("name", F.element_at(F.split("file", "/"), -1)).where(is_stream(F.col("name")))
    named = rows.select(F.regexp_replace("name", r"\.jsonl$", "").alias("stream"), "line", "value")
    return records.normalise(named).join(metadata(spark, path), "stream", "left")


def load_thresholds(spark: SparkSession, path: str | None) -> dict:
    """The defaults, overlaid with those that the file (one JSON object) sets."""
    if path is None:
        return decisions.thresholds()
    value = spark.read.text(path, wholetext=True).first().value
    row = spark.range(1).select(*[F.get_json_object(F.lit(value), f"$.{key}").try_cast("double").alias(name) for name, key in decisions.FILE_KEYS.items()]).first()
    return decisions.overlay(row.asDict())


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a results file before its first bad or blank line; a missing path has none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "id string")
    rows = numbered(lines(spark, path)).withColumn("v", F.try_parse_json("value"))
    stop = rows.where("v is null").groupBy("file").agg(F.min("line").alias("stop"))
    kept = rows.join(stop, "file", "left").where("stop is null or line < stop")
    return kept.select(F.try_variant_get("v", "$.id", "string").alias("id")).where("id is not null").distinct()


def has_column(spark: SparkSession, path: str, names: tuple[str, ...] = records.ALIASES["unsafe"], first: int = 5) -> DataFrame:
    """Per file: does one of its first lines have one of the columns?"""
    rows = numbered(lines(spark, path)).where(F.col("line") < first)
    keys = F.json_object_keys(F.when(F.try_parse_json("value").isNotNull(), F.col("value")))
    return rows.groupBy("file").agg(F.coalesce(F.bool_or(F.arrays_overlap(keys, F.array(*map(F.lit, names)))), F.lit(False)).alias("found"))


def column_of(rows: DataFrame, value: str, names: tuple[str, ...], by: str = "file", order: str = "line") -> DataFrame:
    """Per file: the first of ``names`` that its first record has (even if null there); null if it has none."""
    first = rows.groupBy(by).agg(F.min_by(value, order).alias("_first"))
    keys = F.json_object_keys("_first")
    return first.select(by, F.element_at(F.array_append(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(keys, n)), F.lit(None).cast("string")), 1).alias("column"))


def numbers_of(rows: DataFrame, value: str, names: tuple[str, ...], by: str = "file", order: str = "line") -> DataFrame:
    """Per file: the numbers in the column that ``column_of`` picks; what doesn't parse is left out."""
    picked = column_of(rows, value, names, by, order).where("column is not null")
    found = rows.join(picked, by).select(by, order, records.number(F.expr(f"get_json_object({value}, concat('$.', column))")).alias("number"))
    return found.where("number is not null")


def batched(rows: DataFrame, score, schema: str, size: int = 16) -> DataFrame:
    """``score`` (a list of dicts to a list of dicts) over batches of rows; a batch that fails goes row by row, a row
    that fails again has its reason in ``error`` and nulls."""
    out = rows.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def one(row: dict) -> dict:
            try:
                return score([row])[0]
            except Exception as e:  # the scorer's own failure: kept with the row
                return {"id": row.get("id"), "error": f"{type(e).__name__}: {e}"}

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size).to_pylist()
                try:
                    got = score(part)
                except Exception:  # which row it was shows one by one
                    got = [one(r) for r in part]
                yield pa.RecordBatch.from_pylist([{n: g.get(n) for n in names} for g in got], schema=arrow)

    return rows.mapInArrow(run, schema)

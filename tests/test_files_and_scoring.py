"""Sources, sinks, audits, synthesis guards, scoring and streaming on small files."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit, calibration, scoring, synthesis
from tidewatch.plans import extended
from tidewatch.sources import jsonl, sinks
from tidewatch.streaming import count_windows


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"unsafe_confidence":0.5}\n\n{bad\n{"id":2,"score":0.5,"lang":"en"}\n')
    (tmp_path / "b.jsonl").write_text('{"id":3,"pred_label":"safe","confidence":"0.9"}\n')
    (tmp_path / "a_meta.json").write_text(json.dumps({"stream_name": "a", "drift_point": 1}, indent=2))
    (tmp_path / "adversarial_text_stream_input.jsonl").write_text('{"id":9}\n')
    return str(tmp_path)


def test_scans(spark, folder):
    got = jsonl.load_streams(spark, folder).orderBy("stream", "line").collect()
    assert [(r.stream, r.line, r.id, r.drift_point) for r in got] == [("a", 0, "1", 1), ("a", 3, "2", 1), ("b", 0, "3", None)]
    counted = {r.file.rsplit("/", 1)[1]: r for r in jsonl.load_counting(spark, folder).collect()}
    assert (counted["a.jsonl"].n, counted["a.jsonl"].parse_errors, counted["a.jsonl"].columns) == (2, 1, ["id", "lang", "score", "unsafe_confidence"])
    assert jsonl.files(spark, folder).count() == 3
    with pytest.raises(FileNotFoundError):
        jsonl.files(spark, folder, "*.none")
    with pytest.raises(Exception):
        jsonl.load_strict(spark, folder + "/a.jsonl", "id long").collect()
    assert {r.id for r in jsonl.completed_ids(spark, folder + "/a.jsonl").collect()} == {"1"}  # up to the blank line
    assert jsonl.completed_ids(spark, folder + "/none.jsonl").count() == 0
    assert {r.file.rsplit("/", 1)[1]: r.found for r in jsonl.has_column(spark, folder).collect()}["a.jsonl"]


def test_audit_of_files(spark, folder):
    rows = jsonl.numbered(jsonl.lines(spark, folder, pattern="*.jsonl"))
    listed = jsonl.files(spark, folder).select("file").unionByName(spark.createDataFrame([("file:///none.jsonl",)], "file string"))
    got = {r.file.rsplit("/", 1)[1]: r for r in audit.audit_files(rows, listed).collect()}
    assert got["none.jsonl"].n_rows == 0 and got["none.jsonl"].warnings is None
    a = got["a.jsonl"]
    assert (a.n_rows, a.parse_errors, a.unsafe_confidence_n, a.pred_confidence_n) == (2, 1, 1, 0) and any("CRITICAL" in w for w in a.warnings)
    assert audit.exit_status(audit.audit_files(rows)) == 0
    half = spark.createDataFrame([("x.jsonl", i, '{"pred_confidence":0.5}') for i in range(6)], "file string, line long, value string")
    stopped = audit.audit_files(half)
    assert audit.exit_status(stopped) == 2 and sinks.audit_text(stopped).first().tag == "STOP"
    assert audit.missing_artefacts(spark, [folder, folder + "/zz"]) == [folder + "/zz"]


def test_guards_of_synthesis_and_calibration(spark):
    few = spark.range(99).select(F.col("id").alias("rid"))
    with pytest.raises(ValueError):
        synthesis.length(few, 2000)
    assert synthesis.length(spark.range(120), 2000) == 360
    one = spark.range(150).select(F.col("id").alias("rid"), F.lit("xx").alias("language"), F.lit("SAFE").alias("predicted"), F.lit("s").alias("source"), F.lit(0.5).alias("uc"), F.lit("").alias("text"))
    assert synthesis.source_sudden(one, 100).first().stream_name == "language_sudden"  # one source
    assert synthesis.language_gradual(one, 100).count() == 100  # empty pools are all records
    noisy = synthesis.confidence_shift_sudden(one, 100).select("uc").collect()
    assert len({r.uc for r in noisy}) > 50 and all(0 <= r.uc <= 1 for r in noisy)
    assert synthesis.perturbed_stream(one).count() == 0
    said = one.withColumn("text", F.concat(F.lit("some text "), F.col("rid")))
    got = synthesis.perturbed_stream(said, 400).collect()
    assert len(got) == 400 and all(r.text == r.original_text for r in got if r.pos < 200) and any(r.text != r.original_text for r in got)
    with pytest.raises(ValueError):
        calibration.replicates(one.select("rid", F.lit(None).cast("double").alias("uc")), 2, 10)
    assert calibration.replicates(one.limit(10), 3, 10).groupBy("stream", "idx").count().count() == 6  # with replacement
    drawn = calibration.replicates(one, 4, 20).groupBy("stream", "idx").count().collect()
    assert len(drawn) == 8 and all(r["count"] == 20 for r in drawn)


def test_perturbed_long_texts_equal_sql(spark, tmp_path):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("sea 0ttoe"), 12_000).alias("text"))  # 108,000 characters
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(extended.SQL["text_perturb"]).fetchall())
    assert dict(tuple(r) for r in extended.QUERIES["text_perturb"](spark, str(tmp_path)).collect()) == want and len(set(want.values())) > 10


def test_scoring_resumes_and_falls_back(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"text {i}", "en", None, "src", None) for i in range(40)], "id string, text string, language string, label string, source string, modality string")

    def fails(batch):
        if any("text 7<" in r["prompt"] for r in batch):
            raise RuntimeError("no")
        return scoring.mock(batch)

    got = {r.id: r for r in scoring.score(rows, fails, 8).collect()}
    assert len(got) == 40 and got["7"].error == "RuntimeError: no" and got["7"].prob_extraction_failed and got["7"].unsafe_confidence is None
    assert all(r.error is None and r.pred_confidence >= 0.5 for i, r in got.items() if i != "7")
    path = str(tmp_path / "out")
    assert scoring.run(rows.limit(10), path).count() == 10
    assert scoring.run(rows, path).count() == 40
    assert sinks.merge_failures(rows.limit(1), rows.limit(2)).count() == 3
    summary = sinks.confidence_summary(scoring.score(rows, fails)).first()
    assert (summary.total_records, summary.prob_extraction_failed_count, summary.unsafe_confidence_n) == (40, 1, 39)


def test_count_windows_over_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = [round(float(v), 3) for v in rng.random(95)]
    rows = spark.createDataFrame([("s", i, i, v) for i, v in enumerate(values)], "stream string, time long, key long, uc double")
    for part, (a, z) in enumerate(((0, 33), (33, 70), (70, 95))):
        rows.where((F.col("time") >= a) & (F.col("time") < z)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = count_windows.detect(source, 20, 5).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.idx: r for r in spark.table("windows").collect()}
    assert sorted(got) == [1, 2, 3]
    for i, r in got.items():
        want = count_windows.compare(np.array(values[:20]), np.array(values[20 * i : 20 * i + 20]), 5)
        assert np.allclose((r.kl, r.js, r.ks_stat, r.ks_p, r.wasserstein), want)


def test_scores_of_a_stream_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"t{i}", "en", None, "s", None) for i in range(12)], "id string, text string, language string, label string, source string, modality string")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run has a new checkpoint, so it sees all rows again
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        count_windows.append_scores(source, str(tmp_path / "out"), str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 12

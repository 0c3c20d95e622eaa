"""Queries of sources, sinks, synthesis, calibration, the grid and scoring over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import records
from tidewatch.functions.numbers import even
from tidewatch.operators import audit, calibration, decisions, grid, scoring, synthesis, windows
from tidewatch.sources import jsonl, sinks
from tidewatch.storage import fresh

from . import bindings
from .oracles import _BASE, _DECIDED, _bin, _even, _mean, _squares, _windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# ---- records -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE event_id::VARCHAR END AS id,
  CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ms' ELSE 'unknown' END AS language, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'unknown' END AS source FROM events""")
def field_coalesce(spark, sf_dir):
    """Aliases of a field: the first that is set, null ones passed over."""
    name = F.element_at(F.array(*map(F.lit, ("id", "sample_id", "idx", "number"))), (F.col("event_id") % 4 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, ('"lang":null,"lang_code":"en"', '"language":"ms"', '"lang":null'))), (F.col("event_id") % 3 + 1).cast("int"))
    source = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(',"source":"'), F.col("event_type"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit('{"'), name, F.lit('":'), F.col("event_id"), F.lit(","), lang, source, F.lit("}"))
    return records.normalise(events(spark, sf_dir).select("event_id", line.alias("value"))).select("event_id", "id", "language", "source")


_EDGE = (
    ('{"pred":"Hate","score":0.9}', "UNSAFE", 0.9, "derived_from_pred_confidence"),
    ('{"pred_label":"\\t safe ","confidence":0.75}', "SAFE", 0.25, "derived_from_pred_confidence"),
    ('{"prediction":1,"prob":"0.6"}', "UNSAFE", 0.6, "derived_from_pred_confidence"),
    ('{"predicted":"maybe","prob":0.6}', "MAYBE", 0.6, "derived_from_pred_confidence"),
    ('{"safe_probability":0.25}', "UNKNOWN", 0.75, "direct_unsafe_probability"),
    ('{"unsafe_confidence":"abc","unsafe_probability":0.8}', "UNKNOWN", None, "missing"),
    ('{"unsafe_confidence":null,"unsafe_probability":0.8}', "UNKNOWN", 0.8, "direct_unsafe_probability"),
    ('{"pred_label":2}', "UNKNOWN", None, "missing"),
    ('{"pred_label":true,"score":true}', "UNSAFE", 1.0, "derived_from_pred_confidence"),
    ("[1]", "UNKNOWN", None, "missing"),
    ("{bad", None, None, None),
    (" ", None, None, None),
)


def _sql_value(x) -> str:
    return "NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else f"'{x}'"


@query(
    "SELECT event_id, predicted, unsafe_confidence, confidence_source FROM events JOIN (VALUES "
    + ", ".join(f"({i}, {_sql_value(p)}, {_sql_value(u)}::DOUBLE, {_sql_value(o)})" for i, (_, p, u, o) in enumerate(_EDGE) if p)
    + f") t(k, predicted, unsafe_confidence, confidence_source) ON event_id % {len(_EDGE)} = k"
)
def confidence_derivation(spark, sf_dir):
    """Unsafe confidence of records of every kind: direct, complement, derived, unparsable, boolean, array, malformed."""
    line = F.element_at(F.array(*(F.lit(e[0]) for e in _EDGE)), (F.col("event_id") % len(_EDGE) + 1).cast("int"))
    got = records.normalise(events(spark, sf_dir).select("event_id", line.alias("value")))
    return got.select("event_id", "predicted", even(F.col("unsafe_confidence"), 6).alias("unsafe_confidence"), "confidence_source")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE ELSE NULL END AS value FROM events")
def first_parsable_conf(spark, sf_dir):
    k = F.col("event_id") % 3
    a = F.when(k == 0, F.col("value").cast("string")).otherwise("n/a")
    b = F.when(k == 1, F.col("user_id").cast("string"))
    return events(spark, sf_dir).select("event_id", records.first_parsable(a, b).alias("value"))


@query("SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN (user_id % 3)::DOUBLE ELSE value END AS value FROM events")
def truthy_fallback(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", records.truthy((F.col("user_id") % 3).cast("double"), F.col("value")).alias("value"))


@query(
    "SELECT doc_id, CASE WHEN contains(lower(source || '_qlora_ft.jsonl'), 'zero_shot') THEN 'zero-shot' WHEN doc_id % 2 = 0 THEN 'fine-tuned' ELSE source || '.jsonl' END AS experiment FROM documents"
)
def experiment_label(spark, sf_dir):
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_qlora_FT.jsonl").otherwise(".jsonl"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", records.experiment(name).alias("experiment"))


_SOFTMAX = """e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS p FROM embeddings),
s AS (SELECT vec_id, list_transform(p, lambda x: x / list_reduce(list_prepend(0.0::DOUBLE, p), lambda a, b: a + b)) AS s FROM e)"""


def _shares(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", records.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))


@query(f"WITH {_SOFTMAX} SELECT vec_id, {_even('(s[4] + s[11]) / (s[4] + s[11] + (s[6] + s[18]))', 8)} AS safe, {_even('(s[6] + s[18]) / (s[4] + s[11] + (s[6] + s[18]))', 8)} AS unsafe FROM s")
def softmax_class_probs(spark, sf_dir):
    safe, unsafe = records.class_probabilities(F.col("s"), [3, 10], [5, 17])
    return _shares(spark, sf_dir).select("vec_id", even(safe, 8).alias("safe"), even(unsafe, 8).alias("unsafe"))


@query(f"WITH {_SOFTMAX} SELECT vec_id, {_even('s[4]', 8)} AS safe, {_even('s[6]', 8)} AS unsafe, s[4] < 1e-9 AND s[6] < 1e-9 AS failed FROM s")
def softmax_two_token(spark, sf_dir):
    safe, unsafe, failed = records.token_probabilities(F.col("s"), 3, 5)
    return _shares(spark, sf_dir).select("vec_id", even(safe, 8).alias("safe"), even(unsafe, 8).alias("unsafe"), failed.alias("failed"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN 'UNSAFE' ELSE 'SAFE' END AS label FROM events")
def decode_label(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("Safe.", "it is unsafe", " UNSAFE\n", "no idea"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", records.decode_label(said).alias("label"))


_PROMPT = (
    "'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '" + records.INSTRUCTION + "<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)"
    " || 'Language: ' || coalesce(lang, 'en') || chr(10) || 'Content: ' || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
)


@query(f"SELECT doc_id, md5({_PROMPT}) AS digest FROM documents")
def prompt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(records.prompt(F.col("text"), F.col("lang")).cast("binary")).alias("digest"))


# ---- windows -------------------------------------------------------------------------------------------------------


@query(f"WITH {_windows(200)} SELECT stream, idx, CASE WHEN uc >= 0.5 THEN 'UNSAFE' ELSE 'SAFE' END AS key, count(*) AS n FROM a GROUP BY 1, 2, 3")
def window_label_counts(spark, sf_dir):
    return windows.value_counts(windows.assign(bindings.stream(spark, sf_dir), 200, 200), "predicted")


@query("SELECT 'events' AS stream, event_type AS key, count(*) AS n, 0::BIGINT AS idx FROM events GROUP BY event_type")
def source_counts(spark, sf_dir):
    return windows.value_counts(bindings.predictions(spark, sf_dir).withColumn("idx", F.lit(0).cast("long")), "source")


_QUANTILE = f"""{_windows(200)}, ed AS (SELECT list_sort(list_distinct(quantile_cont(uc, [k / 20.0::DOUBLE FOR k IN range(0, 21)]))) AS e FROM a WHERE idx = 0),
cells AS (SELECT idx, CASE WHEN uc BETWEEN e[1] AND e[-1] THEN least(len([x FOR x IN e IF x <= uc]) - 1, len(e) - 2) END AS bin, count(*) AS n FROM a CROSS JOIN ed GROUP BY 1, 2),
h AS (SELECT i.idx, b.bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT idx FROM a) i CROSS JOIN (SELECT unnest(range(0, len(e) - 1)) AS bin FROM ed) b
  LEFT JOIN cells c ON c.idx = i.idx AND c.bin = b.bin)"""


@query(f"WITH {_QUANTILE} SELECT 'events' AS stream, idx, bin, n FROM h")
def hist_quantile(spark, sf_dir):
    hist = windows.histograms_by_quantile(windows.assign(bindings.stream(spark, sf_dir), 200, 200), 20)
    return hist.select("stream", "idx", F.posexplode("counts").alias("bin", "n"))


# ---- grid ----------------------------------------------------------------------------------------------------------

_AXES = grid.Axes(sizes=(100, 200, 1000), bins=(10, 20), binnings=("equal_width",), steps=(1.0,), modes=("fixed_first", "rolling", "adaptive_clean"))
_POINT = 5000


def _streams(spark, sf_dir):
    """``events`` as one stream and the first hours of each user group as short ones would be: documents by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 1000")
    short = docs.select(F.lit("documents").alias("stream"), F.col("doc_id").alias("pos"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(100.0)).alias("uc"))
    rows = bindings.stream(spark, sf_dir).select("stream", "pos", "uc").unionByName(short)
    return rows, spark.createDataFrame([("events", _POINT), ("documents", None)], "stream string, drift_point long")


def _grid(spark, sf_dir):
    return grid.results(*_streams(spark, sf_dir), _AXES)


_RULE_SQL = """CASE rule WHEN 'KL_only' THEN kl >= 0.05 WHEN 'KS_only' THEN ks_p < 0.05 WHEN 'KL_AND_KS' THEN kl >= 0.05 AND ks_p < 0.05 WHEN 'JS_only' THEN js >= 0.03
  WHEN 'Wasserstein_only' THEN w1 >= 0.05 ELSE (kl >= 0.05)::INT + (ks_p < 0.05)::INT + (js >= 0.03)::INT + (w1 >= 0.05)::INT >= 2 END"""
#: All pairs of windows of a stream and size, their metrics, and the walk of the adaptive reference.
_PAIRS = f"""{_BASE}, rows AS (SELECT stream, pos, uc FROM base UNION ALL SELECT 'documents', doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE FROM documents WHERE doc_id < 1000),
lens AS (SELECT stream, count(*) AS n_records, count(DISTINCT round(uc, 6)) = 1 AS constant FROM rows GROUP BY stream),
shape AS (SELECT unnest([100, 200, 1000]) AS w),
win AS (SELECT r.stream, w, pos // w AS idx, uc AS v, pos FROM rows r JOIN lens USING (stream) JOIN shape ON n_records >= 2 * w),
sized AS (SELECT stream, w, idx, count(*) AS n, min(pos) AS start, max(pos) AS "end" FROM win GROUP BY ALL HAVING count(*) >= greatest(5, w // 10)),
vals AS (SELECT stream, w, idx, v, count(*) AS c FROM win GROUP BY ALL),
pairs AS (SELECT a.stream, a.w, a.idx AS ref, b.idx, a.n AS n1, b.n AS n2, b.start, b."end" FROM sized a JOIN sized b ON a.stream = b.stream AND a.w = b.w AND a.idx < b.idx),
merged AS (SELECT p.stream, p.w, p.ref, p.idx, v, sum(c) FILTER (x.idx = p.ref) AS r, sum(c) FILTER (x.idx = p.idx) AS q FROM pairs p JOIN vals x ON x.stream = p.stream AND x.w = p.w AND x.idx IN (p.ref, p.idx) GROUP BY ALL),
run AS (SELECT stream, w, ref, idx, v, sum(coalesce(r, 0)) OVER o AS cr, sum(coalesce(q, 0)) OVER o AS cw, lead(v) OVER o AS nx FROM merged WINDOW o AS (PARTITION BY stream, w, ref, idx ORDER BY v)),
far AS (SELECT p.stream, p.w, p.ref, p.idx, p.n1, p.n2, p.start, p."end", max(abs(cr * n2 - cw * n1))::BIGINT AS k,
  coalesce(sum(abs(cr * n2 - cw * n1)::DECIMAL(16, 0) * (nx - v)::DECIMAL(14, 10))::DOUBLE, 0) / max(n1 * n2)::DOUBLE AS w1 FROM run JOIN pairs p USING (stream, w, ref, idx) GROUP BY ALL),
ps AS (SELECT DISTINCT n1, k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END *
  list_product([((n1 - j * (k // n1) + 1 + i)::DOUBLE / (n1 + 1 + i)) FOR i IN range(0, j * (k // n1))]) FOR j IN range(1, n1 // (k // n1) + 1)])) END AS ks_p FROM (SELECT DISTINCT n1, k FROM far)),
nb AS (SELECT unnest([10, 20]) AS bins),
cells AS (SELECT stream, w, idx, bins, least(len([k FOR k IN range(0, bins + 1) IF CASE WHEN k = bins THEN 1.0 ELSE k * (1.0::DOUBLE / bins) END <= v]) - 1, bins - 1) AS bin, sum(c) AS c FROM vals CROSS JOIN nb GROUP BY ALL),
dense AS (SELECT s.stream, s.w, s.idx, bins, bin, coalesce(c, 0) / n::DOUBLE AS p FROM sized s CROSS JOIN (SELECT bins, unnest(range(0, bins)) AS bin FROM nb) LEFT JOIN cells USING (stream, w, idx, bins, bin)),
pq AS (SELECT p.stream, p.w, p.ref, p.idx, a.bins, a.bin, a.p, b.p AS q, greatest(a.p, 1e-10) AS cp, greatest(b.p, 1e-10) AS cq, greatest((a.p + b.p) / 2, 1e-10) AS m
  FROM pairs p JOIN dense a ON a.stream = p.stream AND a.w = p.w AND a.idx = p.ref JOIN dense b ON b.stream = p.stream AND b.w = p.w AND b.idx = p.idx AND b.bins = a.bins AND b.bin = a.bin),
tot AS (SELECT stream, w, ref, idx, bins, sum(cp) AS sp, sum(cq) AS sq FROM pq GROUP BY ALL),
div AS (SELECT stream, w, ref, idx, bins, sum(cp / sp * ln((cp / sp) / (cq / sq))) AS kl, sum(cp * ln(cp / m) + cq * ln(cq / m)) / 2 AS js FROM pq JOIN tot USING (stream, w, ref, idx, bins) GROUP BY ALL),
m AS (SELECT far.*, ks_p, bins, kl, js FROM far JOIN ps ON ps.n1 = far.n1 AND ps.k = far.k JOIN div USING (stream, w, ref, idx)),
flag AS (SELECT m.*, rule, rn, {_RULE_SQL} AS drift FROM m CROSS JOIN (SELECT unnest({list(decisions.RULES)}) AS rule, unnest(range(0, 6)) AS rn)),
walk AS (SELECT stream, w, bins, rule, idx, ref, drift, 0 AS nth FROM flag WHERE idx = 1 AND ref = 0 UNION ALL
  SELECT f.stream, f.w, f.bins, f.rule, f.idx, f.ref, f.drift, walk.nth + (NOT walk.drift)::INT FROM walk JOIN flag f ON f.stream = walk.stream AND f.w = walk.w AND f.bins = walk.bins AND f.rule = walk.rule
  AND f.idx = walk.idx + 1 AND f.ref = CASE WHEN walk.drift THEN walk.ref ELSE walk.idx END),
used AS (SELECT *, 'fixed_first' AS mode, 0 AS mn FROM flag WHERE ref = 0 UNION ALL SELECT *, 'rolling', 1 FROM flag WHERE ref = idx - 1
  UNION ALL SELECT f.*, 'adaptive_clean', 2 FROM flag f JOIN walk USING (stream, w, bins, rule, idx, ref)),
agg AS (SELECT stream, w, bins, mode, rule, bool_or(drift) AS drift_detected, min(idx - 1) FILTER (drift) AS first_detection_window,
  count(*) FILTER (stream = 'events' AND drift AND "end" < {_POINT}) AS false_alarm_count_before_drift, coalesce(bool_or(stream = 'events' AND drift AND start >= {_POINT}), false) AS true_detection_after_drift,
  max({_even('kl', 6)}) AS max_kl, min({_even('ks_p', 6)}) AS min_ks_pvalue, max({_even('js', 6)}) AS max_js, max({_even('w1', 6)}) AS max_wasserstein, count(*) AS n_windows FROM used GROUP BY ALL),
axes AS (SELECT w, bins, mode, rule, ((CASE w WHEN 100 THEN 0 WHEN 200 THEN 1 ELSE 2 END * 2 + CASE bins WHEN 10 THEN 0 ELSE 1 END) * 3 + mn) * 6 + rn AS ord FROM shape CROSS JOIN nb
  CROSS JOIN (SELECT unnest(['fixed_first', 'rolling', 'adaptive_clean']) AS mode, unnest(range(0, 3)) AS mn) CROSS JOIN (SELECT unnest({list(decisions.RULES)}) AS rule, unnest(range(0, 6)) AS rn)),
g AS (SELECT l.stream AS stream_name, x.rule AS detector_rule, x.w AS window_size, x.w AS step_size, 1.0::DOUBLE AS step_fraction, x.bins, 'equal_width' AS binning, x.mode AS reference_mode,
  true AS calibrated_threshold_used, drift_detected, first_detection_window, CASE WHEN l.stream = 'events' THEN first_detection_window - greatest(0, ({_POINT} - x.w) // x.w) END AS detection_delay,
  false_alarm_count_before_drift, true_detection_after_drift, max_kl, min_ks_pvalue, max_js, max_wasserstein, coalesce(n_windows, 0) AS n_windows, n_records,
  CASE WHEN n_records >= 2 * x.w THEN constant END AS constant_confidence_warning,
  CASE WHEN n_records < 2 * x.w THEN 'n_records(' || n_records || ') < window_size*2(' || 2 * x.w || ')' END AS skip_reason, ord
  FROM lens l CROSS JOIN axes x LEFT JOIN agg ON agg.stream = l.stream AND agg.w = x.w AND agg.bins = x.bins AND agg.mode = x.mode AND agg.rule = x.rule)"""
_WITH = f"WITH RECURSIVE {_PAIRS} "
_ABLATION = "window_size = 200 AND bins = 20 AND binning = 'equal_width' AND step_fraction = 1.0 AND drift_detected IS NOT NULL"


@query(_WITH + f"""SELECT stream, idx, bins, rule AS detector_rule, ref AS reference_idx, nth AS reference_window_idx, drift, {_even('kl', 6)} AS kl, {_even('ks_p', 6)} AS ks_p
FROM flag JOIN walk USING (stream, w, bins, rule, idx, ref, drift) WHERE w = 200""")
def ref_adaptive_clean(spark, sf_dir):
    """Each window against the last one without drift."""
    rows, _ = _streams(spark, sf_dir)
    axes = grid.Axes(sizes=(200,), bins=(10, 20), binnings=("equal_width",), steps=(1.0,), modes=("adaptive_clean",))
    got = grid.fold(grid.arrays(rows, axes), axes)
    return got.select("stream", "idx", "bins", "detector_rule", "reference_idx", "reference_window_idx", "drift", even(F.col("kl"), 6).alias("kl"), even(F.col("ks_p"), 6).alias("ks_p"))


@query("""SELECT ord, w AS window_size, b AS bins, k AS binning, s AS step_fraction, greatest(1, (w * s)::INT) AS step_size, m AS reference_mode, r AS detector_rule FROM (
  SELECT (((((wi * 4 + bi) * 2 + ki) * 2 + si) * 4 + mi) * 6 + ri)::BIGINT AS ord, * FROM (SELECT unnest([50, 100, 200, 500]) AS w, unnest(range(0, 4)) AS wi)
  CROSS JOIN (SELECT unnest([10, 20, 30, 50]) AS b, unnest(range(0, 4)) AS bi) CROSS JOIN (SELECT unnest(['equal_width', 'quantile']) AS k, unnest(range(0, 2)) AS ki)
  CROSS JOIN (SELECT unnest([1.0, 0.5])::DOUBLE AS s, unnest(range(0, 2)) AS si) CROSS JOIN (SELECT unnest(['fixed_first', 'rolling', 'multi_reference', 'adaptive_clean']) AS m, unnest(range(0, 4)) AS mi)
  CROSS JOIN (SELECT unnest(['KL_only', 'KS_only', 'KL_AND_KS', 'JS_only', 'Wasserstein_only', 'Ensemble_majority']) AS r, unnest(range(0, 6)) AS ri))""")
def grid_axes(spark, sf_dir):
    """The 1,536 configurations of the whole grid."""
    return grid.Axes().table(spark)


@query(_WITH + "SELECT * FROM g")
def grid_results(spark, sf_dir):
    """Every configuration on every stream, skipped ones included."""
    return _grid(spark, sf_dir)


@query(_WITH + "SELECT stream_name, ord, n_records, window_size, skip_reason FROM g WHERE skip_reason IS NOT NULL")
def skip_rows(spark, sf_dir):
    return _grid(spark, sf_dir).where("skip_reason is not null").select("stream_name", "ord", "n_records", "window_size", "skip_reason")


@query(_WITH + "SELECT * FROM g WHERE drift_detected IS NOT NULL")
def sensitivity(spark, sf_dir):
    return grid.sensitivity(_grid(spark, sf_dir))


@query(_WITH + f"SELECT * FROM g WHERE {_ABLATION}")
def ablation(spark, sf_dir):
    return grid.ablation(_grid(spark, sf_dir))


@query(_WITH + f"SELECT * FROM g WHERE {_ABLATION} AND detector_rule = 'Ensemble_majority' AND reference_mode = 'fixed_first'")
def primary_config(spark, sf_dir):
    return grid.primary(_grid(spark, sf_dir))


_CELL = "max(CASE WHEN detector_rule = '{r}' THEN CASE WHEN true_detection_after_drift THEN '✓' WHEN drift_detected THEN 'FA' ELSE '—' END END)"


@query(_WITH + "SELECT reference_mode, stream_name, " + ", ".join(f"coalesce({_CELL.format(r=r)}, 'N/A') AS \"{r}\"" for r in decisions.RULES) + f" FROM g WHERE {_ABLATION} GROUP BY 1, 2")
def ablation_matrix(spark, sf_dir):
    return grid.matrix(grid.ablation(_grid(spark, sf_dir)))


@query(_WITH + """SELECT * FROM g WHERE drift_detected IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream_name ORDER BY (NOT true_detection_after_drift)::INT, (detection_delay IS NULL)::INT,
  coalesce(detection_delay, 0), CASE WHEN detection_delay IS NULL THEN 0 ELSE false_alarm_count_before_drift END, ord) = 1""")
def best_config(spark, sf_dir):
    return grid.best_per_stream(_grid(spark, sf_dir))


@query(_WITH + f"""SELECT detector_rule, count(*) FILTER (stream_name = 'events' AND true_detection_after_drift) || '/' || count(*) FILTER (stream_name = 'events') AS detected_drift_streams,
  CASE WHEN coalesce(bool_or(stream_name <> 'events' AND drift_detected), false) THEN 'Yes' ELSE 'No' END AS iid_control_false_alarm, sum(false_alarm_count_before_drift)::BIGINT AS total_false_alarms_before_drift,
  {_even('avg(detection_delay)', 2)} AS mean_detection_delay_windows FROM g WHERE {_ABLATION} AND reference_mode = 'fixed_first' GROUP BY 1""")
def rule_ablation_summary(spark, sf_dir):
    return grid.rule_summary(_grid(spark, sf_dir), F.col("stream_name") == "events")


# ---- synthesis -----------------------------------------------------------------------------------------------------

_N = 2000


def _draw(name: str, *at: str) -> str:
    parts = ", ".join(("'42'", f"'{name}'", *at))
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_RECORDS = f"""{_BASE}, rec AS (SELECT event_id AS rid, language, CASE WHEN uc >= 0.5 THEN 'UNSAFE' ELSE 'SAFE' END AS predicted, source, uc FROM base)"""


def _picked(name: str, pools: dict[str, str], pool: str, place: str = "pos", least: dict[str, float] | None = None) -> str:
    """CTE ``got``: a record for each place; an empty or too small pool is all records."""
    sizes = ", ".join(f"count(*) FILTER ({c}) AS n_{p}" for p, c in pools.items())
    union = " UNION ALL ".join(f"SELECT rec.*, '{p}' AS pool FROM rec CROSS JOIN sz WHERE ({c}) OR n_{p} = 0 OR n_{p} < {(least or {}).get(p, 0)}" for p, c in pools.items())
    return f"""{_RECORDS}, sz AS (SELECT {sizes} FROM rec), pl AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rid) - 1 AS nth, count(*) OVER (PARTITION BY pool) AS m FROM ({union})),
pls AS (SELECT pool, max(m) AS m FROM pl GROUP BY pool), asked AS (SELECT pos AS {place}, {pool} AS pool FROM (SELECT unnest(range(0, {_N})) AS pos)),
got AS (SELECT {place}, pl.* EXCLUDE (pool, nth, m) FROM asked JOIN pls USING (pool) JOIN pl ON pl.pool = asked.pool AND pl.nth = floor({_draw(name, place, "'pick'")} * pls.m)::BIGINT)"""


_PRE, _POST = "lower(language) IN ('en', 'ms')", "lower(language) IN ('zh', 'ta', 'zh-cn', 'zh-tw')"
_COLS = f"rid, language, predicted, source, {_even('uc', 6)} AS uc"


def _stream_sql(name: str, ctes: str, pos: str = "pos", tail: str = "") -> str:
    return f"WITH {ctes} SELECT '{name}' AS stream_name, {pos} AS pos, {_COLS} FROM got {tail}"


_STREAM_SQL = {
    "language_sudden": _stream_sql("language_sudden", _picked("language_sudden", {"pre": _PRE, "post": _POST}, "CASE WHEN pos < 1000 THEN 'pre' ELSE 'post' END", least={"pre": 500, "post": 500})),
    "language_gradual": _stream_sql(
        "language_gradual", _picked("language_gradual", {"pre": _PRE, "post": _POST}, f"CASE WHEN {_draw('language_gradual', 'pos', chr(39) + 'side' + chr(39))} < pos / 2000.0::DOUBLE * 0.8::DOUBLE THEN 'post' ELSE 'pre' END")
    ),
    "class_prior_sudden": f"""WITH {_picked('class_prior_sudden', {'safe': "predicted = 'SAFE'", 'unsafe': "predicted = 'UNSAFE'"}, "CASE WHEN pos < 500 OR pos >= 1800 THEN 'safe' ELSE 'unsafe' END", 'slot')}
SELECT 'class_prior_sudden' AS stream_name, (slot >= 1000)::INT * 1000 + row_number() OVER (PARTITION BY slot >= 1000 ORDER BY {_draw('class_prior_sudden', 'slot', "'order'")}, slot) - 1 AS pos, {_COLS} FROM got""",
    "class_prior_gradual": _stream_sql(
        "class_prior_gradual",
        _picked("class_prior_gradual", {"safe": "predicted = 'SAFE'", "unsafe": "predicted = 'UNSAFE'"}, f"CASE WHEN {_draw('class_prior_gradual', 'pos', chr(39) + 'side' + chr(39))} < pos / 2000.0::DOUBLE * 0.4::DOUBLE + 0.3::DOUBLE THEN 'unsafe' ELSE 'safe' END"),
    ),
    "source_sudden": _stream_sql(
        "source_sudden",
        _picked(
            "source_sudden",
            {p: f"rec.source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT source FROM rec)) WHERE {c})" for p, c in (("pre", "r <= c // 2"), ("post", "r > c // 2"))},
            "CASE WHEN pos < 1000 THEN 'pre' ELSE 'post' END",
        ).replace("count(*) FILTER (rec.source IN (SELECT", "count(*) FILTER (source IN (SELECT"),
    ),
    "iid_control": f"""WITH {_RECORDS}, cl AS (SELECT *, language || '|' || predicted AS cell, row_number() OVER (PARTITION BY language, predicted ORDER BY rid) - 1 AS nth, count(*) OVER (PARTITION BY language, predicted) AS size,
  count(*) OVER () AS total FROM rec), sl AS (SELECT cell, size, unnest(range(0, round_even(size / total::DOUBLE * {_N}, 0)::BIGINT)) AS slot FROM (SELECT DISTINCT cell, size, total FROM cl)),
dr AS (SELECT cell, slot, floor({_draw('iid_control', 'cell', 'slot', "'pick'")} * size)::BIGINT AS nth, {_draw('iid_control', 'cell', 'slot', "'order'")} AS o FROM sl)
SELECT 'iid_control' AS stream_name, row_number() OVER (ORDER BY o, cell, slot) - 1 AS pos, {_COLS} FROM dr JOIN cl USING (cell, nth) QUALIFY pos < {_N}""",
}
for _name, _delta in (("confidence_shift_sudden", "CASE WHEN pos < 1000 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END"), ("confidence_shift_gradual", "pos / 2000.0::DOUBLE * 0.3::DOUBLE")):
    _STREAM_SQL[_name] = f"""WITH {_picked(_name, {'all': 'true'}, "'all'")}, c AS (SELECT count(DISTINCT round(uc, 4)) = 1 AS constant FROM got)
SELECT '{_name}' AS stream_name, pos, rid, language, predicted, source, {_even(f"least(greatest(coalesce(uc, 0.5::DOUBLE) + CASE WHEN constant THEN {_draw(_name, 'pos', chr(39) + 'noise' + chr(39))} * 0.1::DOUBLE - 0.05::DOUBLE ELSE 0 END + {_delta}, 0), 1)", 6)} AS uc FROM got CROSS JOIN c"""


def pool(spark, sf_dir):
    return bindings.predictions(spark, sf_dir).select(F.col("event_id").alias("rid"), "language", "predicted", "source", "uc")


def _stream_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pool(spark, sf_dir)
        got = synthesis.STREAMS[name](rows, synthesis.length(rows, _N))
        return got.select("stream_name", F.col("pos").cast("long").alias("pos"), "rid", "language", "predicted", "source", even(F.col("uc"), 6).alias("uc"))

    return run


for _name in synthesis.STREAMS:
    QUERIES[f"stream_{_name}"], SQL[f"stream_{_name}"] = _stream_query(_name), _STREAM_SQL[_name]

_TWO = f"SELECT * FROM ({_STREAM_SQL['language_sudden']}) UNION ALL SELECT * FROM ({_STREAM_SQL['iid_control']})"


def _two(spark, sf_dir):
    made = {n: _stream_query(n)(spark, sf_dir) for n in ("language_sudden", "iid_control")}
    points = spark.createDataFrame([(n, synthesis.drift_point(n, _N)) for n in made], "stream_name string, drift_point long")
    return calibration.all_streams(made), points


@query(f"""SELECT stream_name, CASE WHEN stream_name = 'language_sudden' AND pos >= 1000 THEN 'after' ELSE 'before' END AS side, count(*) AS n, {_even(_mean('uc'), 4)} AS confidence_mean FROM ({_TWO}) GROUP BY 1, 2""")
def mean_before_after(spark, sf_dir):
    return synthesis.profile(*_two(spark, sf_dir))


@query(" UNION ALL ".join(f"""SELECT stream_name, side, key, n, {_even('n / sum(n) OVER (PARTITION BY stream_name, side)::DOUBLE', 4)} AS share, '{f}' AS field FROM (
  SELECT stream_name, CASE WHEN stream_name = 'language_sudden' AND pos >= 1000 THEN 'after' ELSE 'before' END AS side, {f} AS key, count(*) AS n FROM ({_TWO}) GROUP BY 1, 2, 3)""" for f in ("language", "predicted")))
def stream_profile(spark, sf_dir):
    """The metadata of a stream: shares of languages and labels on both sides of its drift point."""
    return sinks.stream_profile(*_two(spark, sf_dir))


@query(f"""SELECT doc_id, {_even("CASE WHEN doc_id < m // 2 THEN 0.0::DOUBLE ELSE (doc_id - m // 2)::DOUBLE / greatest(1, m - m // 2) END", 4)} AS severity FROM documents CROSS JOIN (SELECT max(doc_id) AS m FROM documents)""")
def severity_ramp(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg(F.max("doc_id").alias("m"))  # one row
    ramp = synthesis.severity_ramp(F.col("doc_id"), F.expr("m div 2"), F.col("m"))
    return docs.crossJoin(F.broadcast(top)).select("doc_id", even(ramp, 4).alias("severity"))


def _perturb_sql(text: str, key: str, severity: str, name: str = "adversarial_text_stream") -> str:
    """A chain of CTEs t1 to t5 over ``src`` (key, text, severity)."""
    u = lambda k: _draw(name, "key", f"'{k}'")
    put = lambda at, x: f"substr(t, 1, ({at})::INT) || {x} || substr(t, ({at})::INT + 1)"
    size = "greatest(length(t), 1)"
    one = lambda items, k: f"([{', '.join(chr(39) + i + chr(39) for i in items)}])[floor({u(k)} * {len(items)})::INT + 1]"
    leet = "CASE lower(c) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in synthesis.LEET.items()) + " ELSE c END"
    steps = [
        (0.4, "symbol", put(f"floor({u('symbol at')} * {size})", one(synthesis.SYMBOLS, "symbol which"))),
        (0.4, "double", put(f"floor({u('double at')} * {size})", f"substr(t, floor({u('double at')} * {size})::INT + 1, 1)")),
        (0.3, "emoji", put(f"floor({u('emoji at')} * (length(t) + 1))", one(synthesis.EMOJI, "emoji which"))),
        (0.2, "leet", f"array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN (floor({u('leet at')} * 65536)::BIGINT + i * 40503) % 65536 < 19660.8 THEN {leet} ELSE c END), '')"),
        (0.2, "mark", f"{one(synthesis.MARKERS, 'mark which')} || t"),
    ]
    out = f"t0 AS (SELECT *, {text} AS t FROM src)"
    for i, (chance, k, made) in enumerate(steps):
        out += f", t{i + 1} AS (SELECT * EXCLUDE (t), CASE WHEN {u(k)} < {severity} * {chance}::DOUBLE THEN {made} ELSE t END AS t FROM t{i})"
    return out


@query(f"""WITH src AS (SELECT doc_id AS key, text, (doc_id % 11) / 10.0::DOUBLE AS severity FROM documents), {_perturb_sql('text', 'key', 'severity')}
SELECT key AS doc_id, md5(CASE WHEN length(text) > 0 THEN t ELSE text END) AS digest FROM t5""")
def text_perturb(spark, sf_dir):
    """All document texts with edits of every severity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = synthesis.perturb(F.col("text"), F.col("doc_id") % 11 / F.lit(10.0), "adversarial_text_stream", F.col("doc_id"))
    return docs.select("doc_id", F.md5(made.cast("binary")).alias("digest"))


# ---- calibration ---------------------------------------------------------------------------------------------------

_TIMES = 20
_NULL = f"""{_BASE}, rk AS (SELECT turn, uc, row_number() OVER (PARTITION BY turn ORDER BY {_draw('bootstrap', 'turn', 'event_id')}, event_id) AS rn FROM base CROSS JOIN (SELECT unnest(range(0, {_TIMES})) AS turn)),
x AS (SELECT turn, (rn > 200)::INT AS idx, uc AS v FROM rk WHERE rn <= 400),
bo AS (SELECT turn, v, count(*) FILTER (idx = 0) AS r, count(*) FILTER (idx = 1) AS q FROM x GROUP BY ALL),
ru AS (SELECT turn, v, sum(r) OVER o AS cr, sum(q) OVER o AS cw, lead(v) OVER o AS nx FROM bo WINDOW o AS (PARTITION BY turn ORDER BY v)),
fa AS (SELECT turn, max(abs(cr * 200 - cw * 200)) / 40000.0::DOUBLE AS ks_stat, sum(abs(cr * 200 - cw * 200)::DECIMAL(16, 0) * (nx - v)::DECIMAL(14, 10))::DOUBLE / 40000.0::DOUBLE AS wasserstein FROM ru GROUP BY turn),
ce AS (SELECT turn, {_bin('v')} AS bin, count(*) FILTER (idx = 0) / 200.0::DOUBLE AS p, count(*) FILTER (idx = 1) / 200.0::DOUBLE AS q FROM x GROUP BY ALL),
de AS (SELECT turn, bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT unnest(range(0, {_TIMES})) AS turn) CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) LEFT JOIN ce USING (turn, bin)),
cl AS (SELECT *, greatest(p, 1e-10) AS cp, greatest(q, 1e-10) AS cq, greatest((p + q) / 2, 1e-10) AS m FROM de),
no AS (SELECT *, cp / sum(cp) OVER (PARTITION BY turn) AS np, cq / sum(cq) OVER (PARTITION BY turn) AS nq FROM cl),
di AS (SELECT turn, sum(np * ln(np / nq)) AS kl, sum(cp * ln(cp / m) + cq * ln(cq / m)) / 2 AS js FROM no GROUP BY turn),
nul AS (SELECT turn AS replicate, kl, js, ks_stat, wasserstein FROM di JOIN fa USING (turn))"""


def _null(spark, sf_dir):
    return calibration.null_distribution(pool(spark, sf_dir).select("rid", "uc"), _TIMES)


@query(f"WITH {_NULL} SELECT replicate, {', '.join(f'{_even(m, 6)} AS {m}' for m in calibration.METRICS)} FROM nul")
def calibrate_null(spark, sf_dir):
    """Metrics of pairs of windows drawn from the whole stream."""
    return _null(spark, sf_dir).select("replicate", *[even(F.col(m), 6).alias(m) for m in calibration.METRICS])


@query(f"""WITH {_NULL}, l AS (UNPIVOT nul ON kl, js, wasserstein, ks_stat INTO NAME metric VALUE v)
SELECT metric, {_even('quantile_cont(v, 0.95)', 6)} AS threshold, {', '.join(f"{_even(f'quantile_cont(v, {p / 100})', 6)} AS p{p}" for p in calibration.PERCENTILES)}, {_even(_mean('v'), 6)} AS mean_null,
  {_even(f"sqrt(greatest({_squares('v')} - sum(v::DECIMAL(14, 10))::DOUBLE * sum(v::DECIMAL(14, 10))::DOUBLE / count(v)::DOUBLE, 0) / count(v)::DOUBLE)", 6)} AS std_null FROM l GROUP BY metric""")
def calibrate_thresholds(spark, sf_dir):
    return calibration.thresholds(_null(spark, sf_dir))


@query("""SELECT 'kl' AS name, 0.6::DOUBLE AS value UNION ALL SELECT 'kl_critical', 3 * 0.6::DOUBLE UNION ALL SELECT 'alpha', 0.05 UNION ALL SELECT 'js', 0.03 UNION ALL SELECT 'wasserstein', 0.07""")
def threshold_overlay(spark, sf_dir):
    """Defaults under the keys that a file sets."""
    path = fresh(spark, "thresholds")
    spark.createDataFrame([('{"kl_threshold_95": 0.6, "wasserstein_threshold_95": 0.07, "other": 1}',)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(sorted(jsonl.load_thresholds(spark, path).items()), "name string, value double")


# ---- files ---------------------------------------------------------------------------------------------------------


def _file(spark, sf_dir, name: str = "predictions") -> str:
    """``events`` as JSON lines in files of the shared folder, every 50th malformed."""
    path = fresh(spark, name)
    bindings.json_lines(spark, sf_dir).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return path


@query("""SELECT predicted, confidence_source, count(*) AS n, round_even(sum(c::DECIMAL(14, 10))::DOUBLE * 1e4, 0) / 1e4 AS total FROM (SELECT
  (['UNSAFE', 'SAFE', 'UNSAFE', 'MAYBE'])[user_id % 4 + 1] AS predicted, CASE WHEN event_id % 3 < 2 THEN 'direct_unsafe_probability' ELSE 'derived_from_pred_confidence' END AS confidence_source,
  CASE WHEN event_id % 3 = 1 OR (event_id % 3 = 2 AND user_id % 4 = 1) THEN 1 - least(value / 100, 1) ELSE least(value / 100, 1) END AS c FROM events WHERE event_id % 50 <> 7) GROUP BY ALL""")
def scan_normalised(spark, sf_dir):
    """Files scanned with bad lines dropped, by label and origin."""
    got = jsonl.load(spark, _file(spark, sf_dir))
    total = F.sum(F.col("unsafe_confidence").cast("decimal(14,10)")).cast("double")
    return got.groupBy("predicted", "confidence_source").agg(F.count(F.lit(1)).alias("n"), even(total, 4).alias("total"))


@query("SELECT count(*) FILTER (event_id % 50 <> 7) AS n, count(*) FILTER (event_id % 50 = 7) AS parse_errors, 'id,pred,safe_probability,score,unsafe_probability' AS columns FROM events")
def scan_audit(spark, sf_dir):
    """Rows, parse errors and the union of keys of the files."""
    got = jsonl.load_counting(spark, _file(spark, sf_dir))
    keys = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))), ",")
    return got.agg(F.sum("n").alias("n"), F.sum("parse_errors").alias("parse_errors"), keys.alias("columns"))


@query("SELECT event_id, user_id, event_type FROM events")
def scan_strict(spark, sf_dir):
    """A strict scan of well-formed lines with a schema."""
    path = fresh(spark, "strict")
    events(spark, sf_dir).select("event_id", "user_id", "event_type").write.json(path)
    return jsonl.load_strict(spark, path, "event_id long, user_id long, event_type string")


_FILES = ("a.jsonl", "a_meta.json", "b.jsonl", "adversarial_text_stream_input.jsonl", "c_meta.jsonl", "notes.txt")


@query("SELECT name, name IN ('a.jsonl', 'b.jsonl') AS is_stream FROM (VALUES " + ", ".join(f"('{n}')" for n in _FILES) + ") t(name)")
def stream_discovery(spark, sf_dir):
    """Which files of a folder are streams."""
    return spark.createDataFrame([(n,) for n in _FILES], "name string").select("name", jsonl.is_stream(F.col("name")).alias("is_stream"))


@query("SELECT event_id::VARCHAR AS id FROM events WHERE event_id % 2 = 0 EXCEPT SELECT event_id::VARCHAR FROM events WHERE event_id % 3 = 0")
def resume_antijoin(spark, sf_dir):
    """Rows to score that an earlier run's file doesn't hold."""
    path = fresh(spark, "done")
    ids = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "event_id")
    sinks.append_lines(ids.where("event_id % 3 = 0").select("id"), path)
    return scoring.pending(ids.where("event_id % 2 = 0").select("id"), jsonl.completed_ids(spark, path))


@query("SELECT 5::BIGINT AS n, false AS found UNION ALL SELECT 5, true")
def header_sniff(spark, sf_dir):
    """Do a file's first lines have a confidence column?"""
    out = None
    for k, name in enumerate(("score", "unsafe_confidence")):
        path = fresh(spark, f"header{k}")
        rows = spark.range(5).coalesce(1).select(F.concat(F.lit(f'{{"id":1,"{name}":'), F.col("id"), F.lit("}")).alias("value"))
        rows.write.text(path)
        got = jsonl.has_column(spark, path).select(F.lit(5).cast("long").alias("n"), "found")
        out = got if out is None else out.unionAll(got)
    return out


def _audited(spark, sf_dir):
    """Each event type as a file of its own with audit fields; two named for other checks."""
    e = bindings.predictions(spark, sf_dir)
    name = F.concat(F.when(F.col("source") == "click", "phase2_").when(F.col("source") == "view", "xlmr_").otherwise(""), "source", F.lit(".jsonl"))
    half = F.when(F.col("source") == "click", 0.5).otherwise(F.col("uc"))
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("language").alias("lang"), F.col("predicted").alias("pred_label"), half.alias("pred_confidence"), F.col("uc").alias("unsafe_probability")))
    rows = e.select(name.alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 100 == 3, "{bad").otherwise(line).alias("value"))
    return audit.audit_files(rows)


_AUDIT = f"""{_BASE}, f AS (SELECT CASE source WHEN 'click' THEN 'phase2_' WHEN 'view' THEN 'xlmr_' ELSE '' END || source || '.jsonl' AS file, CASE WHEN source = 'click' THEN 0.5::DOUBLE ELSE uc END AS pc, uc, event_id % 100 <> 3 AS good, language FROM base),
s AS (SELECT file, count(*) FILTER (good) AS n_rows, count(*) FILTER (NOT good) AS parse_errors, {_even(_mean('CASE WHEN good THEN pc END'), 6)} AS pred_mean, {_even(_mean('CASE WHEN good THEN uc END'), 6)} AS unsafe_mean,
  count(DISTINCT round(pc, 6)) FILTER (good) AS pred_unique, count(DISTINCT round(pc, 4)) FILTER (good) AS pred4, min(pc) FILTER (good) AS low, count(DISTINCT round(uc, 6)) FILTER (good) AS unsafe_unique FROM f GROUP BY file)"""


@query(f"""WITH {_AUDIT} SELECT file, n_rows, parse_errors, pred_mean, unsafe_mean, pred_unique, unsafe_unique, file AS experiment_label, concat_ws(' | ', CASE WHEN n_rows <= 3 THEN 'CRITICAL: only ' || n_rows || ' rows' END,
  CASE WHEN NOT contains(file, 'phase2') AND n_rows NOT IN (4217, 4282) THEN 'row count mismatch: ' || n_rows END, CASE WHEN contains(file, 'phase2') AND n_rows < 400 THEN 'second phase too small: windows below ' || n_rows // 3 END,
  CASE WHEN pred_unique = 1 THEN 'pred_confidence is constant' END, CASE WHEN pred_unique = 1 AND abs(low - 0.5) < 1e-6 THEN 'STOP: pred_confidence is 0.5 in all rows' END,
  CASE WHEN unsafe_unique = 1 THEN 'unsafe_confidence is constant' END, CASE WHEN pred4 < 4 THEN 'pred_confidence has few distinct values' END, CASE WHEN contains(file, 'xlmr') THEN 'fairness: other architecture' END) AS warnings FROM s""")
def audit_files(spark, sf_dir):
    """The whole audit of files: errors, statistics and warnings."""
    got = sinks.audit_table(_audited(spark, sf_dir))
    return got.select(
        "file", "n_rows", "parse_errors", even(F.col("pred_confidence_mean"), 6).alias("pred_mean"), even(F.col("unsafe_confidence_mean"), 6).alias("unsafe_mean"),
        F.col("pred_confidence_n_unique").alias("pred_unique"), F.col("unsafe_confidence_n_unique").alias("unsafe_unique"), "experiment_label", "warnings",
    )


@query(f"WITH {_AUDIT} SELECT file, language AS key, count(*) AS n FROM f WHERE good GROUP BY ALL")
def audit_languages(spark, sf_dir):
    """Rows of each language of each audited file."""
    return _audited(spark, sf_dir).select("file", F.explode("language_distribution").alias("key", "n"))


@query(f"WITH {_AUDIT} SELECT CASE WHEN pred_unique = 1 AND abs(low - 0.5) < 1e-6 THEN 'STOP' WHEN n_rows <= 3 THEN 'CRIT' WHEN NOT contains(file, 'phase2') AND n_rows NOT IN (4217, 4282) THEN 'WARN' ELSE 'OK' END AS tag, file FROM s")
def audit_tags(spark, sf_dir):
    return sinks.audit_text(_audited(spark, sf_dir)).select("tag", "file")


# ---- sinks ---------------------------------------------------------------------------------------------------------


@query(f"SELECT pos, rid::VARCHAR AS id, language AS lang, uc FROM ({_STREAM_SQL['language_sudden']})")
def sink_streams(spark, sf_dir):
    """A stream written as JSON lines and read back in order."""
    made = _stream_query("language_sudden")(spark, sf_dir)
    rows = made.select(
        "stream_name", "pos", F.col("rid").cast("string").alias("id"), F.col("language").alias("lang"), F.lit(None).cast("string").alias("label"), F.col("predicted").alias("pred_label"),
        F.lit(None).cast("double").alias("pred_confidence"), F.col("uc").alias("unsafe_confidence"), F.lit("direct_unsafe_probability").alias("confidence_source"), "source",
        F.lit("language").alias("drift_type"), F.lit(None).cast("string").alias("text"),
    )
    path = fresh(spark, "streams")
    sinks.write_streams(rows.coalesce(1), path)
    got = jsonl.numbered(jsonl.lines(spark, path, recursive=True))
    of = F.row_number().over(Window.orderBy("file", "line")) - 1  # files are written in order of pos; the stream has 2000 rows
    field = lambda n: F.get_json_object("value", f"$.{n}")
    return got.select(of.cast("long").alias("pos"), field("id").alias("id"), field("lang").alias("lang"), field("unsafe_confidence").cast("double").alias("uc"))


@query(_WITH + "SELECT stream_name, detector_rule, window_size::VARCHAR AS window_size, reference_mode, detection_delay::VARCHAR AS detection_delay, n_windows::VARCHAR AS n_windows FROM g")
def sink_csv(spark, sf_dir):
    """The grid's table written as CSV and read back as text."""
    path = fresh(spark, "csv")
    sinks.write_csv(_grid(spark, sf_dir), path)
    got = spark.read.option("header", True).csv(path)
    return got.select("stream_name", "detector_rule", "window_size", "reference_mode", "detection_delay", "n_windows")


@query(_WITH + "SELECT stream_name, count(*) AS n, count(skip_reason) AS skipped FROM g GROUP BY 1")
def sink_reports(spark, sf_dir):
    """A JSON report for each stream, skipped rows included."""
    made = sinks.report_lines(_grid(spark, sf_dir))
    rows = F.from_json("value", "array<struct<detector_rule: string, _skip_reason: string>>")
    return made.select("stream_name", F.size(rows).cast("long").alias("n"), F.size(F.filter(rows, lambda r: r["_skip_reason"].isNotNull())).cast("long").alias("skipped"))


@query(f"WITH {_NULL} SELECT {_even('quantile_cont(kl, 0.95)', 6)} AS kl, {_even('quantile_cont(js, 0.95)', 6)} AS js, {_even('quantile_cont(wasserstein, 0.95)', 6)} AS wasserstein, 0.05::DOUBLE AS alpha, 3 * {_even('quantile_cont(kl, 0.95)', 6)} AS kl_critical FROM nul")
def sink_thresholds(spark, sf_dir):
    """The threshold document written as JSON and loaded as the detector does."""
    path = fresh(spark, "thresholds")
    table = calibration.thresholds(_null(spark, sf_dir))
    calibration.document(table, 0.05, _TIMES, 200, 20, events(spark, sf_dir).count()).coalesce(1).write.text(path)
    found = jsonl.load_thresholds(spark, path)
    return spark.createDataFrame([tuple(found[k] for k in ("kl", "js", "wasserstein", "alpha", "kl_critical"))], "kl double, js double, wasserstein double, alpha double, kl_critical double")


# ---- scoring -------------------------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT event_id, crc, crc / 4294967296.0::DOUBLE AS u FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS crc FROM events))
SELECT event_id, CASE WHEN u >= 0.5 THEN 'UNSAFE' ELSE 'SAFE' END AS pred_label, {_even('1 - u', 8)} AS safe_probability, {_even('u', 8)} AS unsafe_probability, {_even('greatest(1 - u, u)', 8)} AS pred_confidence FROM x""")
def build_row(spark, sf_dir):
    """Result rows of scored records."""
    u = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296)) / F.lit(4294967296.0)
    rows = events(spark, sf_dir).select("event_id", u.alias("u"), (F.lit(1.0) - u).alias("s"), F.when(u >= 0.5, "UNSAFE").otherwise("safe").alias("raw"))
    got = scoring.result(F.col("s"), F.col("u"), F.col("raw"))
    return rows.select("event_id", *[got[k].alias(k) for k in ("pred_label", "safe_probability", "unsafe_probability", "pred_confidence")])


@query()
def score_documents(spark, sf_dir):
    """All documents scored by the mock model in batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.lit("text").alias("modality"), F.lit(None).cast("string").alias("label"), "source")
    return scoring.score(rows).select("id", "lang", "source", "pred_label", "unsafe_confidence", "pred_confidence", "error")


@query("""WITH x AS (SELECT event_id, (value / 500)::DOUBLE AS c FROM events) SELECT event_id::VARCHAR AS id, CASE WHEN c < 0.7 AND event_id % 2 = 0 THEN 'UNSAFE' ELSE 'SAFE' END AS label,
  CASE WHEN c < 0.7 AND event_id % 2 = 0 THEN 0.95::DOUBLE ELSE c END AS confidence, 'SAFE' AS first_pass_label, c < 0.7 AND event_id % 2 = 0 AS rag_used FROM x""")
def low_conf_second_pass(spark, sf_dir):
    """Rows of low confidence take a second pass's result where there is evidence."""
    e = events(spark, sf_dir)
    first = e.select(F.col("event_id").cast("string").alias("id"), F.lit("SAFE").alias("label"), (F.col("value") / F.lit(500.0)).alias("confidence"))
    again = e.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("id"), F.lit("UNSAFE").alias("label"), F.lit(0.95).alias("confidence"))
    return scoring.second_pass(first, again)


@query("""SELECT user_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1)::INT AS rank, event_id AS evidence, value AS score FROM events QUALIFY rank < 3""")
def top_evidence(spark, sf_dir):
    """The three best events of each user."""
    return scoring.top_evidence(events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("evidence"), F.col("value").alias("score")))


@query(f"WITH {_BASE} SELECT count(uc) AS n, count(DISTINCT round(uc, 6)) AS n_unique, count(DISTINCT round(uc, 6)) > 1 AS valid FROM base")
def scoring_validity(spark, sf_dir):
    return audit.valid_scores(bindings.predictions(spark, sf_dir), "uc")


@query(f"WITH {_DECIDED} SELECT stream, rule, count(*) FILTER (drift) AS n FROM ds GROUP BY 1, 2")
def drift_counts(spark, sf_dir):
    """Drifting windows by rule."""
    got = decisions.decide(windows.metrics(bindings.stream(spark, sf_dir), bindings.SIZE))
    return got.groupBy("stream", "rule").agg(F.count_if("drift").alias("n"))

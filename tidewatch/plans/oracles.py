"""DuckDB SQL of the registered queries."""

_BASE = """base AS (
  SELECT 'events' AS stream, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, event_id, user_id, event_type AS source,
         least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS uc, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ms' WHEN 2 THEN 'zh' ELSE 'ta' END AS language
  FROM events)"""


def _windows(step: int) -> str:
    return f"""{_BASE}, starts AS (
  SELECT 0::BIGINT AS idx, 0::BIGINT AS first UNION ALL
  SELECT k + 1, 200 + k * {step} FROM (SELECT unnest(range(0, (SELECT count(*) FROM base))) AS k) WHERE 200 + k * {step} < (SELECT count(*) FROM base)),
a AS (SELECT b.*, s.idx FROM base b JOIN starts s ON b.pos >= s.first AND b.pos < s.first + 200)"""


def _even(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE)"


def _mean(x: str) -> str:
    return f"(sum({x}::DECIMAL(14, 10))::DOUBLE / count({x})::DOUBLE)"


def _squares(x: str) -> str:
    return f"sum({x}::DECIMAL(14, 10) * {x}::DECIMAL(14, 10))::DOUBLE"


def _summary(step: int) -> str:
    return f"""WITH {_windows(step)}, m AS (SELECT stream, idx, count(*) AS n, count(*) FILTER (uc IS NULL) AS n_missing, {_mean('uc')} AS mean,
  {_squares('uc')} AS squares, count(uc) AS seen, min(uc) AS min, max(uc) AS max, min(pos) AS start, max(pos) AS "end" FROM a GROUP BY stream, idx HAVING count(*) >= 20)
SELECT stream, idx, n, n_missing, {_even('mean', 4)} AS mean, {_even('sqrt(greatest(squares / seen::DOUBLE - mean * mean, 0))', 4)} AS std,
  {_even('min', 4)} AS min, {_even('max', 4)} AS max, start, "end" FROM m"""


_EDGES = "[CASE WHEN k = 20 THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / 20) END FOR k IN range(0, 21)]"


def _bin(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 1 THEN least(len([e FOR e IN {_EDGES} IF e <= {x}]) - 1, 19) END"


_HIST = f"""{_windows(200)}, cells AS (SELECT idx, {_bin('uc')} AS bin, count(*) AS n FROM a GROUP BY 1, 2),
ids AS (SELECT DISTINCT idx FROM a), h AS (
  SELECT i.idx, b.bin, coalesce(c.n, 0) AS n FROM ids i CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) b
  LEFT JOIN cells c ON c.idx = i.idx AND c.bin = b.bin)"""
_REF = {
    "fixed_first": "r.idx = 0",
    "rolling": "r.idx = w.idx - 1",
    "multi_reference": "(r.idx = 0 OR r.idx <= w.idx - 2)",
}


def _metrics(mode: str) -> str:
    return f"""{_HIST}, refs AS (SELECT w.idx, w.bin, w.n, sum(r.n) AS rn FROM h w JOIN h r ON r.bin = w.bin AND {_REF[mode]} WHERE w.idx > 0 GROUP BY 1, 2, 3),
pq AS (SELECT idx, bin, coalesce(rn / nullif(sum(rn) OVER (PARTITION BY idx), 0)::DOUBLE, 0) AS p, coalesce(n / nullif(sum(n) OVER (PARTITION BY idx), 0)::DOUBLE, 0) AS q FROM refs),
cl AS (SELECT *, greatest(p, 1e-10) AS cp, greatest(q, 1e-10) AS cq, greatest((p + q) / 2, 1e-10) AS m FROM pq),
no AS (SELECT *, cp / sum(cp) OVER (PARTITION BY idx) AS np, cq / sum(cq) OVER (PARTITION BY idx) AS nq FROM cl),
div AS (SELECT idx, sum(np * ln(np / nq)) AS kl, sum(cp * ln(cp / m) + cq * ln(cq / m)) / 2 AS js FROM no GROUP BY idx)"""


def _distances(mode: str) -> str:
    return f"""pair AS (
  SELECT idx, uc AS v, 0 AS r, 1 AS w FROM a WHERE idx > 0 AND uc IS NOT NULL UNION ALL
  SELECT w.idx, r.uc, 1, 0 FROM ids w JOIN a r ON {_REF[mode]} WHERE w.idx > 0 AND r.uc IS NOT NULL),
vals AS (SELECT idx, v, sum(r) AS r, sum(w) AS w FROM pair GROUP BY 1, 2),
run AS (SELECT idx, v, sum(r) OVER o AS cr, sum(w) OVER o AS cw, sum(r) OVER (PARTITION BY idx) AS n1, sum(w) OVER (PARTITION BY idx) AS n2, lead(v) OVER o AS nx
  FROM vals WINDOW o AS (PARTITION BY idx ORDER BY v)),
dist AS (SELECT idx, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(cr * n2 - cw * n1))::BIGINT AS k,
  max(abs(cr * n2 - cw * n1))::DOUBLE / max(n1 * n2)::DOUBLE AS ks_stat, coalesce(sum(abs(cr * n2 - cw * n1)::DECIMAL(16, 0) * (nx - v)::DECIMAL(14, 10))::DOUBLE, 0) / max(n1 * n2)::DOUBLE AS wasserstein
  FROM run GROUP BY idx)"""


_ALL = f"""{_metrics('fixed_first')}, {_distances('fixed_first')}, ps AS (
  SELECT *, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END *
    list_product([((n1 - j * (k // n1) + 1 + i)::DOUBLE / (n1 + 1 + i)) FOR i IN range(0, j * (k // n1))]) FOR j IN range(1, n1 // (k // n1) + 1)])) END AS ks_p
  FROM dist),
m AS (SELECT 'events' AS stream, ps.idx, s.n, s.start, s."end", kl, js, ks_stat, ks_p, wasserstein FROM ps JOIN div ON div.idx = ps.idx
  JOIN (SELECT idx, count(*) AS n, min(pos) AS start, max(pos) AS "end" FROM a GROUP BY idx HAVING count(*) >= 20) s ON s.idx = ps.idx)"""
_DECIDED = f"""{_ALL}, v AS (SELECT *, kl >= 0.05 AS vk, ks_p < 0.05 AS vs, js >= 0.03 AS vj, wasserstein >= 0.05 AS vw FROM m),
d AS (SELECT v.*, rule, CASE rule WHEN 'KL_only' THEN vk WHEN 'KS_only' THEN vs WHEN 'KL_AND_KS' THEN vk AND vs WHEN 'JS_only' THEN vj WHEN 'Wasserstein_only' THEN vw
  ELSE vk::INT + vs::INT + vj::INT + vw::INT >= 2 END AS drift
  FROM v CROSS JOIN (SELECT unnest(['KL_only', 'KS_only', 'KL_AND_KS', 'JS_only', 'Wasserstein_only', 'Ensemble_majority']) AS rule)),
ds AS (SELECT *, CASE WHEN NOT drift THEN 'none' WHEN kl >= 0.15 THEN 'critical' ELSE 'warning' END AS severity FROM d)"""
_REPORT = f"""{_DECIDED}, rep AS (SELECT stream, rule, bool_or(drift) AS drift_detected, min(idx - 1) FILTER (drift) AS first_detection,
  count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (drift AND "end" < 600) AS false_alarms,
  coalesce(bool_or(drift AND start >= 600), false) AS true_detection, max({_even('kl', 6)}) AS max_kl, max({_even('js', 6)}) AS max_js, max({_even('wasserstein', 6)}) AS max_wasserstein,
  coalesce(min({_even('ks_p', 6)}), 1.0) AS min_ks_p, count(*) AS n_windows, min(idx - 1) FILTER (drift) - greatest(0, (600 - 200) // 200) AS detection_delay
  FROM ds GROUP BY stream, rule)"""

_LABEL = "CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN lower(trim({x})) IN ('safe', '0') THEN 'SAFE' WHEN lower(trim({x})) IN ('unsafe', '1', 'hate', 'toxic', 'harmful') THEN 'UNSAFE' ELSE upper(trim({x})) END"


def _stats(below: str) -> str:
    return f"""WITH {_BASE} SELECT source, count(*) AS n, min(uc) AS min, max(uc) AS max, {_even(_mean('uc'), 6)} AS mean,
  {_even(f"sqrt(greatest({_squares('uc')} - sum(uc::DECIMAL(14, 10))::DOUBLE * sum(uc::DECIMAL(14, 10))::DOUBLE / count(uc)::DOUBLE, 0) / ({below})::DOUBLE)", 6)} AS std,
  count(DISTINCT round(uc, 6)) AS n_unique FROM base WHERE uc IS NOT NULL GROUP BY source"""


SQL: dict[str, str] = {
    "label_normalise": "SELECT event_id, " + _LABEL.format(x="raw") + """ AS label FROM (SELECT event_id,
  (['Hate', ' safe ', '1', '0', 'maybe', 'UNSAFE', 'toxic', NULL])[user_id % 8 + 1] AS raw FROM events)""",
    "label_normalise_audit": "SELECT event_id, " + _LABEL.format(x="raw") + """ AS label FROM (SELECT event_id,
  CASE WHEN user_id % 2 = 0 THEN (user_id % 3)::VARCHAR || '.0' ELSE (user_id % 3)::VARCHAR END AS raw FROM events)""",
    "normalise_record": """WITH x AS (SELECT event_id, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS c, event_id % 3 AS k,
  (['UNSAFE', 'SAFE', 'UNSAFE', 'MAYBE'])[user_id % 4 + 1] AS predicted FROM events WHERE event_id % 50 <> 7)
SELECT event_id, event_id::VARCHAR AS id, 'unknown' AS language, 'UNKNOWN' AS true_label, predicted,
  round(CASE WHEN k = 0 THEN c WHEN k = 1 THEN 1 - c WHEN predicted = 'SAFE' THEN 1 - c ELSE c END, 6) AS unsafe_confidence,
  CASE WHEN k < 2 THEN 'direct_unsafe_probability' ELSE 'derived_from_pred_confidence' END AS confidence_source, 'unknown' AS source FROM x""",
    "conf_stats": _stats("count(uc)"),
    "conf_summary_sample_std": _stats("greatest(count(uc) - 1, 1)"),
    "language_distribution": f"WITH {_BASE} SELECT source, language AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 4) AS share FROM base GROUP BY source, language",
    "label_distribution": f"""WITH {_BASE} SELECT CASE WHEN uc >= 0.5 THEN 'UNSAFE' ELSE 'SAFE' END AS key, count(*) AS n,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share FROM base GROUP BY 1""",
    "constant_check": f"WITH {_BASE} SELECT user_id, count(DISTINCT round(uc, 6)) = 1 AS constant, coalesce(stddev_pop(uc) < 0.01, false) AS near_constant FROM base GROUP BY user_id",
    "audit_warnings": f"""WITH {_BASE}, g AS (SELECT user_id, source, count(*) AS n, count(uc) AS nv, count(DISTINCT round(uc, 6)) = 1 AS c, min(uc) AS low, count(DISTINCT round(uc, 4)) AS d4 FROM base GROUP BY user_id, source)
SELECT user_id, source, 'few_rows' AS warning FROM g WHERE n <= 3 UNION ALL SELECT user_id, source, 'stop_constant_half' FROM g WHERE c AND round(low, 6) = 0.5
UNION ALL SELECT user_id, source, 'constant' FROM g WHERE c UNION ALL SELECT user_id, source, 'few_distinct' FROM g WHERE nv > 0 AND d4 < 4 UNION ALL SELECT user_id, source, 'no_confidence' FROM g WHERE nv = 0""",
    "preflight_verdict": f"""WITH {_BASE} SELECT source, count(*) AS n, CASE WHEN count(*) < 100 OR count(uc) = 0 OR count(DISTINCT round(uc, 6)) = 1 THEN 'stop'
  WHEN count(*) < 4000 THEN 'warn' ELSE 'ok' END AS verdict FROM base GROUP BY source""",
    "window_tumbling": _summary(200),
    "window_sliding": _summary(100),
    "hist_equal_width": f"WITH {_HIST} SELECT 'events' AS stream, idx, bin, n FROM h",
    "hist_bin_edges": f"SELECT {_bin('(l_quantity::DOUBLE / 50)')} AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "window_metrics": f"""WITH {_ALL} SELECT stream, idx, n, {_even('kl', 6)} AS kl, {_even('js', 6)} AS js, {_even('ks_stat', 6)} AS ks_stat, {_even('ks_p', 6)} AS ks_p,
  {_even('wasserstein', 6)} AS wasserstein FROM m""",
    "decision_rules": f"WITH {_DECIDED} SELECT stream, idx, rule, drift, severity FROM ds",
    "report_summary": f"WITH {_REPORT} SELECT * FROM rep",
    "best_per_stream": f"""WITH {_REPORT} SELECT stream, rule, detection_delay, false_alarms, true_detection FROM rep
  QUALIFY row_number() OVER (PARTITION BY stream ORDER BY (NOT true_detection)::INT, coalesce(detection_delay, 2147483648), false_alarms,
    list_position(['KL_only', 'KS_only', 'KL_AND_KS', 'JS_only', 'Wasserstein_only', 'Ensemble_majority'], rule)) = 1""",
}
for _mode in _REF:
    SQL[f"divergence_{_mode}"] = f"WITH {_metrics(_mode)} SELECT 'events' AS stream, idx, {_even('kl', 6)} AS kl, {_even('js', 6)} AS js FROM div"
for _mode in _REF:
    SQL[f"distance_{_mode}"] = f"""WITH {_HIST}, {_distances(_mode)} SELECT 'events' AS stream, idx, n1, n2, k, {_even('ks_stat', 6)} AS ks_stat,
  {_even('wasserstein', 6)} AS wasserstein FROM dist"""

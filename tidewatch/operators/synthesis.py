"""Synthetic drift streams drawn from a pool of records, and perturbed texts.

``records`` has a unique whole number ``rid`` and any other columns; the ones read are
language, predicted, source, uc and text.  Streams are rows of records with
``pos``, their place; every draw is a function of the seed, the stream's name and
the place (``rng``).  Pools are numbered by ``windows.positions``, and draws meet them
in a join on (pool, number), so nothing is collected but the pools' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import even
from tidewatch.functions.rng import below, draw
from tidewatch.operators import windows

# Languages before and after a language drift, and the share of the stream where gradual drifts count as begun.
BEFORE, AFTER = ("en", "ms"), ("zh", "ta", "zh-cn", "zh-tw")
GRADUAL_POINT = {"language_gradual": 0.3, "class_prior_gradual": 0.35, "confidence_shift_gradual": 0.3}
# Fixed values of the text perturbation.
SYMBOLS = "!@#$%^&*"
EMOJI = ("😈", "💀", "🔥", "😡", "🤬", "💩")
LEET = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}
MARKERS = ("[MS]", "[ZH]", "[TA]")


def length(records: DataFrame, target: int) -> int:
    """Rows of a stream: the target, at most three times the records; under 100 records there is no stream."""
    n = records.count()
    if n < 100:
        raise ValueError(f"only {n} records; at least 100 are needed")
    return min(target, 3 * n)


class Pools:
    """Records by pool, numbered from 0 in each; an empty pool (or one under ``least`` rows) is all records."""

    def __init__(self, records: DataFrame, of: dict[str, Column], least: dict[str, float] | None = None):
        sizes = records.agg(*[F.count_if(keep).alias(name) for name, keep in of.items()]).first()
        keep = {name: F.lit(True) if not sizes[name] or sizes[name] < (least or {}).get(name, 0) else c for name, c in of.items()}
        names = F.filter(F.array(*[F.when(c, name) for name, c in keep.items()]), lambda x: x.isNotNull())
        self.rows = windows.positions(records.withColumn("_pool", F.explode(names)), "rid", by="_pool").withColumnRenamed("pos", "_nth")
        counts = records.agg(*[F.count_if(c).alias(name) for name, c in keep.items()]).first()
        self.sizes = {name: counts[name] for name in of}

    def pick(self, at: DataFrame, stream: str, pool: Column, seed: int, place: str = "pos") -> DataFrame:
        """A record for each row of ``at`` from the pool that it names, drawn with replacement."""
        size = F.element_at(F.create_map(*[F.lit(x) for kv in self.sizes.items() for x in kv]), F.col("_of"))
        asked = at.withColumn("_of", pool).withColumn("_pick", below(draw(seed, stream, F.col(place), F.lit("pick")), size))
        rows = self.rows
        return asked.join(rows, (asked._of == rows._pool) & (asked._pick == rows._nth)).drop("_of", "_pick", "_pool", "_nth")


def _places(records: DataFrame, n: int, name: str = "pos") -> DataFrame:
    return records.sparkSession.range(n).select(F.col("id").alias(name))


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("stream_name", F.lit(name))


def iid_control(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Cells of language and label in their shares, shuffled and cut to ``n`` rows; rounding may leave fewer."""
    cell = F.concat_ws("|", "language", "predicted")
    rows = windows.positions(records.withColumn("_cell", cell), "rid", by="_cell").withColumnRenamed("pos", "_nth")
    counts = records.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_size"))
    total = records.agg(F.count(F.lit(1)).alias("_total"))
    share = F.rint(F.col("_size") / F.col("_total") * n).cast("long")
    slots = counts.crossJoin(F.broadcast(total)).where(share > 0).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), share - 1)))  # one row
    drawn = slots.withColumn("_pick", below(draw(seed, "iid_control", F.col("_cell"), F.col("_slot"), F.lit("pick")), F.col("_size")))
    drawn = drawn.withColumn("_order", draw(seed, "iid_control", F.col("_cell"), F.col("_slot"), F.lit("order"))).select("_cell", "_slot", "_pick", "_order")
    got = drawn.join(rows.withColumnRenamed("_nth", "_pick"), ["_cell", "_pick"]).withColumn("stream", F.lit("iid_control"))
    return _named(windows.positions(got, "_order", "_cell", "_slot"), "iid_control").where(F.col("pos") < n).drop("_cell", "_slot", "_pick", "_order", "stream")


def _languages(records: DataFrame, least: dict | None = None) -> Pools:
    said = F.lower("language")
    return Pools(records, {"pre": said.isin(*BEFORE), "post": said.isin(*AFTER)}, least)


def language_sudden(records: DataFrame, n: int, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """Languages of the one group before the drift point, of the other after it; a pool under half its draws is all records."""
    at = int(n * fraction)
    pools = _languages(records, {"pre": at / 2, "post": (n - at) / 2})
    pool = F.when(F.col("pos") < at, "pre").otherwise("post")
    return _named(pools.pick(_places(records, n), "language_sudden", pool, seed), "language_sudden")


def language_gradual(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The share of the other languages grows from 0 to 0.8."""
    pool = F.when(draw(seed, "language_gradual", F.col("pos"), F.lit("side")) < F.col("pos") / n * 0.8, "post").otherwise("pre")
    return _named(_languages(records).pick(_places(records, n), "language_gradual", pool, seed), "language_gradual")


def _labels(records: DataFrame) -> Pools:
    return Pools(records, {"safe": F.col("predicted") == "SAFE", "unsafe": F.col("predicted") == "UNSAFE"})


def class_prior_sudden(records: DataFrame, n: int, fraction: float = 0.5, unsafe_after: float = 0.8, seed: int = 42) -> DataFrame:
    """Exact halves of the labels before the drift point, ``unsafe_after`` of UNSAFE after it, each side shuffled."""
    at = int(n * fraction)
    unsafe = int((n - at) * unsafe_after)
    slot = F.col("_slot")
    pool = F.when((slot < at // 2) | (slot >= at + unsafe), "safe").otherwise("unsafe")
    got = _labels(records).pick(_places(records, n, "_slot"), "class_prior_sudden", pool, seed, "_slot")
    got = got.withColumns({"_half": F.when(slot < at, "before").otherwise("after"), "_order": draw(seed, "class_prior_sudden", slot, F.lit("order"))})
    got = windows.positions(got, "_order", "_slot", by="_half")
    return _named(got.withColumn("pos", F.col("pos") + F.when(F.col("_half") == "after", at).otherwise(0)).drop("_half", "_slot", "_order"), "class_prior_sudden")


def class_prior_gradual(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The share of UNSAFE grows from 0.3 to 0.7, from the first row on."""
    pool = F.when(draw(seed, "class_prior_gradual", F.col("pos"), F.lit("side")) < F.col("pos") / n * 0.4 + 0.3, "unsafe").otherwise("safe")
    return _named(_labels(records).pick(_places(records, n), "class_prior_gradual", pool, seed), "class_prior_gradual")


def source_sudden(records: DataFrame, n: int, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """The first half of the sources in order before the drift point, the others after it; with one source, ``language_sudden``."""
    names = sorted(r.source for r in records.select("source").distinct().collect())  # sources are few: names of data sets
    if len(names) < 2:
        return language_sudden(records, n, fraction, seed)
    first = names[: len(names) // 2]
    pools = Pools(records, {"pre": F.col("source").isin(*first), "post": ~F.col("source").isin(*first)})
    pool = F.when(F.col("pos") < int(n * fraction), "pre").otherwise("post")
    return _named(pools.pick(_places(records, n), "source_sudden", pool, seed), "source_sudden")


def _shifted(records: DataFrame, n: int, name: str, delta: Column, seed: int) -> DataFrame:
    """All records drawn evenly, confidences moved by ``delta`` and cut to [0, 1]; null counts as one half, a constant gets noise."""
    drawn = Pools(records, {"all": F.lit(True)}).pick(_places(records, n), name, F.lit("all"), seed)
    constant = drawn.agg((F.count_distinct(F.bround("uc", 4)) == 1).alias("_constant"))  # one row
    noise = F.when(F.col("_constant"), draw(seed, name, F.col("pos"), F.lit("noise")) * 0.1 - 0.05).otherwise(0.0)
    moved = F.coalesce("uc", F.lit(0.5)) + noise + delta
    return _named(drawn.crossJoin(F.broadcast(constant)).withColumn("uc", F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).drop("_constant"), name)


def confidence_shift_sudden(records: DataFrame, n: int, fraction: float = 0.5, delta: float = 0.2, seed: int = 42) -> DataFrame:
    return _shifted(records, n, "confidence_shift_sudden", F.when(F.col("pos") < int(n * fraction), 0.0).otherwise(delta), seed)


def confidence_shift_gradual(records: DataFrame, n: int, delta: float = 0.3, seed: int = 42) -> DataFrame:
    return _shifted(records, n, "confidence_shift_gradual", F.col("pos") / n * delta, seed)


STREAMS = {
    f.__name__: f
    for f in (iid_control, language_sudden, language_gradual, class_prior_sudden, class_prior_gradual, source_sudden, confidence_shift_sudden, confidence_shift_gradual)
}


def drift_point(name: str, n: int, fraction: float = 0.5) -> int | None:
    """Row at which a stream counts as drifting; none for the control."""
    return None if name == "iid_control" else int(n * GRADUAL_POINT.get(name, fraction))


def severity_ramp(pos: Column, point: Column | int, n: Column | int) -> Column:
    """0 before the drift point, then up to 1 at the end."""
    point, n = (x if isinstance(x, Column) else F.lit(x) for x in (point, n))
    return F.when(pos < point, 0.0).otherwise((pos - point) / F.greatest(F.lit(1), n - point))


def perturb(text: Column, severity: Column, name: str, key: Column, seed: int = 42) -> Column:
    """Five edits of a text, each with a chance that grows with severity: a symbol, a doubled character, an emoji,
    digits for letters (three in ten of them), and a language mark in front; null and empty texts stay."""
    u = lambda k: draw(seed, name, key, F.lit(k))
    size = lambda t: F.greatest(F.length(t), F.lit(1))
    put = lambda t, at, x: F.concat(F.substring(t, F.lit(1), at.cast("int")), x, F.substring(t, (at + 1).cast("int"), F.length(t)))
    one = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (below(u(k), len(items)) + 1).cast("int"))

    def edit(t: Column, chance: float, k: str, made) -> Column:
        return F.transform(F.array(t), lambda x: F.when(u(k) < severity * chance, made(x)).otherwise(x))[0]

    def leet(t: Column) -> Column:
        start = below(u("leet at"), 65536)
        table = F.create_map(*[F.lit(x) for kv in LEET.items() for x in kv])
        chosen = lambda i: F.pmod(start + (i.cast("long") + 1) * 40503, F.lit(65536)) < 0.3 * 65536
        return F.array_join(F.transform(F.split(t, ""), lambda c, i: F.when(chosen(i), F.coalesce(F.try_element_at(table, F.lower(c)), c)).otherwise(c)), "")

    t = edit(text, 0.4, "symbol", lambda x: put(x, below(u("symbol at"), size(x)), one(SYMBOLS, "symbol which")))
    t = edit(t, 0.4, "double", lambda x: put(x, below(u("double at"), size(x)), F.substring(x, (below(u("double at"), size(x)) + 1).cast("int"), F.lit(1))))
    t = edit(t, 0.3, "emoji", lambda x: put(x, below(u("emoji at"), F.length(x) + 1), one(EMOJI, "emoji which")))
    t = edit(t, 0.2, "leet", leet)
    t = edit(t, 0.2, "mark", lambda x: F.concat(one(MARKERS, "mark which"), x))
    return F.when(F.length(text) > 0, t).otherwise(text)


def perturbed_stream(records: DataFrame, target: int = 2000, seed: int = 42) -> DataFrame:
    """Texts for scoring again: drawn from records with text, edited more and more after the middle; no rows without texts."""
    name = "adversarial_text_stream"
    said = records.where(F.length("text") > 0)
    size = said.count()
    n = min(target, 3 * size)
    if not n:
        return said.select(F.lit(0).cast("long").alias("pos"), "*", F.lit("").alias("original_text"), F.lit(0.0).alias("adversarial_severity")).limit(0)
    drawn = Pools(said, {"all": F.lit(True)}).pick(_places(records, n), name, F.lit("all"), seed)
    level = severity_ramp(F.col("pos"), n // 2, n)
    got = drawn.withColumns({"original_text": F.col("text"), "text": perturb(F.col("text"), level, name, F.col("pos"), seed), "adversarial_severity": even(level, 4)})
    return got.withColumn("id", F.concat(F.col("rid").cast("string"), F.lit("_adv")))


def profile(streams: DataFrame, points: DataFrame) -> DataFrame:
    """Per stream and side of its drift point (after: from it on; without one all is before): rows and mean confidence, four places."""
    from tidewatch.functions.numbers import mean_of

    rows = streams.join(F.broadcast(points), "stream_name", "left")  # a row per stream
    side = F.when(F.col("pos") >= F.col("drift_point"), "after").otherwise("before").alias("side")
    return rows.groupBy("stream_name", side).agg(F.count(F.lit(1)).alias("n"), even(mean_of(F.col("uc")), 4).alias("confidence_mean"))

"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and repeated 8-word
windows.  Rates made of them are the features; a higher one is worse.  For each
stratum a ladder of rules is made on one half of the labelled rows: each feature
gets the cutoff (a quantile of good rows) that best tells bad rows from good ones,
the features are put in the order of what they tell, and rule t rejects a text if
one of the first t features lies above its cutoff, so later rules reject more.
The other half certifies rules: a rule holds if the exact binomial
probability of seeing so few rejected good rows, were the true rate ``alpha``, is at most
``delta`` divided by the number of strata (Bonferroni), and all earlier rules hold
(fixed sequence).  With probability 1 - delta no stratum's chosen rule rejects more than
``alpha`` of good texts.  Among the rules that hold, the one with the best difference of
rates of rejected bad and good rows on the first half is taken.

Equal texts count once in both halves.  Labelled rows meet features that were
computed once for all rows; nothing but rule tables is broadcast, behind a check
of their size.  Windows are compared by 64-bit hashes, so ``n_repeat_words`` is exact
but for collisions (for a text of 10,000 words, a chance under 1e-11).

Defined cases: a null text has no words and fails the base rules; a null stratum
is a stratum; strata without enough labels to certify a rule reject nothing
beyond the base rules; a value equal to a cutoff is not above it; conflicting labels
of a row count as bad; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SQL_SPACE, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Shares of good texts beyond the steps' cutoffs, per feature.
STEPS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02)
FEATURES = ("symbol_rate", "repeat_rate", "dup_line_rate", "stutter_rate", "upper_rate", "word_length")
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Strata whose steps may be broadcast.
_BROADCAST = 10_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as the variable of a lambda."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _paired(name: str, step: int) -> Column:
    """Hashes of each element of an array column with the one ``step`` places later."""
    x = F.col(name)
    n = F.greatest(F.size(x) - step, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in text order."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        n = F.size(s) - 1
        after = F.slice(s, F.lit(2), n)
        before = F.slice(s, F.lit(1), n)
        equal = F.zip_with(before, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda p: p.isNotNull()))))

    def words(at: Column) -> Column:
        reach = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)

    return _let(_let(ordered, flagged), words)


def counted(own: DataFrame) -> DataFrame:
    """Rows (row, text, ...) with the text replaced by its counts; a null text counts as empty.

    Words are hashed as soon as they are cut, and windows are hashes of hashes
    (two, four, eight words).  Each step is a column used more than once, so it is
    computed once and handed on as a flat array, and a text's strings are gone
    before its windows are made.
    """
    keep = [c for c in own.columns if c != "text"]
    text, inner = F.coalesce("text", F.lit("")), F.col("_inner")
    cut = own.withColumn("text", text).withColumn("_inner", F.trim("text", F.lit(_SPACES))).select(
        *keep,
        F.length(F.translate(inner, _SPACES, "")).cast("long").alias("word_chars"),
        _removed(inner, SYMBOLS).alias("n_symbols"),
        _removed(inner, _CAPITALS).alias("n_upper"),
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SQL_SPACE)).alias("_words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "").alias("_lines"),
    )
    keep += ["word_chars", "n_symbols", "n_upper"]
    lines = F.size("_lines").cast("long")
    hashed = cut.select(
        *keep, F.size("_words").cast("long").alias("n_words"), lines.alias("n_lines"), (lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    keep += ["n_words", "n_lines", "n_dup_lines"]
    rest = F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0)))
    same = F.filter(F.zip_with("_h", rest, lambda a, b: a == b), lambda e: F.coalesce(e, F.lit(False)))
    paired = hashed.select(*keep, F.size(same).cast("long").alias("n_stutter"), _paired("_h", 1).alias("_h"))
    keep += ["n_stutter"]
    windows = paired.select(*keep, _paired("_h", 2).alias("_h")).select(*keep, _paired("_h", 4).alias("_h"))
    repeated = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"))).otherwise(F.lit(0).cast("long"))
    return windows.select(*keep, repeated.alias("n_repeat_words"))


def _rate(top: str, below: str, most: float) -> Column:
    """Rounded and bounded, so that a feature has a bounded number of values."""
    return F.least(F.lit(most), F.round(F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below)), F.lit(0.0)), 3))


def measured(df: DataFrame, text: Column, stratum: Column) -> DataFrame:
    """``df``'s columns in ``row``, with the counts, features, stratum and base verdict."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), stratum.alias("stratum"), F.xxhash64(text).alias("digest"), text.alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted(own).select(
        "*",
        failed.alias("base_failed"),
        _rate("n_symbols", "n_words", 10).alias("symbol_rate"),
        _rate("n_repeat_words", "n_words", 1).alias("repeat_rate"),
        _rate("n_dup_lines", "n_lines", 1).alias("dup_line_rate"),
        _rate("n_stutter", "n_words", 1).alias("stutter_rate"),
        _rate("n_upper", "word_chars", 1).alias("upper_rate"),
        _rate("word_chars", "n_words", 100).alias("word_length"),
    )


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial (n, p), for k <= n p; exact but for rounding, without underflow."""
    choose = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0))
    last = choose + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * F.when(i <= k, (k - i + 1) * (1 - p) / ((n - k + i) * p)).otherwise(0.0)
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, add, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last + F.log(series))))


def _outcome(out: Column) -> list[Column]:
    """Aggregates over labelled rows: good and bad rows of the halves, and those that are rejected."""
    fit, good = F.col("fit"), F.col("good")
    return [
        F.count_if(~fit & good).alias("n"),
        F.count_if(~fit & good & out).alias("k"),
        F.coalesce(F.try_divide(F.count_if(fit & ~good & out), F.count_if(fit & ~good)), F.lit(0.0)).alias("bad_out"),
        F.coalesce(F.try_divide(F.count_if(fit & good & out), F.count_if(fit & good)), F.lit(0.0)).alias("good_out"),
    ]


def steps(labelled: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The certified rule of each stratum: stratum and cutoffs (an array in the order of FEATURES; infinity: unused).

    ``labelled``: stratum, digest, good (boolean), base_failed and the features.
    Rows that fail the base rules are gone before and not counted.
    """
    rows = labelled.where(~F.col("base_failed")).groupBy("stratum", "digest").agg(F.min("good").alias("good"), *[F.max(f).alias(f) for f in FEATURES])
    rows = stored(rows.withColumn("fit", F.pmod(F.xxhash64("digest"), F.lit(2)) == 0), "labelled")
    # the fit half: each feature's best cutoff, and the features in the order of what their cutoffs gain
    quantiles = rows.where("fit and good").groupBy("stratum").agg(*[F.expr(f"percentile({f}, array({', '.join(f'{1 - t}D' for t in STEPS)}))").alias(f) for f in FEATURES])
    choices = quantiles.select("stratum", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("at")) for i, f in enumerate(FEATURES)])).alias("c"))
    choices = choices.select("stratum", "c.feature", F.posexplode("c.at").alias("step", "cutoff")).withColumnRenamed("stratum", "of")
    value = F.array(*[F.col(f) for f in FEATURES])[F.col("feature")]
    tried = rows.where("fit").join(choices, F.col("of").eqNullSafe(F.col("stratum")))
    tried = tried.groupBy("of", "feature", "step", "cutoff").agg(*_outcome(value > F.col("cutoff"))).withColumn("gain", F.col("bad_out") - F.col("good_out"))
    best = tried.where("gain > 0").groupBy("of", "feature").agg(F.max(F.struct("gain", (-F.col("step")).alias("early"), "cutoff")).alias("b"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("b.gain")).alias("loss"), "feature", F.col("b.cutoff").alias("cutoff"))))
    ranked = best.groupBy("of").agg(order.alias("chosen"))  # at most one entry a feature
    # rule t uses the first t features; more of them reject more
    level = F.explode(F.sequence(F.lit(1), F.size("chosen"))).alias("step")
    used = lambda i: F.filter(F.slice("chosen", F.lit(1), F.col("step")), lambda x: x["feature"] == i)
    cutoff = [F.when(F.size(used(i)) > 0, used(i)[0]["cutoff"]).otherwise(F.lit(float("inf"))) for i in range(len(FEATURES))]
    ladder = ranked.select("of", "chosen", level).select("of", "step", F.array(*cutoff).alias("cutoffs"))
    seen = rows.join(ladder, F.col("of").eqNullSafe(F.col("stratum"))).groupBy("of", "step", "cutoffs").agg(*_outcome(above(F.col("cutoffs"))))
    strata = seen.select(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("of")), F.lit(""))).alias("strata"))
    p = F.lit(alpha)
    tail = F.when(F.col("k") <= F.col("n") * p, binomial_tail(F.col("k"), F.col("n"), p)).otherwise(1.0)
    earlier = Window.partitionBy("of").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = seen.join(F.broadcast(strata)).withColumn("holds", tail <= F.lit(delta) / F.col("strata"))  # one row
    held = tested.withColumn("holds", F.min("holds").over(earlier)).where("holds")
    best = held.withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy(F.desc(F.col("bad_out") - F.col("good_out")), "step")))
    return best.where("nth = 1").select(F.col("of").alias("stratum"), "cutoffs")


def above(cutoffs: Column) -> Column:
    """Is some feature above its cutoff?"""
    out = F.lit(False)
    for i, f in enumerate(FEATURES):
        out = out | (F.col(f) > cutoffs[i])
    return out


def judged(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` rows with the column kept."""
    chosen = chosen.select(F.col("stratum").alias("of"), "cutoffs")
    small = F.broadcast(chosen) if chosen.limit(_BROADCAST + 1).count() <= _BROADCAST else chosen
    # a null stratum may have cutoffs as well
    same = F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")) == F.coalesce(F.concat(F.lit("="), F.col("of")), F.lit(""))
    kept = ~F.col("base_failed") & ~F.coalesce(above(F.col("cutoffs")), F.lit(False))
    return rows.join(small, same, "left").withColumn("kept", kept).drop("of", "cutoffs")


def labelled_rows(rows: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Rows of ``measured`` (with doc_id) that have a label, and good."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    return rows.join(known, "doc_id").withColumn("good", F.col("label") == 1)


def risk_controlled(df: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per row of ``df`` (doc_id, text, lang): doc_id, counts, base_failed, kept."""
    rows = measured(df.select("doc_id", "text", "lang"), F.col("text"), F.col("lang"))
    rows = stored(rows.select("row.doc_id", "stratum", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES), "measures")
    chosen = stored(steps(labelled_rows(rows, labels), alpha, delta), "steps")
    return judged(rows, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``df`` (with doc_id, text, lang) that are kept, columns unchanged."""
    rows = measured(df, F.col("text"), F.col("lang"))
    rows = stored(rows.select("row", F.col("row.doc_id").alias("doc_id"), "stratum", "digest", "base_failed", *FEATURES), "measures", compression="zstd")
    chosen = stored(steps(labelled_rows(rows.drop("row"), labels), alpha, delta), "steps")
    return judged(rows, chosen).where("kept").select("row.*")

"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Text is folded first: compatibility forms and accents away, lower case, letters of
other scripts that look Latin, digits and symbols that stand for letters, all
other punctuation to spaces.  The lexicon is fitted on a bounded sample of
labelled rows: entries are whole words or word beginnings whose share of toxic
rows is significant after correction for the number of candidates, each weighted
by its log odds.  Phrases of two words that hold an entry and are common in clean rows but not in toxic
ones become exceptions: they cancel the entries inside them.  All patterns go into
one automaton.  The score is a logistic function of the weighted hits, the same
divided by the text's number of words, and a bias, so texts without hits share
the bias.

Defined cases: null, empty and wordless texts score as texts without hits; a row
with a null label is never learnt from; without any toxic label the score is 0.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Letters that look like Latin ones (Greek, Cyrillic).
HOMOGLYPHS = dict(zip("абвгдеѕзіјкӏмнорԛстухԝуαβεικνορτυχγω", "abbrdeszijkimhopqctyxwyabeiknoptuxyw"))
#: Digits and symbols that stand for letters.
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))

_SEPARATORS = {c: " " for c in map(chr, range(128)) if not c.isalnum()}
_FOLD = str.maketrans({**_SEPARATORS, **HOMOGLYPHS, **SUBSTITUTES, "ß": "ss", "æ": "ae", "ø": "o", "ł": "l", "­": "", "​": "", "‌": "", "‍": ""})
#: A symbol is a letter only before one: "$tupid", but not "stupid$$$".
_SYMBOL = re.compile(r"[@$](?![a-zA-Z])")


def fold(text: str | None) -> str:
    """Words of a-z separated by single spaces, with a space on either side."""
    if not text:
        return " "
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    if "$" in text or "@" in text:
        text = _SYMBOL.sub(" ", text)
    text = text.lower().translate(_FOLD)
    return f" {' '.join(text.split())} "


@dataclass
class Lexicon:
    """``entries`` and ``exceptions`` are folded patterns that begin with a space; one that ends with a space is whole words."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.0, 0.0, -40.0)  # of log(1 + hits), of hits per word, bias

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            found.add_word(pattern, (len(pattern), weight, False))
        for pattern in self.exceptions:
            found.add_word(pattern, (len(pattern), 0.0, True))
        if len(found):
            found.make_automaton()
        return found

    def score(self, hits: float, words: int) -> float:
        a, b, bias = self.weights
        z = a * math.log1p(hits) + b * hits / max(words, 1) + bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def weigh(folded: str, automaton) -> tuple[float, int]:
    """Weight of the hits outside exceptions, and the number of words.  Of hits that begin at one place the heaviest counts."""
    words = folded.count(" ") - 1
    if not len(automaton) or words < 1:
        return 0.0, max(words, 0)
    spans, hits = [], {}
    for end, (size, weight, exempt) in automaton.iter(folded):
        start = end - size + 1
        if exempt:
            spans.append((start, end))
        elif weight > hits.get(start, (0.0, 0))[0]:
            hits[start] = (weight, end)
    if spans:
        hits = {s: h for s, h in hits.items() if not any(a <= s and s + 1 <= b for a, b in spans)}
    return sum(w for w, _ in hits.values()), words


def _significant(toxic: int, clean: int, base: float, log_tests: float) -> bool:
    """Is the toxic share above ``base``, by Chernoff's bound with a correction for the number of tests?"""
    n = toxic + clean
    p = toxic / n
    if p < max(0.5, base):
        return False
    gain = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
    return n * gain > log_tests


class _Patterns:
    """Patterns that may become entries: toxic words as a whole, their letters as a beginning, and beginnings that differing toxic words share.

    A beginning in between stands for the same words as the next longer one here, so none is
    missing, and there are at most three patterns a word, whatever its length.
    """

    def __init__(self, words: list[str]):
        words = sorted(words)
        shared = (commonprefix(pair) for pair in zip(words, words[1:]))
        self.starts = {" " + w for w in [*words, *shared] if len(w) >= 3}
        self.whole = {f" {w} " for w in words}
        self.sizes = sorted({len(p) for p in self.starts})

    def of(self, word: str) -> list[str]:
        """Those that find ``word``."""
        said = f" {word}"
        found = [p for n in self.sizes[: bisect_right(self.sizes, len(said))] if (p := said[:n]) in self.starts]
        return [*found, said + " "] if said + " " in self.whole else found


def fit(rows: Iterable[tuple[str, int]], min_exceptions: int = 5) -> Lexicon:
    """Lexicon from (text, label) pairs; every significant entry is kept."""
    folded = [(fold(text), int(label)) for text, label in rows if label is not None]
    n, toxic_rows = len(folded), sum(label for _, label in folded)
    if not toxic_rows:
        return Lexicon()
    if toxic_rows == n:
        return Lexicon(weights=(0.0, 0.0, 40.0))
    base = toxic_rows / n
    counts = {0: Counter(), 1: Counter()}
    for text, label in folded:
        counts[label].update(set(text.split()))
    # beginnings, by the rows of their words; " word " stands for the whole word
    patterns = _Patterns(list(counts[1]))
    starts = {0: Counter(), 1: Counter()}
    for label in (1, 0):
        for w, k in counts[label].items():
            for key in patterns.of(w):
                starts[label][key] += k
    del counts  # with the words of all rows, it is the largest part
    log_tests = math.log(100 * len(starts[1]))
    good = {k for k in starts[1] if _significant(starts[1][k], starts[0][k], base, log_tests)}
    contexts = _neighbourhoods(folded, good)
    toxic, clean = ({k: len(c) for k, c in contexts[label].items()} for label in (1, 0))
    good = {k for k in good if _significant(toxic[k], clean[k], base, log_tests)}
    entries: dict[str, float] = {}
    longer = Counter()
    for k in good:
        inside = [p for p in patterns.of(k.strip()) if p != k and p in good and len(p) < len(k)]
        if inside:
            longer[inside[-1]] = max(longer[inside[-1]], toxic[k])
    for k in sorted(good, key=lambda k: (len(k), k)):
        if any(k[:n] in entries for n in range(4, len(k))) or longer[k] >= 0.97 * toxic[k]:
            continue  # a shorter entry covers it, or a longer one says the same more precisely
        entries[k] = math.log((toxic[k] + 0.5) / (toxic_rows + 1)) - math.log((clean[k] + 0.5) / (n - toxic_rows + 1))
    model = Lexicon(dict(sorted(entries.items(), key=lambda e: (-e[1], e[0]))))
    model.exceptions = _exceptions(folded, model, min_exceptions)
    model.weights = _calibrate(folded, model)
    return model


def _neighbourhoods(folded: list[tuple[str, int]], patterns: set[str]) -> dict[int, dict[str, set[int]]]:
    """Per label and pattern: hashes of the words before and after it.  Copies of a text are no further evidence, so
    different neighbourhoods count instead of rows."""
    import ahocorasick

    seen: dict[int, dict[str, set]] = {0: {k: set() for k in patterns}, 1: {k: set() for k in patterns}}
    found = ahocorasick.Automaton()
    for k in patterns:
        found.add_word(k, k)
    if not len(found):
        return seen
    found.make_automaton()
    for text, label in folded:
        for end, k in found.iter(text):
            start = end - len(k) + 1
            stop = text.index(" ", start + 1)
            before = text[text.rfind(" ", 0, start) + 1 : start]
            after = text[stop + 1 : max(text.find(" ", stop + 1), stop + 1)]
            seen[label][k].add(hash((before, after)))
    return seen


def _exceptions(folded: list[tuple[str, int]], model: Lexicon, least: int) -> list[str]:
    """Phrases of an entry's word and a neighbour that occur in clean rows and never in toxic ones."""
    automaton = model.automaton()
    seen = {0: Counter(), 1: Counter()}
    if not len(automaton):
        return []
    for text, label in folded:
        found = set()
        for end, (size, _, _) in automaton.iter(text):
            start = end - size + 1
            stop = text.index(" ", start + 1)
            if (after := text.find(" ", stop + 1)) > 0:
                found.add(text[start : after + 1])
            if start and (before := text.rfind(" ", 0, start)) >= 0:
                found.add(text[before : stop + 1])
        seen[label].update(found)
    return sorted(p for p, k in seen[0].items() if k >= least and not seen[1][p])


def _calibrate(folded: list[tuple[str, int]], model: Lexicon) -> tuple[float, float, float]:
    """Logistic regression with a ridge on two features of the hits, by Newton's method."""
    automaton = model.automaton()
    x = np.array([(math.log1p(h), h / max(w, 1), 1.0) for h, w in (weigh(t, automaton) for t, _ in folded)])
    y = np.array([label for _, label in folded], float)
    w, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    a, b, bias = w
    return max(float(a), 0.0), max(float(b), 0.0), float(bias)  # more hits never lower a score


def _sampled(df: DataFrame, labels: DataFrame, learn: Column, max_rows: int, label_col: str) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    rows = known.where(learn).select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(max_rows)
    found = df.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # max_rows ids
    return found.groupBy("place", "doc_id", "label").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))


def _bounded(rows: Iterable[tuple[str, int]], max_bytes: int) -> Iterator[tuple[str, int]]:
    size = 0
    for text, label in rows:
        size += len((text or "").encode())
        if size > max_bytes and size > len((text or "").encode()):
            break
        yield text, label


def sample(df: DataFrame, labels: DataFrame, learn: Column, max_rows: int, label_col: str = "toxic", max_bytes: int = 128 << 20) -> Iterator[tuple[str, int]]:
    """At most ``max_rows`` labelled rows, those with the smallest id hashes, as (text, label).

    Rows are taken in the order of their id hashes until their texts hold ``max_bytes``;
    of rows with one id the one with the smallest text digest counts.  Only the ids
    travel: they are broadcast, and the texts are picked where they lie.
    """
    rows = _sampled(df, labels, learn, max_rows, label_col).orderBy("place", "doc_id")
    yield from _bounded(((r.text, r.label) for r in rows.toLocalIterator()), max_bytes)


def fit_sample(df: DataFrame, labels: DataFrame, learn: Column, max_rows: int, label_col: str = "toxic", max_bytes: int = 128 << 20) -> Lexicon:
    """``fit`` of the rows of ``sample`` in one task, which their bounds make small; the driver gets the lexicon alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in texts(batches) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_bounded(pairs, max_bytes)))])], ["model"])

    rows = _sampled(df, labels, learn, max_rows, label_col).repartition(1).sortWithinPartitions("place", "doc_id")
    made = rows.select("text", "label").mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else Lexicon()


def score_rows(df: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in texts(batches):
            got = [model.score(*weigh(fold(t), automaton)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score under ``threshold``, columns unchanged."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in texts(batches):
            yield b.filter(pa.array([model.score(*weigh(fold(t), automaton)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)

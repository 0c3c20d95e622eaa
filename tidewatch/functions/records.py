"""Prediction records: labels and confidence from fields of many names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names in order of preference, and label spellings.
ALIASES: dict[str, tuple[str, ...]] = {
    "id": ("id", "sample_id", "idx"),
    "language": ("lang", "language", "lang_code"),
    "true_label": ("label", "true_label", "ground_truth", "true"),
    "predicted": ("pred_label", "predicted_label", "prediction", "pred", "predicted"),
    "unsafe": ("unsafe_confidence", "unsafe_probability"),
    "safe": ("safe_probability", "safe_confidence"),
    "pred_confidence": ("pred_confidence", "confidence", "score", "prob"),
    "source": ("source",),
    "text": ("text", "fused_text", "content"),
    "modality": ("modality",),
}
SAFE = ("safe", "0")
UNSAFE = ("unsafe", "1", "hate", "toxic", "harmful")


#: Names of experiments by what their file name holds, first match in this order.
EXPERIMENTS = {"zero_shot": "zero-shot", "qlora_ft": "fine-tuned", "qlora_la": "language-aware", "qlora_mm": "multimodal", "qlora_rag": "with retrieval", "transfer_phase2": "transfer"}
#: The instruction of the scoring prompt.
INSTRUCTION = "You are a multilingual content moderation assistant. Classify the following content as SAFE or UNSAFE. Reply with exactly one word: SAFE or UNSAFE."
_BLANKS = " \t\n\r\x0b\x0c"


def _stripped(raw: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(raw, F.lit(_BLANKS))


def text_label(raw: Column) -> Column:
    """Label of a string: a known spelling, else the string in capitals; null is UNKNOWN."""
    said = F.lower(_stripped(raw))
    return F.when(raw.isNull(), "UNKNOWN").when(said.isin(*SAFE), "SAFE").when(said.isin(*UNSAFE), "UNSAFE").otherwise(F.upper(_stripped(raw)))


def json_label(raw: Column) -> Column:
    """Label of a JSON value (variant): numbers and booleans count as 0 and 1, others are UNKNOWN."""
    kind = F.regexp_extract(F.schema_of_variant(raw), r"^\w+", 0)
    said = F.try_variant_get(raw, "$", "string")
    number = F.try_variant_get(raw, "$", "double")
    flag = F.when(number == 0, "SAFE").when(number == 1, "UNSAFE").otherwise("UNKNOWN")
    return F.when(F.is_variant_null(raw) | raw.isNull(), "UNKNOWN").when(kind == "STRING", text_label(said)).when(
        kind == "BOOLEAN", F.when(F.try_variant_get(raw, "$", "boolean"), "UNSAFE").otherwise("SAFE")
    ).otherwise(F.coalesce(flag, F.lit("UNKNOWN")))


def audit_label(raw: Column) -> Column:
    """The audit's label: of the written form in capitals, so 1.0 and TRUE stay as they are."""
    said = F.upper(_stripped(raw))
    return F.when(raw.isNull(), "UNKNOWN").when(F.lower(said).isin(*SAFE), "SAFE").when(F.lower(said).isin(*UNSAFE), "UNSAFE").otherwise(said)


def number(raw: Column) -> Column:
    """A JSON value's written form as a double: true and false are 1 and 0, what doesn't parse is null."""
    said = F.lower(_stripped(raw))
    return F.when(said == "true", 1.0).when(said == "false", 0.0).otherwise(said.try_cast("double"))


def confidence(direct: Column, safe: Column, pred: Column, predicted: Column) -> tuple[Column, Column]:
    """(unsafe confidence, where it comes from) of string fields; the first that parses, in this order."""
    d, s, c = (number(x) for x in (direct, safe, pred))
    derived = F.when(predicted == "SAFE", F.lit(1.0) - c).otherwise(c)
    value = F.coalesce(d, F.lit(1.0) - s, derived)
    origin = F.when(d.isNotNull() | s.isNotNull(), "direct_unsafe_probability").when(c.isNotNull(), "derived_from_pred_confidence").otherwise("missing")
    return value, origin


def first_parsable(*fields: Column) -> Column:
    """The first field that is a number (unlike ``confidence``, where the first set one decides)."""
    return F.coalesce(*(number(f) for f in fields))


def truthy(*fields: Column) -> Column:
    """The first field that is neither null nor zero, else the last."""
    return F.coalesce(*(F.when(f != 0, f) for f in fields[:-1]), fields[-1])


def experiment(file_name: Column, names: dict[str, str] = EXPERIMENTS) -> Column:
    """Name of the first key that the file's name holds, else the file's name."""
    case = F.when(F.lit(False), F.lit(""))
    for key, name in names.items():
        case = case.when(F.contains(F.lower(file_name), F.lit(key)), name)
    return case.otherwise(file_name)


def decode_label(raw: Column) -> Column:
    """Label of generated text."""
    return F.when(F.contains(F.upper(raw), F.lit("UNSAFE")), "UNSAFE").otherwise("SAFE")


def prompt(text: Column, language: Column) -> Column:
    """The scoring prompt; its marks are fixed values of the chat format."""
    turn = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
    head = F.lit(f"<|begin_of_text|>{turn('system')}{INSTRUCTION}<|eot_id|>{turn('user')}Language: ")
    return F.concat(head, F.coalesce(language, F.lit("en")), F.lit("\nContent: "), text, F.lit(f"<|eot_id|>{turn('assistant')}"))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits."""
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  (computes the value once, not per element)
    powers = once(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    with_total = once(powers, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return once(with_total, lambda s: F.transform(s["p"], lambda x: x / s["total"]))


def class_probabilities(shares: Column, safe: list[int], unsafe: list[int]) -> tuple[Column, Column]:
    """(safe, unsafe) of softmax shares: sums over the classes' ids, made to sum to one."""
    s, u = (reduce(lambda a, b: a + b, [shares[i] for i in ids]) for ids in (safe, unsafe))
    total = s + u
    return F.when(total > 0, s / total).otherwise(s), F.when(total > 0, u / total).otherwise(u)


def token_probabilities(shares: Column, safe: int, unsafe: int) -> tuple[Column, Column, Column]:
    """(safe, unsafe, failed) of one id a class, as they are; both null where neither has any share."""
    failed = (shares[safe] < 1e-9) & (shares[unsafe] < 1e-9)
    return F.when(~failed, shares[safe]), F.when(~failed, shares[unsafe]), failed


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Other columns of ``lines``, each field that any alias names as a variant, and ``_bad`` (malformed); blank lines are left out.

    A line is parsed once, behind a generator, however often its fields are used.
    An array is a record without fields.
    """
    names = list(dict.fromkeys(a for names in ALIASES.values() for a in names))
    kind = "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ", _corrupt: string>"
    said = F.col(column)
    record = F.from_json(said, kind, {"columnNameOfCorruptRecord": "_corrupt"})
    other = [c for c in lines.columns if c != column]
    rows = lines.where(_stripped(said) != "").select(*other, said.alias("_line"), F.inline(F.array(record)))
    array = F.startswith(F.ltrim("_line"), F.lit("[")) & F.try_parse_json("_line").isNotNull()
    return rows.select(*other, *(F.col(f"`{n}`").alias(f"_{n}") for n in names), (F.col("_corrupt").isNotNull() & ~array).alias("_bad"))


def normalise(lines: DataFrame, column: str = "value") -> DataFrame:
    """Canonical records of JSON lines; blank and malformed lines are left out, other columns are kept."""
    kept = parsed(lines, column).where("not _bad")

    def first(name: str) -> Column:
        return F.coalesce(*(F.when(~F.is_variant_null(F.col(f"_{a}")), F.col(f"_{a}")) for a in ALIASES[name]))

    rows = kept.select(*(c for c in lines.columns if c != column), *(first(k).alias(f"_first_{k}") for k in ALIASES))
    field = lambda name: F.try_variant_get(f"_first_{name}", "$", "string")
    rows = rows.withColumns({"true_label": json_label(F.col("_first_true_label")), "predicted": json_label(F.col("_first_predicted"))})
    uc, origin = confidence(field("unsafe"), field("safe"), field("pred_confidence"), F.col("predicted"))
    return rows.select(
        *(c for c in lines.columns if c != column),
        F.coalesce(field("id"), F.lit("unknown")).alias("id"),
        F.coalesce(field("language"), F.lit("unknown")).alias("language"),
        "true_label",
        "predicted",
        number(field("pred_confidence")).alias("pred_confidence"),
        uc.alias("unsafe_confidence"),
        origin.alias("confidence_source"),
        F.coalesce(field("source"), F.lit("unknown")).alias("source"),
        field("text").alias("text"),
        field("modality").alias("modality"),
    )

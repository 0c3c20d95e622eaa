"""Licence scans by canonical digest lookup of entire texts.

Text is brought into one form (copyright notices and "all rights reserved" gone, A-Z
in lower case, everything but letters and digits of any script one space, equivalent
spellings made one), hashed with SHA-256, and the digests are joined
to those of known licences.  A notice is a line that begins, after marks such as those of
comments, with "copyright" and a sign, year or name, or with the sign itself.  Known
licences come from the files of ``licence_texts``, each bare and under every title that
it is shipped with, or from a table of one's own.  Only DataFrame functions are used.
The join is on the digest, so copies of any number of texts are spread by Spark's own
join strategy; the known side is small and never forced to be broadcast.

Defined cases: null and empty text have the digest of the empty form and match
nothing; repeated rows keep a row each; a form shared by several known licences
goes to the first name; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence texts use for one another, first to second, at the beginning of words.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labell", "label"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"),
    ("modell", "model"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"), ("practise", "practice"), ("programme ", "program "), ("realis", "realiz"),
    ("recognis", "recogniz"), ("signall", "signal"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
    ("wilful", "willful"), ("non commercial", "noncommercial"), ("non infring", "noninfring"), ("noninfringment", "noninfringement"), ("merchantibility", "merchantability"),
    ("per cent", "percent"), ("copyright holder", "copyright owner"), ("https", "http"),
)
# Titles above a licence's text.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"[^\p{L}\p{N}\n(©]*"
_NOTICE = (
    rf"(?:^|\n){_MARKS}(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t]*(?:\([Cc]\)|©|:|[0-9<\[{{])|(?:Copyright|copyright)[ \t]+(?:by[ \t]+)?[A-Z][a-z]|\([Cc]\)[ \t]*[0-9]|©)[^\n]*"
    r"|[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd]"
)
_REST = r"[^\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def known() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the texts that come with the package, bare and under their titles."""
    files = sorted(f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    rows = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files]
    return tuple((name, head + text) for name, text in rows for head in ("", *(f"{t}\n\n" for t in TITLES.get(name, ()))))


def canonical(text: Column) -> Column:
    """The one form of a text."""
    said = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _NOTICE, " "), _UPPER, _LOWER)
    said = F.concat(F.lit(" "), F.regexp_replace(said, _REST, " "), F.lit(" "))
    for one, other in EQUIVALENT:
        said = F.replace(said, F.lit(f" {one}"), F.lit(f" {other}"))
    return F.trim(F.regexp_replace(said, " +", " "))


def digests(table: DataFrame) -> DataFrame:
    """Columns digest and licence of rows (licence, text); empty forms are left out."""
    rows = table.withColumn("_form", canonical(F.col("text"))).where("_form != ''")
    return rows.groupBy(F.sha2("_form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, digest, licence (null: none); ``table``: licence and text of one's own."""
    table = table if table is not None else df.sparkSession.createDataFrame(list(known()), "licence string, text string")
    rows = df.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return rows.join(digests(table), "digest", "left").select("doc_id", "digest", "licence")


def sql() -> str:
    """The same for DuckDB."""

    def form(text: str) -> str:
        said = f"translate(regexp_replace(coalesce({text}, ''), '{_NOTICE}', ' ', 'g'), '{_UPPER}', '{_LOWER}')"
        said = f"' ' || regexp_replace({said}, '{_REST}', ' ', 'g') || ' '"
        for one, other in EQUIVALENT:
            said = f"replace({said}, ' {one}', ' {other}')"
        return f"trim(regexp_replace({said}, ' +', ' ', 'g'))"

    quoted = lambda t: t.replace("'", "''")
    rows = " UNION ALL ".join(f"SELECT '{k}' AS licence, '{quoted(v)}' AS text" for k, v in known())
    return f"""WITH k AS (SELECT sha256({form('text')}) AS digest, min(licence) AS licence FROM ({rows}) GROUP BY 1)
SELECT doc_id, d.digest, licence FROM (SELECT doc_id, sha256({form('text')}) AS digest FROM documents) d LEFT JOIN k ON k.digest = d.digest"""

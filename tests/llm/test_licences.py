import re

import duckdb
import pytest

from tidewatch.llm import licences
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    mit = dict(reversed(licences.known()))["MIT"]
    made = ["Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper(), re.sub(r"\s+", "  \n", mit).replace("sublicense", "SUBLICENCE"), mit[:-30], mit + " more", "", None, "©", dict(reversed(licences.known()))["ISC"], "x " * 100_000]
    return [(i, t) for i, t in enumerate(made)] + [(0, made[0])] + [(r.doc_id + 100, r.text) for r in table(spark, SF, "documents").collect()]


def test_changes_of_form_match_and_changes_of_words_do_not(spark, rows):
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licence string")).collect()}
    assert [got[i] for i in range(9)] == ["MIT", "MIT", None, None, None, None, None, "ISC", None]
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equals_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    key = lambda r: tuple(str(x) for x in r)
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(key, got)) == sorted(map(key, con.execute(licences.sql()).fetchall()))


def test_stock_files_match(spark):
    own = dict(reversed(licences.known()))
    assert set(own) >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Unlicense", "Zlib", "CC0-1.0", "BSL-1.0", "MIT", "ISC", "0BSD"}
    mit, bsd, apache = own["MIT"], own["BSD-3-Clause"], own["Apache-2.0"]
    curly = re.sub(r'"([^"]*)"', "“\\1”", mit).replace(" ", "\u00a0", 3)
    commented = "\n".join("# " + line for line in ("Copyright Jane Doe <j@x.org>\n\n" + mit).split("\n"))
    starred = "/*\n" + "\n".join(" * " + line for line in ("© 2011-2014 The Group\nCopyright: 2020 Other\n" + bsd).split("\n")) + "\n */"
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A B\n\n" + mit), ("MIT", "The MIT License (MIT)\n\nCopyright 2019 A\nCopyright (C) 2020 B, Inc. All rights reserved.\n" + mit), ("MIT", curly), ("MIT", commented),
        ("BSD-3-Clause", starred), ("BSD-3-Clause", bsd.replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER ").replace("license", "licence")), ("Apache-2.0", apache.upper().lower()), ("Apache-2.0", re.sub(r"[ \t]*\n[ \t]*", "\r\n", apache)),
        (None, "MIT License"), (None, bsd.replace("Neither", "Either")), ("GPL-3.0", own["GPL-3.0"]), ("Zlib", "zlib License\n\n(C) 2001 Me\n\n" + own["Zlib"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df).collect()} == {i: name for i, (name, _) in enumerate(texts)}
    mine = spark.createDataFrame([("own", "Do as you like, thrice.")], "licence string, text string")
    assert licences.scan(spark.createDataFrame([(1, "do as you LIKE; thrice")], "doc_id long, text string"), mine).first().licence == "own"

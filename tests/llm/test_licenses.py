"""Licence scan: canonical form, edge rows, and the query against DuckDB."""

import os

import pytest

from revlens.llm import licenses, queries
from tests.compare import compare_one, duck_connect
from tests.conftest import SF001


@pytest.fixture(scope="module")
def known(spark):
    return licenses.known_texts(spark)


def scan(docs_of, known, rows):
    return sorted(((r["doc_id"], r["licence"], r["notices"]) for r in licenses.scan(docs_of(rows), known).collect()), key=str)


def test_query_matches_sql(spark):
    r = compare_one(spark, duck_connect(SF001), "op1_license_scan", queries.QUERIES["op1_license_scan"],
                    queries.ORACLE_SQL["op1_license_scan"], SF001)
    assert r["values"] and r["rows"], r["detail"]


def test_planted_notices_are_found(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r["doc_id"]: r["notices"] for r in queries.QUERIES["op1_license_scan"](spark, SF001).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {r["doc_id"]: ",".join(sorted({lines[x] for x in (r["text"] or "").split("\n") if x in lines})) for r in df.collect()}
    assert any(want.values())
    assert {k: v or "" for k, v in got.items()} == want


def test_whole_texts_in_other_shapes(docs_of, known):
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    head = "MIT License\n\nCopyright (c) 2020 Some Body\nAll rights reserved.\n\n"
    rows = [(1, mit), (2, head + mit), (3, mit.upper()), (4, " ".join(mit.split())), (5, "# " + "\n# ".join(mit.split("\n"))),
            (6, mit.replace("sublicense", "sub-licence").replace("copyright holders", "Copyright  Holders")), (7, mit + " and more"), (8, mit[:-9]),
            (9, bsd), (10, "© 1999 X\n" + bsd.replace(",", ";")), (11, "Copyright 2001, 2002 Y\n\n" + licenses.TEXTS["ISC"])]
    got = scan(docs_of, known, rows)
    assert [x[1] for x in sorted(got)] == ["MIT"] * 6 + [None] * 2 + ["BSD-3-Clause"] * 2 + ["ISC"]


def test_edge_rows(docs_of, known):
    rows = [(1, None), (2, ""), (3, " .\n--\n"), (4, "Copyright (c) 2020 A"), (5, "LICENCE: mit!"), (5, "LICENCE: mit!"), (None, "x\nlicense - MIT\r\ny"),
            (6, "license mit and more\nSPDX-License-Identifier: GPL-3.0\nLicense: isc\nLicense: ISC"), (7, "w " * 200_000), (8, "per cent")]
    assert scan(docs_of, known, rows) == sorted([
        (1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, None, "MIT"), (5, None, "MIT"), (None, None, "MIT"),
        (6, None, "GPL-3.0,ISC"), (7, None, None), (8, None, None)], key=str)
    assert scan(docs_of, known, []) == []
    assert scan(docs_of, known.limit(0), rows[:1]) == [(1, None, None)]


def test_equivalent_spellings_side_by_side(docs_of, spark):
    own = spark.createDataFrame([("B", "text", "licence licence per cent non-commercial"), ("A", "text", "LICENSE, license percent noncommercial"),
                                 ("C", "text", None), ("D", "text", " ")], "licence string, kind string, text string")
    assert scan(docs_of, own, [(1, "license licence percent non commercial"), (2, "")]) == [(1, "A", None), (2, None, None)]


def test_known_by_digest(docs_of, spark):
    text = "one two three"
    d = docs_of([(1, text)]).select(licenses.digest("text")).first()[0]
    own = spark.createDataFrame([("A", "text", None, d), ("B", "text", "four", None)], "licence string, kind string, text string, digest string")
    assert scan(docs_of, own, [(1, "One, two THREE"), (2, "four"), (3, text + " four")]) == [(1, "A", None), (2, "B", None), (3, None, None)]


def test_long_whole_texts(docs_of, known):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert set(files) == set(licenses.DIGESTS)
    if not all(os.path.exists(f"/usr/share/common-licenses/{f}") for f in files.values()):
        pytest.skip("no /usr/share/common-licenses")
    texts = {k: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for k, f in files.items()}
    rows = [*texts.items()] + [(k, " ".join(t.replace("https://", "http://").split("\n\n"))) for k, t in texts.items() if k in ("MPL-2.0", "CC0-1.0")]
    rows += [("Apache-2.0", texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Some Body")),
             ("GPL-3.0", texts["GPL-3.0"].split("How to Apply")[0]), (None, texts["GPL-2.0"] + " more"), (None, texts["MPL-2.0"][:-60])]
    got = scan(docs_of, known, [(i, t) for i, (_, t) in enumerate(rows)])
    assert [x[1] for x in sorted(got, key=lambda x: x[0])] == [k for k, _ in rows]

import re

import duckdb
import pytest

from larder.llm import licences
from larder.llm.queries import QUERIES, SQL
from tests.conftest import DATA

MIT = """Copyright (c) 2020 Somebody
The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


@pytest.mark.parametrize("text,want", [
    ("A text. Licensed under the Apache License, Version 2.0.", ("Apache-2.0", "apache2_ref", 0)),
    ("a\nReleased under the MIT License.\nb. Licensed under CC BY-NC 4.0!", ("CC-BY-NC-4.0; MIT", "mit_ref ccbync4_ref", 0)),
    (MIT, ("MIT", "unknown mit_ref mit_grant mit_notice as_is no_liability", 1)),
    ("We need permission to enter. Nothing else", ("", "unknown", 1)),
    ("This work is licensed under the GNU General Public License, version 3", ("GPL-3.0", "gpl3_ref", 0)),
    ("Released under the MIT License. Released under the MIT License.", ("MIT", "mit_ref mit_ref", 0)),
    ("SPDX-License-Identifier: GPL-3.0-or-later\ncode", ("GPL-3.0-or-later", "spdx_gpl3_later", 0)),
    ("no such words here", ("", "", 0)), ("", ("", "", 0)), (None, ("", "", 0)),
    ("x y " * 100_000 + "\nLicensed under CC BY 4.0.", ("CC-BY-4.0", "ccby4_ref", 0)),
])
def test_texts(spark, text, want):
    docs = spark.createDataFrame([(1, text, "a", 2), (None, text, None, 3)], "doc_id long, text string, sentences string, licences int")
    got = licences.scanned(docs).collect()
    assert [tuple(r)[1:] for r in got] == [want] * 2


def plain(text):
    """Rules tried in order at every place of the sequence."""
    known = dict((s, i) for i, s in licences.SENTENCES)
    ids = []
    for s in re.split(r"[.!?]+[ \t\r\n]+|[;:]?[\r\n]+", (text or "").lower()):
        if any(w in s for w in licences.CRITICAL):
            ids.append(known.get(re.sub(r"[^a-z0-9.]+", " ", s).strip(" ").rstrip(". "), "unknown"))
    found, used = set(), [False] * len(ids)
    for licence, run in licences.RULES:
        a = 0
        while a + len(run) <= len(ids):
            if tuple(ids[a:a + len(run)]) == run and not any(used[a:a + len(run)]):
                used[a:a + len(run)] = [True] * len(run)
                found.add(licence)
                a += len(run)
            else:
                a += 1
    return "; ".join(sorted(found)), " ".join(ids), used.count(False)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/sf0.01/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_sentence_licences"](spark, f"{DATA}/sf0.01").collect()}
    assert got == {i: plain(t) for i, t in rows} and any(r[0] for r in got.values())


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op10_sentence_licences"](spark, f"{DATA}/sf0.01").collect()))
    assert got == sorted(con.execute(SQL["op10_sentence_licences"]).fetchall())


def test_empty(spark):
    assert licences.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables():
    """Every rule uses known identifiers, and no rule is hidden by an earlier part of it."""
    ids = {i for i, _ in licences.SENTENCES}
    assert {i for _, run in licences.RULES for i in run} <= ids
    for n, (_, run) in enumerate(licences.RULES):
        assert not any(len(e) < len(run) and " ".join(e) in " ".join(run) for _, e in licences.RULES[:n])
    assert all(re.fullmatch(r"[a-z0-9][a-z0-9. ]*[a-z0-9]", s) for _, s in licences.SENTENCES)

import textwrap

import duckdb
import pytest

from larder.llm import licences
from tests.llm.test_licences import MIT

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD2 = """Copyright (c) 2020 Somebody

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def wrapped(text, sign=""):
    lines = [y for x in text.split("\n") for y in (textwrap.wrap(x, 72) or [""])]
    return "\n".join(sign + x for x in lines)


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_texts(spark, sign):
    untitled = MIT.split("\n\n", 1)[1]
    texts = {"MIT": untitled, "GPL-3.0-or-later": GPL, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}
    docs = spark.createDataFrame([(k, wrapped(t, sign)) for k, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in licences.scanned(docs).collect()}
    assert {k: r.licences for k, r in got.items()} == {k: k for k in texts}
    assert got["MIT"].n_unknown == got["GPL-3.0-or-later"].n_unknown == 0
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(map(tuple, got.values())) == sorted(con.execute(licences.sql()).fetchall())


def test_carriage_returns(spark):
    """A line may end in a carriage return alone, or in both signs."""
    texts = {e: wrapped(GPL).replace("\n", e) for e in ("\r", "\r\n")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert [r.licences for r in licences.scanned(docs).collect()] == ["GPL-3.0-or-later"] * 2

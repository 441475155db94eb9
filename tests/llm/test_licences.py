import re

import duckdb
import pytest

from rowgate.llm import licences
from rowgate.llm.oracles import LICENCES

BSD = [s + "." for s, i in licences.SENTENCES.items() if i in ("bsd", "bsd_source", "bsd_binary")]
NAMES = next(s for s, i in licences.SENTENCES.items() if i == "bsd_names") + "."
MIT_TEXT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = [next(s for s, i in licences.SENTENCES.items() if i == k).capitalize() + "." for k in ("gpl3_later", "gpl_warranty", "gpl_details")]

GNU = """    tool - does things
    Copyright (C) 2020  A. Person

    This {what} is free software{a} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{b} either version {v} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind}General Public License for more details.
"""
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
HEADERS = [
    (GNU.format(what="program", kind="", a=";", b=";", v="2"), ["GPL-2.0-or-later"]), (GNU.format(what="program", kind="", a=":", b=",", v="3"), ["GPL-3.0-or-later"]),
    (GNU.format(what="library", kind="Lesser ", a=";", b=";", v="2.1"), ["LGPL-2.1-or-later"]), (GNU.format(what="library", kind="Lesser ", a=":", b=",", v="3"), ["LGPL-3.0-or-later"]),
    (GNU.format(what="program", kind="Affero ", a=":", b=",", v="3"), ["AGPL-3.0-or-later"]), (MPL, ["MPL-2.0"]),
]


def header_texts():
    return [t for t, _ in HEADERS] + [t.replace("\n", "\r\n# ") for t, _ in HEADERS]


CASES = [
    ("Text.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License,\n# Version 2.0.\n", ["Apache-2.0"]),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("\n".join(BSD), ["BSD-2-Clause"]), ("\n".join([*BSD, NAMES]), ["BSD-3-Clause"]), ("\n".join(BSD[::-1]), []), (" ".join(GPL), ["GPL-3.0-or-later"]),
    ("I have a licence to fly. Licensed under nothing.", []), ("see the gnu general public license for more details", []), ("", []), (None, []),
    (MIT_TEXT, ["MIT"]), (MIT_TEXT.replace("\n", "\r\n"), ["MIT"]),
    ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), ("# spdx-license-identifier:\tGPL-2.0-or-later\r\nx", ["GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: MIT */", ["MIT"]), ("SPDX-License-Identifier: Unheard-Of-1.0", []),
    ("This file is distributed under the terms of the GNU General Public License, version 2.", ["GPL-2.0-only"]),
    ("This software is released under the MIT License!", ["MIT"]), ("The library is made available under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("He is released under the MIT License.", []),
    ("word " * 50_000 + "\nLICENSED UNDER CC BY 4.0!", ["CC-BY-4.0"]),
]


def docs(spark):
    rows = [(i, t, "x", [1]) for i, (t, _) in enumerate(CASES)] + [(100 + i, t, "x", [1]) for i, t in enumerate(header_texts())] + [(None, CASES[0][0], None, None), (0, CASES[0][0], "x", [1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, licences string, sentences array<int>")


def test_cases(spark):
    got = licences.scan(docs(spark)).collect()
    assert len(got) == len(CASES) + 2 + len(header_texts())
    for r in got:
        if (r.doc_id or 0) < 100:
            assert r.licences == CASES[r.doc_id or 0][1], r
    assert licences.scan(docs(spark).limit(0)).count() == 0


def test_sentences_have_cues_and_rules_use_them():
    for sentence in licences.SENTENCES:
        written = [f"{lead} the terms of the{sentence[5:]}" for lead in ("licensed under", "this file is released under", "made available under", "the work is published under", "distributed under")] if sentence.startswith("under ") else [sentence]
        assert all(re.search(licences.CUES, x) and re.sub(licences.LEAD, "under ", x) == sentence for x in written)
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", sentence)
    used = {i for _, seq in licences.RULES for i in seq.split()}
    assert used == set(licences.SENTENCES.values())


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.register("frame", docs(spark).select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    want = con.execute(LICENCES).fetchall()
    got = [(r.doc_id, ",".join(r.licences), ",".join(r.sentences)) for r in licences.scan(docs(spark)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_no_python_in_the_plan(spark):
    plan = licences.scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["a.b", "t", "a"])
def test_other_column_names(spark, name):
    rows = spark.createDataFrame([(1, CASES[0][0])], f"id bigint, `{name}` string")
    assert licences.scan(rows, "id", name).first().licences == ["Apache-2.0"]


def test_verbatim_headers(spark):
    texts = list(enumerate(header_texts()))
    got = licences.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {i: HEADERS[i % len(HEADERS)][1] for i, _ in texts}

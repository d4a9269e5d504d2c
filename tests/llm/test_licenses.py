import os
import sys

from basketlens.llm.licenses import ANCHORS, RULES, SENTENCES, scan, scan_sql

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

SF = "/root/testdata/sf0.01"
MIT = """Copyright (c) 2020 Somebody

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""


def test_lists_are_consistent():
    assert all(any(a in s for a in ANCHORS) for s in SENTENCES.values())
    assert all(s == " ".join(s.split()) == s.lower() for s in SENTENCES.values())
    assert {s for _, names in RULES for s in names} == set(SENTENCES)
    assert len(set(SENTENCES.values())) == len(SENTENCES)


def compare(spark, df):
    con = duckdb.connect()
    con.register("documents", df.toPandas()) if df.count() else con.execute("create table documents(doc_id bigint, text varchar)")
    columns = ["doc_id", "licenses", "sentence_ids", "n_sentences", "n_unruled"]
    got = sorted((tuple(r[c] for c in columns) for r in scan(df).collect()), key=str)
    want = con.execute(f"select {', '.join(columns)} from ({scan_sql()})").fetchall()
    assert got == sorted(want, key=str)
    return {r[0]: r for r in got}


def test_rules(spark):
    half = MIT.split("THE SOFTWARE IS")[0]
    rows = [
        (1, MIT), (2, "/*\n * words\n\n" + GPL + "more"), (3, "x y.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. And more"),
        (4, half), (5, "MIT is a place. Licensed to drive."), (6, None), (7, ""), (8, "See the GNU General Public License for more details."),
        (9, "# SPDX-License-Identifier: MIT\n# code"), (9, "# SPDX-License-Identifier: MIT\n# code"), (10, "word " * 50000 + "\nRELEASED UNDER THE MIT LICENSE"),
        (11, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = compare(spark, df)
    assert [found[i][1] for i in range(1, 12)] == ["MIT", "GPL-3.0-or-later", "CC-BY-NC-4.0,MIT", "MIT", "", "", "", "", "MIT", "MIT", "Apache-2.0"]
    assert found[1][2] == "mit-grant,mit-condition,mit-warranty,mit-liability" and found[1][4] == 0
    assert found[8][3:] == (1, 1)
    clash = scan(df.selectExpr("doc_id", "text", "1 as Text", "2 as ids", "3 as left"))
    assert clash.count() == len(rows) and scan(df.limit(0)).count() == 0
    assert scan(spark.createDataFrame([(None, "Released under the MIT License.")], "doc_id long, text string")).first().licenses == "MIT"


def test_whole_table_and_plan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = compare(spark, df)
    assert len(found) == 1000 and sum(bool(r[1]) for r in found.values()) > 10
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Join"))


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the
   copyright holder nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written
   permission.
"""
GPL3 = """Copyright (C) 2020 Somebody

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_headers_in_comments(spark):
    heads = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0-or-later": GPL3}
    marks = ["", "# ", " * ", "// ", "; ", "-- ", "dnl ", "REM "]
    rows, want = [], {}
    for licence, head in heads.items():
        for mark in marks:
            for end in ("\n", "\r\n"):
                for dense in (False, True)[: 1 + (licence != "MIT")]:  # its paragraphs end in a colon
                    lines = ["/*"] * (mark == " * ") + [(mark + x).rstrip() for x in head.split("\n") if x or not dense] + [" */"] * (mark == " * ") + ["int x;"]
                    want[len(rows)] = (licence, mark, end, dense)
                    rows.append((len(rows), end.join(lines)))
    found = compare(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {k: v for k, v in want.items() if found[k][1] != v[0] or found[k][4]} == {}
    assert len({r[2] for r in found.values()}) == len(heads)


def test_notice_after_copyright_line(spark):
    notices = {
        "Copyright 2020 Foo\nReleased under the\nMIT License": "MIT", "(c) 2020 Foo\nLicensed under the\nApache License, Version 2.0": "Apache-2.0", "# Copyright Foo\n# Licensed under\n# the MIT License.": "MIT",
        "x y.\nLicensed under the\nMIT License\nhttps://opensource.org/licenses/MIT\nx": "MIT", "Copyright 2020 Foo. Licensed under the\nMIT License.": "MIT", "Copyrighted work\nx": "",
        "This work is licensed under the GNU General Public License, version\n3. More": "GPL-3.0-only",
    }
    found = compare(spark, spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string"))
    assert {k: r[1] for k, r in found.items()} == dict(enumerate(notices.values()))


def test_variable_parts_families_and_identifiers(spark):
    lgpl = GPL3.replace("This program is free", "libfoo is free").replace("version 3", "version 2.1").replace("GNU General", "GNU Lesser General").replace("This program is", "This library is")
    agpl = GPL3.replace("GNU General", "GNU Affero General")
    only = GPL3.split("either")[0].replace("License as published by\nthe", "License version 2 as published by the").rstrip(", \n") + "."
    named = BSD.replace("Neither the name of the\n   copyright holder nor", "Neither the name of Foo, Bar and Co nor")
    texts = {
        named: "BSD-3-Clause", BSD.replace("copyright holder nor", "University nor").replace("its contributors", "its\n   contributors"): "BSD-3-Clause", BSD.split("3. Neither")[0]: "BSD-2-Clause",
        lgpl: "LGPL-2.1-or-later", agpl: "AGPL-3.0-or-later", only: "GPL-2.0-only",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Released under the MIT License, see LICENSE.": "MIT", "This project is licensed under the terms of the MIT license - see the LICENSE.md file for details": "MIT",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "Licensed under LGPLv2.1 or later": "LGPL-2.1-or-later", "released under the GPLv3": "GPL-3.0-only",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Published under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "Licensed under the Eclipse Public License 2.0": "EPL-2.0",
        "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later", "// SPDX-License-Identifier: GPL-3.0-only\nint x;": "GPL-3.0-only", "/* SPDX-License-Identifier: BSD-2-Clause */": "BSD-2-Clause",
        "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0-only", "; SPDX-License-Identifier: (MIT OR Apache-2.0)\n": "Apache-2.0,MIT", "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": "GPL-2.0-or-later",
        "SPDX-License-Identifier: MIT AND ISC AND (Zlib OR 0BSD)": "0BSD,ISC,MIT,Zlib", "SPDX-License-Identifier: LicenseRef-own": "", "MIT is under the sun. Apache 2 helicopters": "",
    }
    found = compare(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {list(texts)[k][:60]: r[1] for k, r in found.items() if r[1] != texts[list(texts)[k]]} == {}

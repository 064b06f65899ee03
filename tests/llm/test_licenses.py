import hashlib
import random
import re
import textwrap

import duckdb
import regex

from chainlens.llm import licenses as L
from llm_util import AWKWARD, prose, table


def canonical(text):
    out = []
    for line in (text or "").split("\n"):
        x = line.lower()
        if re.match(r"(?:[^\w]|_)*(\(c\)|©|copyright|all rights reserved)", x):
            continue
        for a, b in L.SPELLINGS:
            x = x.replace(a, b)
        x = regex.sub(r"[^\p{L}\p{N}]+", " ", x).strip(" ")
        if x:
            out.append(x)
    return out


def rows_of():
    rng = random.Random(13)
    mit = next(t for i, t in L.KNOWN if t.startswith("MIT License"))
    variant = mit.replace("Copyright (c) <year> <copyright holders>", "// Copyright 2020 Somebody, all rights reserved")
    variant = variant.replace("License", "Licence").replace('"', "'").upper().replace("\n", "\r\n")
    rows = list(AWKWARD) + [(1, mit, "en", "s"), (2, variant, "en", "s"), (3, mit + "\nand one more line", "en", "s"),
                            (4, "(c) 2021 only this", "en", "s"), (5, "released UNDER the mit licence", "en", "s")]
    for i in range(40):
        t = prose(rng)
        if i % 4 == 0:
            t = t.split("\n")[0] + "\n" + L.KNOWN[-(i % 7 + 1)][1] + "\n" + t
        rows.append((100 + i, t, "en", "s"))
    return rows + [(600, "text " * 50_000, "en", "s")]


def want(rows):
    known = {}
    for i, t in L.KNOWN:
        d = " ".join(canonical(t))
        known[d] = min(i, known.get(d, i))
    out = []
    for i, t, *_ in rows:
        lines = canonical(t)
        whole = " ".join(lines)
        hits = [known[x] for x in lines if x in known]
        ids = sorted(set(hits) | ({known[whole]} if whole in known else set()))
        out.append((i, len(lines), known.get(whole), ",".join(ids), len(hits), hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = rows_of()
    out = L.scanned(table(spark, rows), L.known_digests(spark))
    got = sorted([(r["_id"], r["_n"], r["_whole"], r["_licenses"], r["_hits"], r["_whole_digest"]) for r in out.collect()],
                 key=str)
    assert got == want(rows)
    by = {r[0]: r for r in got}
    assert by[1][2] == by[2][2] == by[5][2] == "MIT" and by[3][2] is None


def test_oracle_and_empty(spark):
    rows = [r for r in rows_of() if r[0] != 907]  # the SQL engine lower-cases a dotted capital I its own way
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in rows])
    got = con.execute(L.oracle()).fetchall()
    assert sorted([tuple(r) for r in got], key=str) == want(rows)
    assert L.scanned(table(spark, rows).where("false"), L.known_digests(spark)).count() == 0


STANDARD = {
    "MIT": """MIT License

Copyright (c) 2019 Ann Other

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
""",
    "ISC": """ISC License

Copyright (c) 2019, Ann Other
All rights reserved.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
}


def wrappings(text):
    """The text as it stands, in other widths, with a break after every word, and on one line."""
    parts = [" ".join(x.split()) for x in text.split("\n\n")]
    yield text
    for width in (30, 55, 72, 100):
        yield "\n\n".join(textwrap.fill(x, width) for x in parts)
    yield "\n".join(x if "Other" in x else x.replace(" ", "\n") for x in parts)
    yield "\n".join(parts)
    yield " ".join(parts)
    yield " ".join(x for x in parts if "Other" not in x)
    yield " ".join(parts[1:2]).join(["MIT License ", " "] if text.startswith("MIT") else ["ISC License ", " "]) + "\n".join(parts[2:])


def test_whole_texts_in_any_wrapping(spark):
    rows = [(f"{name}", t) for name, text in STANDARD.items() for t in wrappings(text)]
    out = L.scanned(table(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(rows)]), L.known_digests(spark))
    assert {r["_id"]: r["_whole"] for r in out.collect()} == {i: name for i, (name, _) in enumerate(rows)}


def test_neighbouring_notices_and_whole_texts(spark):
    gpl3 = (L.license_table.FOLDER / "GPL-3.0.txt").read_text()
    bsd3 = (L.license_table.FOLDER / "BSD-3-Clause.txt").read_text()
    rows = [("Apache", "Released under the Apache License."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
            ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("MPL-2.0", "Released under MPL 2.0."),
            ("GPL-3.0-or-later", "This program is licensed under the GNU GPL v3 or later."),
            ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."), ("EPL-2.0", "Licensed under EPL-2.0."),
            ("BSD-2-Clause", "Licensed under the Simplified BSD License."), ("Unlicense", "Released under the Unlicense."),
            ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                                "International License."), ("CC-BY-SA-3.0", "Licensed under CC-BY-SA-3.0"),
            ("GPL-3.0", gpl3), ("GPL-3.0", " ".join(gpl3.split())), ("GPL-3.0", textwrap.fill(gpl3, 60)),
            ("BSD-3-Clause", "Copyright (c) 2001, Somebody\n\n" + bsd3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd3)]
    out = L.scanned(table(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(rows)]), L.known_digests(spark))
    assert {r["_id"]: r["_whole"] for r in out.collect()} == {i: name for i, (name, _) in enumerate(rows)}


def test_prose_that_begins_with_copyright_stays(spark):
    rows = ["copyright notice and this", "Copyright holders be liable", "(c) You must retain", "All rights reserved by law are kept",
            "// Copyright (C) 2020 A", "Copyright 2020 A", "(c) 2020 A", "© A", "Copyright <year> <owner>", "All rights reserved."]
    out = L.scanned(table(spark, [(i, t, "en", "s") for i, t in enumerate(rows)]), L.known_digests(spark))
    assert sorted(r["_id"] for r in out.collect() if r["_n"]) == [0, 1, 2, 3]


def test_own_table_of_texts(spark):
    known = spark.createDataFrame([("own", "My terms: you MAY use it."), ("none", None)], "license string, text string")
    out = L.scanned(table(spark, [(1, "my terms\n you may; use it", "en", "s")]), L.known_digests(spark, known))
    assert out.first()["_whole"] == "own"


def test_copyright_lines_of_any_length(spark):
    mit = next(t for i, t in L.KNOWN if t.startswith("MIT License"))
    holders = ", ".join(f"2{i:03d} Holder Number {i}" for i in range(20, 400))
    rows = [(1, mit.replace("Copyright (c) <year> <copyright holders>", f"Copyright (c) {holders}"), "en", "s")]
    out = L.scanned(table(spark, rows), L.known_digests(spark)).collect()
    assert len(rows[0][1]) > 5000 and [r["_whole"] for r in out] == ["MIT"]

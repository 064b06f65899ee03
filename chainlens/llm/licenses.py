"""Operator 6: licence scan by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made
one, copyright lines taken out, every run of punctuation and white space made
one space.  The SHA-256 of the canonical form of an entire text is joined
with the digests of known licence texts and notices, canonical by the same
steps.  Besides the whole text, each line is looked up as a text of its own,
since notices stand on lines of their own.

A copyright line is a statement with a mark, a year or a placeholder; prose
that a wrapped line happens to begin with "copyright" stays, and every spelling
is one word, so the form does not depend on where lines break.  A statement
that shares its line with the licence's own words is cut up to those words, in
a further form of the whole text that is looked up too (``unwrapped``).

Everything is built from DataFrame functions.  The rows of a document are
counted inside the task before the shuffle.  The known texts are a small
fixed table here; any larger table can be passed, and Spark then chooses the
join by its size.

Defined results: null, empty or blank text is no licence.  A text of only
copyright lines has an empty form, which is never looked up.  Null ids and
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm import license_table
from chainlens.llm.common import table

# Spellings that licence matching takes as equal (left becomes right).
# The left side is within one word, so that a line break never hides it.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("holder", "owner"), ("favour", "favor"),
    ("fulfill", "fulfil"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"),
    ("licence", "license"), ("modelled", "modeled"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("percent", "per cent"),
    ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("sublicense", "sub license"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("http:", "https:"), ("&", " and "),
]

# Known texts and notices by licence id.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
KNOWN = (license_table.texts() + license_table.titled(KNOWN) + license_table.headers() + license_table.notices() + KNOWN)

_MARK = r"(\(c\)|©|[0-9]{4}|[<\[{])"
COPYRIGHT_LINE = (rf"^[^\p{{L}}\p{{N}}]*((copyright[^\p{{L}}\p{{N}}]*{_MARK}|\(c\)[^\p{{L}}\p{{N}}]*(copyright|{_MARK})|©)[^\n]*"
                  r"|all rights reserved[^\p{L}\p{N}]*)$")
# Words that a licence goes on with after its copyright statement.
BEGINNINGS = [
    "permission is hereby granted", "permission to use", "redistribution and use", "licensed under", "released under",
    "everyone is permitted to copy", "this program is free software", "this library is free software",
    "this program comes with", "this software is provided", "this work is licensed",
]
# In a text of canonical words: the statement up to such a beginning.
STATEMENT = (r"\bcopyright (?:c )?(?:[0-9]{4}|year|yyyy)\b.{0,400}?(?=\b(?:" + "|".join(BEGINNINGS) + r")\b)")


def _normal(x: Column) -> Column:
    """Canonical words of a lower-case text."""
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line."""
    x = F.lower(line)
    return F.when(x.rlike(COPYRIGHT_LINE), "").otherwise(_normal(x))


def unwrapped(text: Column) -> Column:
    """Canonical whole text without the copyright statements before a licence's
    own words, whatever lines they stand on; null for a text without the word."""
    x = F.lower(text)
    return F.when(x.contains("copyright"), F.regexp_replace(_normal(x), STATEMENT, ""))


def canonical(text: Column) -> tuple[Column, Column]:
    """Canonical lines (without empty ones) and the canonical whole text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line), lambda x: x != "")
    return lines, F.array_join(lines, " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(_digest, _license) of a list or table (license, text)."""
    df = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license string, text string")
    _, whole = canonical(F.col("text"))
    forms = df.select("license", F.explode(F.array(whole, unwrapped(F.col("text")))).alias("_w"))
    return (forms.where("_w <> ''")
            .groupBy(F.sha2("_w", 256).alias("_digest")).agg(F.min("license").alias("_license")))


def scanned(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _n_lines, _whole, _licenses, _n_hits, _digest) per row of ``docs``."""
    lines, _ = canonical(F.col(text_col))
    d = (docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), lines.alias("_lines"),
                     F.sha2(unwrapped(F.col(text_col)), 256).alias("_other"))
         .withColumn("_whole_digest", F.sha2(F.array_join("_lines", " "), 256)))

    def unit(kind: str, digest: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), digest.alias("_digest"))

    none = F.array().cast("array<struct<_kind:string,_digest:string>>")
    units = F.concat(F.array(unit("whole", F.col("_whole_digest"))),
                     F.when(F.size("_lines") > 1, F.transform("_lines", lambda x: unit("line", F.sha2(x, 256)))).otherwise(none),
                     F.when(F.col("_other") != F.col("_whole_digest"), F.array(unit("other", F.col("_other")))).otherwise(none))
    rows = d.select("_row", "_id", F.size("_lines").alias("_n"), "_whole_digest", F.inline(units))
    hits = rows.join(digests, "_digest", "left")
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_license")))
    return hits.groupBy("_row", "_id", "_n", "_whole_digest").agg(
        F.coalesce(of("whole"), of("other")).alias("_whole"),
        F.array_join(F.array_sort(F.collect_set("_license")), ",").alias("_licenses"),
        F.count(F.when((F.col("_kind") == "line") | ((F.col("_kind") == "whole") & (F.col("_n") == 1)), F.col("_license")))
        .alias("_hits"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scanned(docs, known_digests(spark))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_lines"),
                      F.col("_whole").alias("text_license"), F.col("_licenses").alias("licenses"),
                      F.col("_hits").alias("n_notices"), F.col("_whole_digest").alias("canonical_sha256"))


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_line(x: str) -> str:
    low = f"lower({x})"
    out = low
    for a, b in SPELLINGS:
        out = f"replace({out}, {_sql_string(a)}, {_sql_string(b)})"
    return (f"CASE WHEN regexp_matches({low}, {_sql_string(COPYRIGHT_LINE)}) THEN '' "
            rf"ELSE trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END")


def oracle() -> str:
    known = ", ".join(f"({_sql_string(i)}, {_sql_string(t)})" for i, t in KNOWN)
    return f"""
WITH k AS (SELECT row_number() OVER () AS rid, * FROM (VALUES {known}) AS v(license, text)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
kl AS (SELECT rid, license, unnest(string_split(text, chr(10))) AS x,
              generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM k),
kw AS (SELECT rid, min(license) AS license, string_agg(c, ' ' ORDER BY pos) AS w
       FROM (SELECT *, {_sql_line('x')} AS c FROM kl) WHERE c <> '' GROUP BY rid),
known AS (SELECT sha256(w) AS digest, min(license) AS license FROM kw GROUP BY 1),
dl AS (SELECT rid, unnest(string_split(text, chr(10))) AS x,
              generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
c AS (SELECT * FROM (SELECT rid, pos, {_sql_line('x')} AS c FROM dl) WHERE c <> ''),
w AS (SELECT d.rid, d.doc_id, count(c.c) AS n, sha256(coalesce(string_agg(c.c, ' ' ORDER BY c.pos), '')) AS digest
      FROM d LEFT JOIN c USING (rid) GROUP BY ALL),
u AS (SELECT c.rid, known.license FROM c JOIN known ON known.digest = sha256(c.c)),
a AS (SELECT rid, license FROM u UNION ALL SELECT w.rid, known.license FROM w JOIN known USING (digest)),
l AS (SELECT rid, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM a GROUP BY rid),
h AS (SELECT rid, count(*) AS hits FROM u GROUP BY rid)
SELECT w.doc_id, w.n AS n_lines, known.license AS text_license, coalesce(l.licenses, '') AS licenses,
       coalesce(h.hits, 0) AS n_notices, w.digest AS canonical_sha256
FROM w LEFT JOIN known USING (digest) LEFT JOIN l USING (rid) LEFT JOIN h USING (rid)
"""

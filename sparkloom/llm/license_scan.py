"""Licence texts by canonical digest: normalise, digest, hash-join.

A text is lower-cased, lines that state a copyright (the word with a sign or a
year, not any line that begins with it) are dropped, equivalent spellings are made
one, marks of list items (``1.``, ``a)``, ``(b)``; bullets too) go, and all but letters
and digits becomes single spaces. The SHA-256 of what is left is looked up among the digests of known
licences. Whole documents are looked up as entire texts, and so is each line, as
short notices stand on lines of their own. Column expressions only.

The built-in table holds short licences as texts, under their usual titles and
without one, and long ones as digests of their published texts. It is parameter
``known``, so a table of any size can be given instead.

A text without any of the stems that every built-in licence has one of cannot
match one of these, so it is not normalised; that changes no result. With a table
of one's own every text is.

Defined results: null and empty texts match nothing; a line counts each time it
stands in a document; line counts are those of the row's own text, whatever other
rows have its doc_id, and whether that is null or not; a repeated row has the same
result as the first; of two known licences with the same digest the smaller id is
reported. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licences and the notices that stand for them.
KNOWN = {
    "MIT": (
        "Copyright (c) <year> <holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Copyright <year> <holder>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        'hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "BSD-2-Clause": (
        "Copyright (c) <year>, <holder>\n\nRedistribution and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "BSD-3-Clause": (
        "Copyright (c) <year>, <holder>\n\nRedistribution and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at\n\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright under the CC0 license.",
}

#: The titles under which these licences are published.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
}
#: Digests (see below) of the published texts of long licences.
LONG = {
    "Apache-2.0-text": "1417d69346fcbd23dc902ca6fc3ab26d33252ef1696d4cd7c6f0fef0abd3226d",
    "GPL-1.0": "44b35cc69c1f864dba217d3e35766425d272b2d229a6cde2e0cdcc67803bddf8",
    "GPL-2.0": "9091b3188640d6723b461e8e012a229d5f77219e2083a669135a30d2b1b4297f",
    "GPL-3.0": "fa0e7d40ef94cf64d9b7c0ab21b7a82627143767e902a38eaaf5c703821c57b8",
    "LGPL-2.0": "2a6ac921e4c62568a2b266e6164cb6819d2a06f7007ad9e187ada8d4770702d2",
    "LGPL-2.1": "0ca5c17aaa8deceea63b6afae195c7b8e4c2457d104e2a35bb62009f9d4d603b",
    "LGPL-3.0": "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0",
    "MPL-1.1": "5aa16067e47a822b554b495ff7af4677e24d8672c24a205ea3050b9cc509139b",
    "MPL-2.0": "16bf53094aa71cdf0e28cf166f759a4fde1cc1e3cae6c443ef8e6bf4157561f4",
    "CC0-1.0": "38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81",
    "GFDL-1.2": "acec3597763489be8ef21cf2e96b3ed208cb48bcddc6c598aff3724672e280f0",
    "GFDL-1.3": "96126db0aa4a0e77dd3344ee5c1afb9c7243997a829d69325ebcb1448f7264e3",
    "Artistic-1.0-Perl": "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",
}

#: Equivalent spellings (left is made right), as published with
#: the public licence-matching guidelines.
SPELLINGS = (
    ("licence", "license"),
    ("sub[ -]license", "sublicense"),
    ("non[ -]commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("behaviour", "behavior"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
)
#: Each known licence has one of these stems.
STEMS = "licen[sc]e|software"
#: A list mark before more text. Texts are on one line by then, so that wrapping does
#: not tell what is one; the last word of a text is none ("version 3.").
MARK = r" \(?([0-9]{1,2}|[a-z])[.)] "
SPACE = r"[\x09-\x0D\x20]+"
_YEAR = r"[\[<{(]?((19|20)[0-9][0-9]|year|yyyy)"
COPYRIGHT = rf"^[^a-z0-9]*(copyright[ \t:]*(\(c\)|©|{_YEAR})|(\(c\)|©)[ \t]*(copyright|{_YEAR})|all rights reserved[^a-z0-9]*$)"
#: Digests that are broadcast at most; a larger table is joined by shuffle.
MOST_BROADCAST = 100_000


def normalised(text: Column) -> Column:
    """Canonical form of a text (empty if nothing is left)."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~line.rlike(COPYRIGHT))
    out = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, SPACE, " ")))
    for _ in range(2):  # two marks side by side share a space
        out = F.regexp_replace(out, MARK, " ")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where the form is empty."""
    form = normalised(text)
    return F.when(form != "", F.sha2(form, 256))


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in short licences, with and without title."""
    plain = list(KNOWN.items())
    return plain + [(k, f"{title}\n\n{KNOWN[k]}") for k, titles in TITLES.items() for title in titles]


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id), one row per digest."""
    bounded = known is None or known.count() <= MOST_BROADCAST
    if known is None:
        entries = [F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in known_texts()]
        known = spark.range(1).select(F.inline(F.array(*entries)))
        long = [F.struct(F.lit(v).alias("digest"), F.lit(k).alias("license_id")) for k, v in LONG.items()]
        more = spark.range(1).select(F.inline(F.array(*long)))
    else:
        more = spark.createDataFrame([], "digest string, license_id string")
    rows = known.select(digest(F.col("text")).alias("digest"), F.col("license_id").cast("string").alias("license_id"))
    rows = rows.where("digest is not null").unionByName(more)
    rows = rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(rows) if bounded else rows


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document row: license_id of the entire text (or null), the number of
    lines that are a known licence, and their ids, sorted and comma-joined. ``known``
    (license_id, text) replaces the built-in table.
    """
    stems = STEMS if known is None else None
    table_of = known_digests(docs.sparkSession, known)
    text = F.col("text")
    if stems is not None:
        text = F.when(F.lower("text").rlike(stems), text)
    key = F.sha2(text, 256)
    rows = docs.select("doc_id", digest(text).alias("digest"), text.alias("text"), key.alias("key"))
    lines = (
        rows.where("text is not null")
        .select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.lower("line").rlike(stems) if stems is not None else F.lit(True))
        .select("doc_id", "key", "pos", digest(F.col("line")).alias("digest"))
        .join(table_of, "digest")
        .select("doc_id", "key", "pos", "license_id")
        .distinct()
    )
    found = lines.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(
        F.count("*").alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"),
    )
    # texts without a digest are spread over all partitions
    spread = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))
    whole = rows.select("doc_id", "key", F.coalesce("digest", spread).alias("digest")).join(table_of, "digest", "left")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    return whole.join(found, same, "left").select(
        "doc_id",
        "license_id",
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda l: NOT regexp_matches(l, {_sql_text(COPYRIGHT)}))"
    form = f"array_to_string({lines}, ' ')"
    for old, new in SPELLINGS:
        form = f"regexp_replace({form}, {_sql_text(old)}, {_sql_text(new)}, 'g')"
    form = f"' ' || trim(regexp_replace({form}, {_sql_text(SPACE)}, ' ', 'g'))"
    for _ in range(2):
        form = f"regexp_replace({form}, {_sql_text(MARK)}, ' ', 'g')"
    form = f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN {form} <> '' THEN sha256({form}) END"


def _plain_digest(text: str) -> str:
    """The digest of an ASCII text in plain Python, apart from the expressions."""
    lines = [x for x in text.lower().split("\n") if not re.search(COPYRIGHT, x)]
    form = " ".join(lines)
    for old, new in SPELLINGS:
        form = re.sub(old, new, form)
    form = " " + re.sub(SPACE, " ", form).strip()
    for _ in range(2):
        form = re.sub(MARK, " ", form)
    return hashlib.sha256(re.sub("[^a-z0-9]+", " ", form).strip().encode()).hexdigest()


_KNOWN_ROWS = sorted({(_plain_digest(v), k) for k, v in known_texts()} | {(v, k) for k, v in LONG.items()})

ORACLE = f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(d)}, {_sql_text(k)})" for d, k in _KNOWN_ROWS)}) AS t(digest, license_id)
  GROUP BY digest),
rows AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql_digest("text")} AS digest FROM documents),
split AS (SELECT r, string_split(text, chr(10)) AS parts FROM rows),
numbered AS (SELECT r, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
lines AS (
  SELECT DISTINCT n.r, n.pos, k.license_id
  FROM (SELECT r, pos, {_sql_digest("line")} AS digest FROM numbered) n JOIN known k USING (digest)),
found AS (
  SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS ids
  FROM lines GROUP BY r)
SELECT rows.doc_id, k.license_id, coalesce(f.n, 0) AS n_license_lines, coalesce(f.ids, '') AS line_licenses
FROM rows LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.r = rows.r
"""

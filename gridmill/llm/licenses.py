"""License scans by canonical digest lookup.

A text is brought into one form: lower case; anything but letters and digits
becomes space; lines that state a copyright go; equivalent spellings become
one. The digest of the whole canonical text is joined with those of known
licences by a hash join. So is the digest of each line, since a licence is often
stated in one line of a longer text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests at most; they travel to every task.
MOST_KNOWN = 100_000

#: The licences' public texts and usual statements.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NOR = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
#: (SPDX id, title, text without the title and the copyright line).
TEXTS = [
    ("MIT", "MIT License", f"{_GRANT}\n\n{_NOTICE}\n\n{_AS_IS}"),
    ("MIT", "The MIT License (MIT)", f"{_GRANT}\n\n{_NOTICE}\n\n{_AS_IS}"),
    ("MIT-0", "MIT No Attribution", f"{_GRANT.replace(', subject to the following conditions:', '.')}\n\n{_AS_IS}"),
    ("ISC", "ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", "BSD Zero Clause License", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD}\n\n{_BSD_END}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD}\n\n{_NOR}\n\n{_BSD_END}"),
    ("Zlib", "zlib License", _ZLIB),
    ("Unlicense", "The Unlicense", _UNLICENSE),
    ("Unlicense", "The Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
]
#: Canonical digests of longer licences' published texts, whole and without the appendix on how to apply them.
DIGESTS = [
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64"),
    ("GFDL-1.2", "8d636e2e2f248f9b102e9d9f78337901ec8bca3bfe91434cdcf261a01bf305b1"),
    ("GFDL-1.3", "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55"),
    ("GFDL-1.3", "8b8b57bd195ed50d50edb5da1dd173b409fb9b075910c69726be7d0363c40008"),
    ("GPL-1.0", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "638998d30657a492dd691a5a381b26a0b205ce964daf74aee30d9b3d0302c8e8"),
    ("MPL-1.1", "f491de9801c3d87979f566bb81424677813c00227954fbaf7e652d8de9aff98f"),
    ("MPL-2.0", "3599de37bcef5820a1933fc9b0c5b5389b95fa5dc39cb6e05f4764ef1c2f2439"),
    ("MPL-2.0", "eb576dad4d96c0a87cf0b9c6d490dccb5e568ff19465272364340afb951ebb24"),
]
#: SPDX ids, and the names under which statements speak of a licence.
NAMES = [
    ("MIT", ["MIT License", "MIT"]), ("ISC", ["ISC License"]), ("0BSD", ["BSD Zero Clause License"]), ("Zlib", ["zlib License"]), ("Unlicense", ["Unlicense"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]), ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "Modified BSD License"]),
    ("MPL-1.1", ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"]), ("MPL-2.0", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"]),
    ("EPL-2.0", ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"]),
    *((f"{short}-{v}", [f"GNU {name}, version {v2}", f"GNU {name} version {v2}", f"GNU {name} v{v2}", f"{short}v{v2}", f"{short} {v2}"])
      for short, name in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"))
      for v, v2 in (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3"), ("3.0", "3.0")) if (short == "LGPL") >= (v == "2.1") and (short, v) != ("AGPL", "2.0")),
    ("CC0-1.0", ["CC0 1.0", "CC0", "CC0 1.0 Universal"]),
    *((f"CC-{x}-{v}", [f"CC {x} {v}", f"CC-{x} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International License"])
      for x, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"))
      for v in ("3.0", "4.0")),
]
#: What says that a work is under a licence.
_WORKS = ["", *(f"This {w} is " for w in ("work", "project", "software"))]
_VERBS = ["Licensed under", "Released under", "Distributed under"]
_TERMS = ["", "the ", "the terms of the "]


def statements() -> list[tuple[str, str]]:
    """(id, line): the lines that state a licence, made from ids, names and usual words."""
    named = [(i, f"{work}{verb} {terms}{name}") for i, names in NAMES for name in names for work in _WORKS for verb in _VERBS for terms in _TERMS]
    ids = sorted({i for i, _ in NAMES} | {i for i, _, _ in TEXTS} | {i for i, _ in DIGESTS})
    tags = [(i, f"SPDX-License-Identifier: {i}{more}") for i in ids for more in (["", "-only", "-or-later"] if "GPL" in i else [""])]
    return named + tags + [(i, f"License: {name}") for i, names in NAMES for name in names]


#: Texts with and without title.
KNOWN = [*((i, text) for i, _, text in TEXTS), *((i, f"{title}\n\n{text}") for i, title, text in TEXTS), *statements()]
#: Equivalent spellings, the second standing for both.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("merchantable", "merchantability"), ("organisation", "organization"),
    ("per cent", "percent"), ("recognised", "recognized"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A canonical line that states a copyright.
COPYRIGHT = r"^(portions )?(copyright |c )+.*\b(19|20)[0-9]{2}\b"


def canonical_line(line: Column) -> Column:
    words = F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[^\p{L}\p{N}]+", " "))
    words = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for spelling, one in SPELLINGS:
        words = F.replace(words, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones and copyright statements."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(x.contains("©"), F.lit("")).otherwise(canonical_line(x)))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def _digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """digest, license of the known texts and lines; of two ids with one canonical form the lesser."""
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    lines = canonical_lines(F.col("text"))
    rows = spark.createDataFrame(known, "license string, text string").where(F.size(lines) > 0).select(_digest(F.array_join(lines, " ")).alias("digest"), "license")
    return rows.union(spark.createDataFrame(digests, "license string, digest string").select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Look up whole texts, and their lines, among known licences.

    docs: doc_id, text; known: (name, text) pairs, in place of the lists above.
    Returns doc_id, digest (of the canonical whole text), license (whose whole
    text it is, or null), n_lines (lines that state a licence), licenses (names
    found either way, sorted, comma-joined), a row for each input row, repeated
    rows included. A null or empty text, or one with nothing left in canonical
    form, has the digest of no bytes and no licence; long texts count whole.
    Other columns, of whatever name, are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    table = F.broadcast(known_digests(spark, KNOWN if known is None else known, DIGESTS if known is None else []))
    # counting lines by row sums up inside a task first, so a row leaves it once
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    each = lines.select("row", "doc_id", _digest(F.array_join("lines", " ")).alias("whole"), F.explode_outer("lines").alias("line"))
    stated = each.withColumn("digest", _digest(F.col("line"))).join(table, "digest", "left")
    rows = stated.groupBy("row", "doc_id", "whole").agg(F.count("license").alias("n_lines"), F.collect_set("license").alias("stated"))
    joined = rows.withColumnRenamed("whole", "digest").join(table, "digest", "left")
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat("stated", F.array("license")))))
    return joined.select("doc_id", "digest", "license", "n_lines", F.array_join(every, ",").alias("licenses"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    line = f"trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    line = f"' ' || replace({line}, ' ', '  ') || ' '"
    for spelling, one in SPELLINGS:
        line = f"replace({line}, ' {spelling.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
    line = f"CASE WHEN contains(x, '©') THEN '' ELSE trim(replace({line}, '  ', ' ')) END"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {line}), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"


_SQL_KNOWN = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)
_SQL_DIGESTS = ", ".join(f"({_sql_text(n)}, {_sql_text(d)})" for n, d in DIGESTS)
SQL = f"""
WITH texts AS (SELECT license, {_sql_lines('text')} AS lines FROM (VALUES {_SQL_KNOWN}) AS k(license, text)),
known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256(array_to_string(lines, ' ')) AS digest FROM texts WHERE len(lines) > 0
  UNION ALL SELECT license, digest FROM (VALUES {_SQL_DIGESTS}) AS d(license, digest)) AS u GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines('text')} AS lines FROM documents),
s AS (SELECT r, list(license) AS stated FROM (SELECT r, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest) GROUP BY r),
w AS (SELECT d.r, doc_id, sha256(array_to_string(lines, ' ')) AS digest, coalesce(stated, []) AS stated FROM d LEFT JOIN s ON d.r = s.r)
SELECT doc_id, w.digest, license, len(stated) AS n_lines,
  array_to_string(list_sort(list_distinct(list_filter(list_append(stated, license), lambda x: x IS NOT NULL))), ',') AS licenses
FROM w LEFT JOIN known ON w.digest = known.digest
"""

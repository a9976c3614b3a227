"""Licence scans by digests of canonical texts.

A text is brought to a canonical form - case, punctuation, a title, copyright lines and equivalent
spellings no longer matter - and its digest is joined to those of known licences, a table that the caller may
give. Whole documents are looked up by a hash join, with the known table broadcast if it is small; notices of one line, such as
"Released under the MIT License.", are whole texts too and are looked up the same way among the
digests of a document's lines, without moving the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.llm.shared import cut

#: Up to so many known texts (a digest and an identifier each) are broadcast.
FEW = 100_000

# Fixed values: (identifier, whole text) of licences short enough to state here.
KNOWN_TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
)
# Notices of one line and the licence they declare.
KNOWN_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("0BSD", "BSD Zero Clause License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
)
# Spellings taken as equal, as they stand in canonical text; the left becomes the right.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("behaviour", "behavior"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("categoris", "categoriz"),
    ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"),
    ("honour", "honor"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("maximis", "maximiz"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("practise", "practice"), ("programme ", "program "), ("realis", "realiz"), ("recognis", "recogniz"),
    ("signalling", "signaling"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("share alike", "sharealike"),
)
# Words that go on after `copyright` in the prose of licences, where no owner is named.
PROSE = (
    "act", "and", "applies", "as", "disclaimer", "for", "grant", "grants", "holder", "holders", "in", "infringement", "interest",
    "interests", "is", "law", "laws", "license", "licenses", "notice", "notices", "of", "on", "or", "owner", "owners", "permission",
    "permissions", "protection", "registration", "right", "rights", "statement", "statements", "that", "to", "treaty", "under", "which", "with",
)
#: What such lines begin with is marked, so that COPYRIGHT leaves them.
KEPT = r"(^|\n)([ \t*#/;.-]*copyright[ \t]+(" + "|".join(PROSE) + r")([^a-z]|$))"
#: Lines that name a copyright's owner, in lower-cased text: by a year, a name, or a place for one in brackets.
COPYRIGHT = r"(^|\n)[ \t*#/;.-]*(copyright([ \t,:]+|[(©:,])[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\n]*)"
#: A title before the text: its first line, if that is a name that ends in `license`.
TITLE = r"^[\s*#=-]*(the )?[a-z0-9 ,.\"'-]{1,60} licen[sc]e([ \t]*\([^)\n]*\))?[ \t*#=-]*\n"
#: Runs of ASCII control characters, spaces and punctuation but line feeds, and typographic quotes and dashes.
_SINGLE = (*range(0, 10), *range(11, 32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128), 0xA9)
_MARK = "".join(f"\\x{c:02X}" for c in _SINGLE) + r"\x{2013}-\x{201D}"  # one by one: a table lookup in Java's matcher
#: Such runs but a single space, which stays as it is: most gaps between words need no replacing.
MARKS = f"[{_MARK}][{_MARK} ]*| [{_MARK} ]+"
#: Runs of spaces and line feeds but a single space.
GAPS = r"\n[ \n]*| [ \n]+"


def canonical(text: Column) -> Column:
    """The canonical form, its lines kept apart by line feeds."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), KEPT, "$1\x01$2")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, "$1"), TITLE, "")
    out = F.regexp_replace(out, MARKS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _one_line(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, GAPS, " "))


def built_in(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(known), "license_id string, text string")


def read_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) of a folder of whole licence texts, one a file named by its identifier (an ending .txt goes).

    Such folders come with operating systems and with public licence lists; hand the rows, together with
    `built_in(spark, KNOWN_TEXTS)` if wished, to `scan_licenses`.
    """
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return files.select(name.alias("license_id"), F.col("value").alias("text"))


def known_digests(rows: DataFrame) -> DataFrame:
    """(digest, license_id) of known texts (license_id, text), one row for each digest: the first id in order."""
    return rows.select("license_id", F.md5(_one_line(canonical(F.col("text"))).cast("binary")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", texts: DataFrame | None = None, notices: tuple = KNOWN_NOTICES) -> DataFrame:
    """One row per input row: (doc_id, digest, license_id, notices).

    digest is the MD5 of the whole canonical text, license_id the known licence whose digest it is
    (a text of a single notice counts too), null if none. `texts` are the known whole texts
    (license_id, text), by default KNOWN_TEXTS; see `read_licenses`. notices lists the licences declared
    by single lines, sorted, without repeats, joined by commas; empty if none. Null and empty texts have
    the digest of an empty text. Repeated rows each give a row; extra columns are ignored.
    """
    spark = docs.sparkSession
    whole = texts.select("license_id", "text") if texts is not None else built_in(spark, KNOWN_TEXTS)
    whole = cut(known_digests(whole.union(built_in(spark, notices))))
    if whole.count() <= FEW:
        whole = F.broadcast(whole)
    # The table of notices is fixed and small: its digests are a literal array in the plan.
    lines = sorted((r.digest, r.license_id) for r in known_digests(built_in(spark, notices)).collect())
    digests, names = F.array(*[F.lit(d) for d, _ in lines]), F.array(*[F.lit(n) for _, n in lines])
    canon = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text)).alias("canon"))
    of_lines = F.transform(F.split("canon", "\n"), lambda s: F.md5(F.trim(s).cast("binary")))
    said = F.transform(F.array_intersect(of_lines, digests), lambda d: F.get(names, F.array_position(digests, d) - 1))
    scanned = canon.select(
        "doc_id",
        F.md5(_one_line(F.col("canon")).cast("binary")).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(said)), ",").alias("notices"),
    )
    return scanned.join(whole, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """The canonical form in DuckDB's SQL."""
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(KEPT)}, '\\1' || chr(1) || '\\2', 'g')"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT)}, '\\1', 'g')"
    out = f"regexp_replace({out}, {_quoted(TITLE)}, '')"
    out = f"regexp_replace({out}, {_quoted(MARKS)}, ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_values(known: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in known)


_SQL_ONE_LINE = f"trim(regexp_replace(canon, '{GAPS}', ' ', 'g'))"
SQL = f"""
WITH known AS (
  SELECT md5({_SQL_ONE_LINE}) AS digest, min(id) AS license_id, bool_or(notice) AS notice
  FROM (SELECT id, {_sql_canonical('t')} AS canon, false AS notice FROM (VALUES {_sql_values(KNOWN_TEXTS)}) v(id, t)
        UNION ALL
        SELECT id, {_sql_canonical('t')} AS canon, true AS notice FROM (VALUES {_sql_values(KNOWN_NOTICES)}) v(id, t))
  GROUP BY 1
), canons AS (SELECT doc_id, {_sql_canonical('text')} AS canon FROM documents),
said AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, md5(trim(unnest(string_split(canon, chr(10))))) AS digest FROM canons) JOIN known USING (digest)
  WHERE notice GROUP BY doc_id
)
SELECT doc_id, md5({_SQL_ONE_LINE}) AS digest, license_id, coalesce(notices, '') AS notices
FROM canons LEFT JOIN known ON known.digest = md5({_SQL_ONE_LINE}) LEFT JOIN said USING (doc_id)
"""

"""License scans by canonical digest.

A text's canonical form: A-Z become a-z; copyright notices (the word followed by (c), a copyright sign or a year) go, up to
the end of their line or to the words that open a license on the same line; spellings that license texts treat as equal
become one; all else than a-z and 0-9 becomes single spaces. The SHA-256 of it is joined with the digests of known license
texts: of the entire text, and of each line on its own, as license notices are often one line among others. The known
digests are a table of the caller: up to LITERAL lines are tested against a constant set; beyond, they are exploded and
joined, and what was found goes back to rows of the same lines. Both give the same rows. KNOWN holds the whole texts and
notices that are known here; other licenses are found only with a table that has them.

A null text has a null digest and no license. An empty canonical form matches nothing. Several known ids of one digest
count as the first by name. Repeated rows and ids give repeated result rows, each by its own text. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import bounded, cut

LITERAL = 1000
"""Known digests up to which lines are looked up in a constant; beyond, lines are exploded and joined."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Spellings that license matching guidelines treat as equal.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("categoris", "categoriz"),
    ("emphasise", "emphasize"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"), ("licence", "license"),
    ("maximis", "maximiz"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("all rights reserved", ""),
]
NOTICE = "copyright[ \t]*(?:\\(c\\)|©|[0-9][0-9][0-9][0-9])[^\n]*?(permission |permission\n|redistribution |licensed |released |this |\n|\\z)"
"""A notice, and what ends it, which stays."""

# Public license texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
WHOLE = [
    ("MIT", "MIT License", MIT), ("MIT", "The MIT License (MIT)", MIT), ("ISC", "ISC License", ISC), ("BSD-2-Clause", "BSD 2-Clause License", BSD2 + "\n" + DISCLAIMED), ("BSD-3-Clause", "BSD 3-Clause License", BSD3 + "\n" + DISCLAIMED),
    ("0BSD", "BSD Zero Clause License", ZERO_BSD), ("MIT-0", "MIT No Attribution", MIT.replace(MIT.split("\n\n")[1] + "\n\n", "").replace(", subject to the following conditions:", ".")), ("Zlib", "zlib License", ZLIB),
    ("Unlicense", "The Unlicense", UNLICENSE), ("Unlicense", "The Unlicense", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", "The Unlicense", UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", BOOST), ("Apache-2.0", "", APACHE_NOTICE),
]
# Names as notices give them.
NAMES = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"),
         ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License 2.0"),
         ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("EPL-2.0", "Eclipse Public License 2.0"), ("Unlicense", "Unlicense")]
CREATIVE = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
OPENINGS = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "This project is licensed under the {}."]
KNOWN = sorted({
    *((i, t) for i, _, t in WHOLE), *((i, f"{title}\n\n{t}") for i, title, t in WHOLE if title), *((i, o.format(n)) for i, n in NAMES for o in OPENINGS),
    *((f"CC-{c}-4.0", o.format(n)) for c in CREATIVE for o in (x.replace("the {}", "{}") for x in OPENINGS) for n in (f"CC {c} 4.0", f"a CC {c} 4.0 license")),
})


def _spelled(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    x = F.when(F.contains(low, F.lit("copyright")), F.regexp_replace(low, NOTICE, " $1")).otherwise(low)
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def canonical(text: Column) -> Column:
    return _plain(_spelled(text))


def known_digests(known: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """known_digest, known_id of license texts."""
    form = canonical(F.col(text_col))
    return known.where(form != "").groupBy(F.sha2(form, 256).alias("known_digest")).agg(F.min(id_col).alias("known_id"))


def scan(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text", literal: int = LITERAL) -> DataFrame:
    """doc_id, digest, license_id (of the entire text, or null), line_licenses (sorted ids of lines, joined by commas)."""
    known = bounded(digests, 64 << 20)
    spelled = docs.select(F.col(id_col).alias("doc_id"), _spelled(F.col(text_col)).alias("s"))
    rows = spelled.select("doc_id", F.sha2(_plain(F.col("s")), 256).alias("digest"), F.filter(F.transform(F.split("s", "\n"), _plain), lambda x: x != "").alias("lines"))
    few = digests.limit(literal + 1).collect()
    if len(few) <= literal:  # a constant set, so that lines need not be exploded
        names = [r["known_digest"] for r in few]
        table = F.create_map(*[F.lit(x) for r in few for x in (r["known_digest"], r["known_id"])]) if few else F.create_map().cast("map<string,string>")
        there = F.filter(F.transform("lines", lambda x: F.sha2(x, 256)), lambda x: x.isin(names))
        hit = F.array_sort(F.array_distinct(F.transform(there, lambda x: F.element_at(table, x))))
        whole = rows.select("doc_id", "digest", F.array_join(hit, ",").alias("hit"))
    else:  # what lines give depends on them alone, so rows of equal lines share it
        keyed = cut(rows.select("doc_id", "digest", F.struct(F.xxhash64("lines").alias("a"), F.xxhash64(F.lit(1), "lines").alias("b")).alias("row"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines")), "lines")
        hits = keyed.select("row", F.explode("lines").alias("known_digest")).join(known, "known_digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("known_id")), ",").alias("hit"))
        whole = keyed.drop("lines").join(hits, "row", "left")
    found = whole.join(known, F.col("digest") == F.col("known_digest"), "left")
    return found.select("doc_id", "digest", F.col("known_id").alias("license_id"), F.coalesce("hit", F.lit("")).alias("line_licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(KNOWN, "license_id string, text string")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(known))


def _sql_spelled(x: str) -> str:
    x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{NOTICE}', ' \\1', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_plain(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'), ' ')"


def _sql_known() -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in ((i, t.replace("'", "''")) for i, t in KNOWN))
    return f"SELECT sha256({_sql_plain(_sql_spelled('t'))}) AS kd, min(i) AS ki FROM (VALUES {rows}) AS v(i, t) GROUP BY kd"


OP9_SQL = f"""
WITH known AS ({_sql_known()}),
d AS (SELECT doc_id, {_sql_spelled("text")} AS s FROM documents),
w AS (SELECT doc_id, sha256({_sql_plain("s")}) AS digest FROM d),
l AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS line FROM d),
h AS (SELECT doc_id, string_agg(DISTINCT ki, ',' ORDER BY ki) AS hit FROM (SELECT doc_id, sha256({_sql_plain("line")}) AS ld FROM l) JOIN known ON ld = kd GROUP BY doc_id)
SELECT w.doc_id, w.digest, known.ki AS license_id, coalesce(h.hit, '') AS line_licenses
FROM w LEFT JOIN known ON w.digest = known.kd LEFT JOIN h ON h.doc_id = w.doc_id
"""

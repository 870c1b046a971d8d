"""License scans by canonical digest lookup.

A text is brought into a canonical form (lower case, no punctuation, no
copyright lines, one spelling) and the digest of all of it is joined to the
digests of known license texts. Whole documents, their paragraphs and their
single lines are looked up: a line, or a paragraph where it is wrapped, is the
whole text of a license notice.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.runtime import free_name, small

#: A line, in lower case, that states a copyright: a year, a sign, "by" or a placeholder must follow. Others that begin so are a text's own.
COPYRIGHT = r"^[ \t*#/;-]*(?:copyright\b[^\n]*(?:(?:19|20)[0-9][0-9]|\(c\)|©|<year>|\[year\]|yyyy)|copyright[ \t]+by\b|\(c\)[ \t]*(?:copyright[ \t]*)?(?:19|20)[0-9][0-9]|©|all rights reserved[.!]?[ \t\r]*$)"

#: Spellings that count as one; applied in this order after punctuation is gone.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("wilful", "willful"), ("fulfilment", "fulfillment"), ("redistribution s", "redistributions")]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE_END = "\n\nFor more information, please refer to "
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC[_ISC.index("THE SOFTWARE IS"):]
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

#: (license, text): full texts of the short licenses, and notices that stand for a license.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_3 + _BSD_TAIL), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", _MIT.split("\n\n")[0]), ("ISC", _ISC.split("\n\n")[0]), ("MIT", "SPDX-License-Identifier: MIT License"),
    *[("Unlicense", head + _UNLICENSE + end) for head in ("", "The Unlicense\n\n") for end in ("", _UNLICENSE_END + "<http://unlicense.org/>", _UNLICENSE_END + "<https://unlicense.org>", _UNLICENSE_END + "<https://unlicense.org/>")],
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("0BSD", _ZERO), ("0BSD", "BSD Zero Clause License\n\n" + _ZERO),
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("0BSD", "Zlib", "Unlicense", "BSL-1.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0")],
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    *[(f"GPL-{v}.0", text) for v in (2, 3) for text in (f"This work is licensed under the GNU General Public License, version {v}.", f"Licensed under the GNU General Public License, version {v}.", f"Released under the GNU General Public License, version {v}.")],
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    *[(f"CC-BY{s}-4.0", f"{how} under CC BY{s} 4.0.") for s in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND") for how in ("Licensed", "This work is licensed", "Released")],
    ("CC0-1.0", "Released under CC0 1.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]


#: (license, digest of the canonical form): full texts too long to be held here, as Debian's common-licenses has them.
FULL: list[tuple[str, str]] = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]


def canonical(text: str) -> str:
    """The canonical form, for one text in Python; canonical_lines() is the same in Spark."""
    lines = []
    for line in text.split("\n"):
        line = line.lower()
        if re.match(COPYRIGHT, line):
            continue
        line = re.sub(r"[\W_]+", " ", line).strip(" ")
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        if line:
            lines.append(line)
    return " ".join(lines)


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def canonical_lines(text: Column) -> Column:
    """Canonical forms of all lines; copyright lines become empty."""

    def one(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
        for a, b in SPELLINGS:
            plain = F.replace(plain, F.lit(a), F.lit(b))
        return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(plain)

    return F.transform(F.split(F.lower(text), "\n"), one)


def known_digests(spark: SparkSession, known: list[tuple[str, str]], full: list[tuple[str, str]]) -> DataFrame:
    rows = sorted({(digest(text), name) for name, text in known if canonical(text)} | {(d, name) for name, d in full})
    return spark.createDataFrame(rows, "_digest string, license string")


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text", full: list[tuple[str, str]] = FULL) -> DataFrame:
    """(id, unit, line_no, license) for every document, paragraph or line that is, as a whole, a known text.

    unit is 'document' (line_no 0), 'line' or 'paragraph', each numbered from 1 in
    line_no. A paragraph is two lines and more without an empty line between them;
    lines of punctuation or of a copyright statement count as empty. A document of
    one line is reported under both units. Null and empty texts, and texts of
    punctuation or copyright lines alone, match nothing. Letters and digits of every
    script belong to the canonical form. A text known under two names gives a row for
    each. Repeated rows are reported again, null ids as null. An id column with the
    name of a result's gets "_" after it. Other columns are ignored. An empty table
    gives no rows.
    """
    lines = docs.select(F.col(id_col).alias("_id"), canonical_lines(F.col(text_col)).alias("_lines"))
    whole = F.array_join(F.filter("_lines", lambda x: x != ""), " ")
    blocks = F.filter(F.split(F.array_join("_lines", "\n"), "\n\n+"), lambda x: x != "")
    paragraphs = F.transform(blocks, lambda x: F.when(F.contains(F.trim(x, F.lit("\n")), F.lit("\n")), F.replace(F.trim(x, F.lit("\n")), F.lit("\n"), F.lit(" "))).otherwise(""))
    parts = F.array(F.struct(F.lit("document").alias("unit"), F.array(whole).alias("of")), F.struct(F.lit("line").alias("unit"), F.col("_lines").alias("of")), F.struct(F.lit("paragraph").alias("unit"), paragraphs.alias("of")))
    kinds = lines.select("_id", F.explode(parts).alias("_part"))
    units = kinds.select("_id", F.col("_part.unit").alias("unit"), F.posexplode("_part.of").alias("_no", "_unit")).where("_unit <> ''")
    keyed = units.select("_id", "unit", F.when(F.col("unit") == "document", 0).otherwise(F.col("_no") + 1).alias("line_no"), F.sha2("_unit", 256).alias("_digest"))
    found = keyed.join(small(known_digests(docs.sparkSession, known, full)), "_digest")
    return found.select(F.col("_id").alias(free_name(id_col, "unit", "line_no", "license")), "unit", F.col("line_no").cast("int").alias("line_no"), "license")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """SQL that gives the same rows."""
    line = "trim(regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{name}')" for d, name in sorted({(digest(t), n) for n, t in KNOWN} | {(d, n) for n, d in FULL}))
    return f"""
WITH known(digest, license) AS (VALUES {values}),
lines AS (SELECT doc_id, list_transform(string_split(lower(text), chr(10)), lambda l: CASE WHEN regexp_matches(l, '{COPYRIGHT}') THEN '' ELSE {line} END) AS ls FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, list_transform(list_filter(string_split_regex(array_to_string(ls, chr(10)), '\\n\\n+'), lambda x: x <> ''), lambda x: trim(x, chr(10))) AS ps FROM lines),
units AS (SELECT doc_id, 'document' AS unit, 0 AS line_no, array_to_string(list_filter(ls, lambda x: x <> ''), ' ') AS u FROM lines
          UNION ALL SELECT doc_id, 'line', unnest(range(1, len(ls) + 1))::INT, unnest(ls) FROM lines
          UNION ALL SELECT doc_id, 'paragraph', unnest(range(1, len(ps) + 1))::INT, unnest(list_transform(ps, lambda x: CASE WHEN contains(x, chr(10)) THEN replace(x, chr(10), ' ') ELSE '' END)) FROM blocks)
SELECT doc_id, unit, line_no::INT AS line_no, license
FROM units JOIN known ON sha256(u) = digest WHERE u <> ''
"""

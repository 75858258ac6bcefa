"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical (case, a title line, copyright lines, equivalent
spellings, punctuation), digested, and the digest of the entire text is joined to
those of known licences: a table of names and digests. ``licence_table`` makes it,
from any list of names and texts; the list here holds short licences and notices
as texts, long ones by the digest of their canonical text alone. Lines that speak
of a licence are digested alone as well, so a notice inside a longer text is found
too.

Defined cases: a null or empty text has the digest of the empty string and no
licence; a text of copyright lines only likewise; repeated rows give repeated
results; two known licences of equal digest: the smaller name; an empty table
gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents

#: Known licences and notices: name, text. Fixed values.
KNOWN = [
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0 header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]

#: Names of long public licences and the SHA-256 of their canonical texts. Fixed values.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause (Regents)", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]|\[|<)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
TITLE = r"^[\s#*/;=-]*(the )?((mit|isc|x11|zlib|zlib/libpng|boost software|(new |simplified |modified |revised )?bsd( [0-9]-clause)?) licen[sc]e|unlicense)( \([a-z0-9 /-]+\)| - version 1\.0 - august 17th, 2003| [a-z0-9 .-]{1,12})?[\s:.=-]*\n"
PUNCTUATION = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f‘’“”–—]+"
#: Spellings taken as equal, on canonical text. Fixed values.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("authorise", "authorize"), ("organisation", "organization"), ("whilst", "while"), ("merchantibility", "merchantability"), ("https", "http")]
MENTION = r"licen[sc]e"


def canonical(text: Column) -> Column:
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    x = F.regexp_replace(F.regexp_replace(x, TITLE, "\n"), COPYRIGHT_LINE, "\n")
    x = F.trim(F.regexp_replace(x, PUNCTUATION, " "))
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, x)


def canonical_sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    x = f"regexp_replace({x}, {quoted(TITLE)}, chr(10))"
    x = f"regexp_replace({x}, {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    x = f"trim(regexp_replace({x}, {quoted(PUNCTUATION)}, ' ', 'g'))"
    return reduce(lambda x, pair: f"replace({x}, {quoted(pair[0])}, {quoted(pair[1])})", SPELLINGS, x)


def licence_table(texts: DataFrame, name: str = "licence_id", text: str = "licence_text") -> DataFrame:
    """(canonical_sha256, licence_id), a row for each digest, from a table of names and whole texts."""
    return texts.groupBy(F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256")).agg(F.min(name).alias("licence_id"))


def digests(spark: SparkSession, known: Iterable[tuple[str, str]] = KNOWN, more: Iterable[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """licence_table of a list of names and texts, with a list of names and digests."""
    made = licence_table(spark.createDataFrame(list(known), "licence_id string, licence_text string"))
    given = spark.createDataFrame(list(more), "licence_id string, canonical_sha256 string").select("canonical_sha256", "licence_id")
    return made.union(given).groupBy("canonical_sha256").agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", known: Iterable[tuple[str, str]] = KNOWN, more: Iterable[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(doc_id, canonical_sha256, licence_id or null, notices: the known notices among its lines, by name, comma-joined).

    The known list's size is set by the caller's literals, not by the data; it is
    broadcast, so a licence that a third of all rows holds moves no rows.
    """
    table = digests(docs.sparkSession, known, more)
    lines = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "\n"), lambda x: x.rlike(MENTION))
    found = F.transform(lines, lambda x: F.sha2(canonical(x), 256))
    base = docs.select(F.col(key).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"), found.alias("__lines"))
    names = {d: n for d, n in table.collect()}  # as many as the caller's lists have
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.filter(F.transform("__lines", lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())
    notices = F.array_join(F.array_sort(F.array_distinct(found)), ",")
    return base.join(F.broadcast(table), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence_id", notices.alias("notices"))


def match_licences(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_sha256, licence_id or null) against a licence_table of any size: a hash join on the digests."""
    base = docs.select(F.col(key).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    return base.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence_id")


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def _quoted_list(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in rows)


OP8_SQL = f"""
WITH known AS (
  SELECT digest, min(licence_id) AS licence_id FROM (
    SELECT sha256({canonical_sql("licence_text")}) AS digest, licence_id FROM (VALUES {_quoted_list(KNOWN)}) AS v(licence_id, licence_text)
    UNION ALL SELECT digest, licence_id FROM (VALUES {_quoted_list(KNOWN_DIGESTS)}) AS d(licence_id, digest)) GROUP BY 1
), whole AS (
  SELECT row_number() OVER () AS rid, doc_id, text, sha256({canonical_sql("text")}) AS canonical_sha256 FROM documents
), lines AS (
  SELECT rid, unnest(string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10))) AS line FROM whole
), notices AS (
  SELECT rid, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notices
  FROM lines JOIN known ON sha256({canonical_sql("line")}) = digest
  WHERE regexp_matches(line, '{MENTION}') GROUP BY 1
)
SELECT doc_id, canonical_sha256, licence_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN notices USING (rid)
"""

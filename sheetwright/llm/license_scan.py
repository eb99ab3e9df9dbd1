"""License scan by canonical digest: whole texts against known license texts, lines against known notices.

A text is made canonical (A-Z lower-cased; copyright statements and lines that only name a license out, whatever
way the text is wrapped; equivalent spellings made one; everything but letters, marks and digits of any script one
blank) and hashed with SHA-256; the digests are hash-joined with those of the known texts. The known texts
go through the same function. DataFrame functions only.

Edge cases: null and empty texts match nothing; of known texts with one digest the
least id is given; each input row gives one row; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_or_empty

#: Fixed values: (id, text) of short license texts and of one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = (("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL))
#: Short texts; of those with clauses, with numbers and with other bullets.
_BULLETS = tuple((i, t.replace("\n1.", "\n*").replace("\n2.", "\n*").replace("\n3.", "\n*")) for i, t in _BSD)
LICENSES = (("0BSD", _0BSD), *_BSD, *_BULLETS, ("ISC", _ISC), ("MIT", _MIT), ("Zlib", _ZLIB))
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: After lower-casing: copyright statements with a sign, a year or a colon, and lines that only name a license. A line ends at \n alone.
STATEMENT = r"^[ \t]*(?:(?:portions[ \t]+)?copyright[ \t]*(?:\(c\)|©|:|[\[<{(]?(?:[0-9]{4}|y{4}|year))|\(c\)[ \t]|©)[^\n]*$|^[ \t]*all rights reserved[. \t\r]*$"
TITLE = r"^[ \t#]*(?:the[ \t]+)?(?:mit|expat|isc|zlib|0bsd|(?:bsd[ \t]+)?zero[- ]clause(?:[ \t]+bsd)?|(?:new |simplified )?bsd(?:[ -][23][- ]clause)?|[23][- ]clause bsd)[ \t]+licen[cs]e(?:[ \t]+\([^)\n]*\))?[:. \t\r]*$"
#: Equivalent spellings, after lower-casing.
SPELLINGS = (("licence", "license"), ("acknowledgement", "acknowledgment"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("&", " and "))
HYPHENS, NO_WORD = "[\u2010\u2011]", r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(ascii_lower(text), f"(?md){STATEMENT}", ""), f"(?md){TITLE}", "")
    text = F.regexp_replace(text, HYPHENS, "-")
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return F.btrim(F.regexp_replace(text, NO_WORD, " "))


def license_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(license_id, text) of files of license texts, named by their ids, for ``scan_licenses``: such as Apache-2.0, GPL-3 or MPL-2.0."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return rows.select(F.regexp_replace("name", r"\.(txt|md)$", "").alias("license_id"), "text")


def known_digests(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of known (license_id, text), each digest once."""
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(license_id, text): the built-in short texts, and those of a folder that executors can read."""
    own = spark.createDataFrame(list(LICENSES), "license_id string, text string")
    return own.unionByName(license_files(spark, folder)) if folder else own


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (null: no known text), notices (array, in the order of the lines).

    licenses, notices: (license_id, text), by default the built-in ones. Spark broadcasts their digests below its threshold
    and shuffles them beyond it. Lines take part if they hold the word license in either spelling.
    """
    spark = docs.sparkSession
    whole = cut(known_digests(known_licenses(spark) if licenses is None else licenses), "license-digests")
    line = notices if notices is not None else spark.createDataFrame(list(NOTICES), "license_id string, text string")
    line = cut(known_digests(line), "notice-digests").select(F.col("digest").alias("line"), F.col("license_id").alias("notice"))
    word = "(?i)licen[cs]e"
    body = F.col("body")
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(word)), lambda x: F.sha2(canonical(x), 256))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty(F.col("text")).alias("body"))
    rows = rows.select("row", "doc_id", F.sha2(canonical(body), 256).alias("digest"), F.when(body.rlike(word), lines).alias("lines"))
    rows = rows.select("row", "doc_id", "digest", F.posexplode_outer("lines").alias("at", "line"))
    rows = rows.join(whole, "digest", "left").join(line, "line", "left")
    found = F.collect_list(F.when(F.col("notice").isNotNull(), F.struct("at", F.col("notice").alias("license_id"))))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("license_id").alias("license_id"),
        F.transform(F.sort_array(found), lambda x: x["license_id"]).alias("notices"),
    )

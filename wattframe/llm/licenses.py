"""Licence scans by canonical digests.

Texts are brought to one form (case, punctuation, copyright lines, equivalent spellings), and
the digests of whole documents and of their whole lines meet the digests of known licences in
a hash join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattframe.llm.staging import stage

BROADCAST_LICENSES = 100_000

# Spellings that count as the same, applied to lower-case text.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\borganis", "organiz"),
    (r"\brecognis", "recogniz"),
    (r"\bauthoris", "authoriz"),
    (r"\bfavour", "favor"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bsub[ -]license", "sublicense"),
    (r"\bnon[ -]commercial", "noncommercial"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bper cent\b", "percent"),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"©|\(c\)", " copyright "),
]
# Each of the spellings holds one of these.
MARKS = [
    "licence", "organis", "recognis", "authoris", "favour", "acknowledgement", "fulfil", "license",
    "commercial", "copyright owner", "per cent", "https://", "&", "©", "(c)",
]

# Names and texts of known licences and notices.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. """
        + _AS_IS,
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. """
        + _AUTHOR,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted. " + _AUTHOR,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("reserved", "All rights reserved."),
]
KNOWN_SCHEMA = T.StructType([T.StructField("license", T.StringType()), T.StructField("text", T.StringType())])


def _plain(line: Column) -> Column:
    """One spelling, no punctuation, single blanks; most lines hold nothing to respell."""
    spelled = reduce(lambda c, s: F.regexp_replace(c, *s), SPELLINGS, line)
    some = reduce(lambda a, b: a | b, (F.contains(line, F.lit(m)) for m in MARKS))
    return F.trim(F.regexp_replace(F.when(some, spelled).otherwise(line), r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """Lines in lower case and plain form, without empty and copyright lines."""
    notice = r"^(copyright )+((19|20)\d\d|by|holder)\b|^copyright$|^portions copyright "
    lines = F.transform(F.split(F.lower(text), "\n"), _plain)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(notice))


def canonical(text: Column) -> Column:
    """All lines that are left, joined: the form of an entire text."""
    return F.array_join(canonical_lines(text), " ")


def scanned(docs: DataFrame, known: DataFrame, broadcast_licenses: int = BROADCAST_LICENSES) -> DataFrame:
    """One row per document: doc_id, digest, license, notices.

    ``digest`` is SHA-256 of the entire canonical text and ``license`` the known licence with
    that digest, NULL for none; ``notices`` lists, in order, the licences whose entire text is
    a line of the document. ``known`` has (license, text); the first name by order counts where
    two have one digest. Up to ``broadcast_licenses`` of them, by count, go to every task; more
    are joined by shuffle, where Spark splits a line that very many documents have, and each
    document brings a line once.

    NULL, empty and blank texts have no digest and no licence; repeated rows repeat their
    result; other columns are ignored; an empty table on either side gives no rows or no
    licences.
    """
    names = stage(
        known.select("license", canonical(F.col("text")).alias("text"))
        .where("text != ''")
        .groupBy(F.sha2("text", 256).alias("part"))
        .agg(F.min("license").alias("name")),
        "known",
    )
    small = names.limit(broadcast_licenses + 1).count() <= broadcast_licenses
    lines = canonical_lines(F.col("text"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", lines.alias("lines"))
    whole = F.when(F.size("lines") > 0, F.sha2(F.array_join("lines", " "), 256))
    parts = stage(
        texts.select(
            "doc_id",
            whole.alias("digest"),
            F.transform(F.array_distinct("lines"), lambda x: F.unhex(F.sha2(x, 256))).alias("parts"),
        ),
        "parts",
    )
    asked = parts.select("doc_id", "digest", F.explode("parts").alias("part"))
    keys = names.select(F.unhex("part").alias("part"), "name")
    hits = asked.join(F.broadcast(keys) if small else keys, "part")
    notices = hits.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("name")).alias("notices"))
    entire = names.select(F.col("part").alias("digest"), F.col("name").alias("license"))
    return (
        parts.drop("parts")
        .join(F.broadcast(entire) if small else entire, "digest", "left")
        .join(notices.withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "of"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
        .select("doc_id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the known licences; the notices as one text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scanned(docs, spark.createDataFrame(KNOWN, KNOWN_SCHEMA))
    return found.withColumn("notices", F.array_join("notices", ","))


def _sql_line(x: str) -> str:
    """A line's plain form in DuckDB's words."""
    for pattern, plain in SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{plain}', 'g')"
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    notice = r"regexp_matches(x, '^(copyright )+((19|20)\d\d|by|holder)\b|^copyright$|^portions copyright ')"
    lines = f"""list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_line("lower(x)")}),
        lambda x: x <> '' and not {notice})"""
    return f"""
with known as (
    select sha256(array_to_string({lines}, ' ')) as part, min(license) as name
    from (values {quoted}) v(license, text) group by 1
), d as (select doc_id, {lines} as lines from documents
), e as (select doc_id, case when len(lines) > 0 then sha256(array_to_string(lines, ' ')) end as digest, lines from d
), h as (
    select doc_id, string_agg(distinct name, ',' order by name) as notices
    from (select doc_id, sha256(unnest(lines)) as part from e) join known using (part) group by 1
)
select e.doc_id, digest, name as license, coalesce(notices, '') as notices
from e left join known on part = digest left join h using (doc_id)
"""

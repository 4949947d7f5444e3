"""Licence scan by canonical digests.

A text is brought to a canonical form: ASCII letters in lower case, lines that are copyright
statements removed (a notice in such a line is still looked up), other lines kept wherever
they break,
runs of punctuation and blanks one blank, equivalent spellings of licence texts made one.
The digest of the whole canonical text, and that of each of its lines taken as a text of its
own (a one-line notice inside a document), are looked up among the digests of known licence
texts by hash join. Nothing is compared but digests of entire texts, so a match is exact up
to the normalisation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.licence_texts import TEXTS
from presswork.operators.joins import checked_broadcast
from presswork.session import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns and spellings of the normalisation, in order.
# A statement names a year, a sign or a holder; text after a line break of a licence does not.
_NO_HOLDER = (
    "notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|protection|"
    "infringements?|materials?|works?|year|and|or|in|to|on|of|for|is|are|as|that|which|has|"
    "permissions?|disclaimers?|treaty|rights?"
)
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n©(]*(?:"
    r"copyright[^a-z0-9\n]*(?:(?<=\()c\)|(?<=©[^a-z0-9\n]{0,9})[a-z]|[0-9]{4}|yyyy\b)"
    rf"|copyright[ \t]+(?!(?:{_NO_HOLDER})\b)[a-z0-9]"
    r"|\(c\)[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*)?[0-9]{4}|©"
    r"|all rights reserved[^a-z0-9\n]*(?=\n|$)"
    r")[^\n]*"
)
# What may stand behind a copyright statement in its line.
NOTICE_TAIL = r"(?:\bthis (?:work|software) is )?\b(?:licen[sc]ed|released|distributed) under\b[^\n]*"
BETWEEN_WORDS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
LINE_EDGE = r" ?\n ?"
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("merchantib", "merchantab"),
    ("non commercial", "noncommercial"),
    (" version ", " v"),
]

# Full texts of short licences.
MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Names under which licences are referred to in one-line notices.
NAMES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
]
NOTICES = [
    "{}",
    "Licensed under {}",
    "Licensed under the {}",
    "Released under the {}",
    "Distributed under the {}",
    "This work is licensed under the {}",
    "This software is licensed under the {}",
]
# Titles above whole texts that are published without one, or with several.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of whole licences in the forms they are published in."""
    bodies = {"MIT": MIT.split("\n", 1)[1], "ISC": ISC.split("\n", 1)[1], **TEXTS}
    forms = []
    for spdx, body in bodies.items():
        made = [body]
        if spdx.startswith("BSD"):
            # Conditions are numbered or have bullets, which the canonical form drops.
            made.append(re.sub(r"(?m)^[123]\. ", "", body))
        if _END in body:
            # Without the appendix on how to apply the licence.
            terms = body.split(_END)[0]
            made += [terms, terms + _END]
        made += [x.replace("https://", "http://") for x in made if "https://" in x]
        forms += [(spdx, x) for x in made]
        forms += [(spdx, f"{title}\n{x}") for title in TITLES.get(spdx, []) for x in made]
    return forms


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the built-in full texts and one-line notices."""
    notices = [(spdx, form.format(name)) for spdx, name in NAMES for form in NOTICES]
    return [*whole_texts(), *notices]


def canonical(text: Column) -> Column:
    """Canonical form; lines stay apart, empty ones go."""
    out = F.translate(text, _UPPER, _LOWER)
    return _joined_words(F.regexp_replace(out, COPYRIGHT_LINE, "$1"))


def stated_notices(text: Column) -> Column:
    """The canonical lines of notices that stand behind copyright statements."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(COPYRIGHT_LINE), F.lit(0))
    tails = F.transform(found, lambda x: F.regexp_extract(x, NOTICE_TAIL, 0))
    return F.filter(F.split(_joined_words(F.array_join(tails, "\n")), "\n"), lambda x: x != "")


def _joined_words(out: Column) -> Column:
    out = F.regexp_replace(out, BETWEEN_WORDS, " ")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    out = F.regexp_replace(out, LINE_EDGE, "\n")
    return F.regexp_replace(F.regexp_replace(F.trim(out), r"\n+", "\n"), r"^\n|\n$", "")


def digest(text: Column) -> Column:
    """Digest of a canonical text, wherever its lines break."""
    out = F.replace(text, F.lit("\n"), F.lit(" "))
    for spelling, one in SPELLINGS:
        # Spellings of two words may have had a line break in them.
        if " " in spelling:
            out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.sha2(out, 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]]) -> DataFrame:
    """(digest, licence) of known texts, one row per digest (the first licence by name)."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.groupBy(digest(canonical(F.col("text"))).alias("digest")).agg(
        F.min("licence").alias("licence")
    )


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, digest, licence, n_notices, notices.

    licence: the known licence that the whole text is; null if none. notices: the distinct
    licences that single lines name, joined by commas in order; null if none; n_notices
    counts such lines. Null and empty texts have the digest of the empty text. Repeated
    rows come out as often. Every line of every text is looked up.
    """
    spark = docs.sparkSession
    table = stored(known_digests(spark, known_texts() if known is None else known), "licences")
    table = checked_broadcast(table)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    form = canonical(text)
    # The row number exists only in the stored table, so it cannot change on a retry.
    lines = stored(
        docs.select("doc_id", form.alias("form"), stated_notices(text).alias("stated")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            digest(F.col("form")).alias("digest"),
            F.transform(
                F.concat(F.split("form", "\n"), F.col("stated")), lambda x: F.sha2(x, 256)
            ).alias("lines"),
        ),
        "text-digests",
    )
    named = (
        lines.select("row", F.explode("lines").alias("digest"))
        .join(table, "digest")
        .groupBy("row")
        .agg(
            F.count("*").alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"),
        )
    )
    return (
        lines.select("row", "doc_id", "digest")
        .join(table, "digest", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "digest",
            "licence",
            F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
            "notices",
        )
    )

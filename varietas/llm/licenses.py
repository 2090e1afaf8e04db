"""Licence scan by canonical digest: normalised entire texts are hash-joined to known licence digests.

The normal form ignores case, punctuation, spacing, copyright notices and
equivalent spellings, so a licence matches however it was typeset.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm.common import cut

# ---- fixed values: equivalent spellings, licence texts and notices ----------------------------------------
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"),
    ("per cent", "percent"), ("https", "http"), ("v2 0", "version 2 0"), ("v3", "version 3"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""

NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
# ------------------------------------------------------------------------------------------------------------

KNOWN = (("MIT", MIT), ("ISC", ISC), ("Zlib", ZLIB), *NOTICES)

_SIGN = r"(?:\(c\)|©|&copy;)"
#: A notice names a year after the word or sign, or a holder after both, or a holder (a name up to the line's end) after
#: 'Copyright'; a template's placeholder ('<year>', 'year') is none, nor is '(c)' that numbers a paragraph.
_HOLDER = r"(?:(?-i:\p{Lu})[\p{L}\p{N}.,'’&-]*|and|of|the|others|authors|contributors|&|<[^<>\n]+>)"
_NOT_HOLDER = (r"(?!(?:holders?|owners?|notices?|licen[sc]es?|laws?|acts?|statements?|interests?|disclaimers?|protections?|"
               r"rights?|treat(?:y|ies)|infringements?|permissions?|and|of)\b)")
_HEAD = (rf"(?:copyright[ \t:,]*{_SIGN}?[ \t:,]*[0-9]{{4}}|{_SIGN}[ \t]*(?:copyright[ \t:,]*)?[0-9]{{4}}"
         rf"|(?:copyright[ \t:]*{_SIGN}|{_SIGN}[ \t]*copyright|©)[ \t:,]*(?!year\b|yyyy\b)(?:the\b|by\b|(?-i:\p{{Lu}}))"
         rf"|(?-i:Copyright)[ \t]+(?:by[ \t]+)?{_NOT_HOLDER}(?=(?:{_HOLDER}[ \t]*){{1,10}}(?:all rights reserved\.?)?[ \t\r]*(?:\n|\z)))")
#: Where a licence begins that is set on the line of its notice.
_BODY = (r"(?:everyone\s+is\s+permitted|permission\s+is\s+(?:hereby\s+)?granted|permission\s+to\s+use|redistribution\s+and\s+use|"
         r"this\s+software\s+is\s+provided|licensed\s+under|released\s+under|this\s+work\s+is\s+licensed|dedicated\s+to\s+the)\b")
#: A line that only states a copyright, or its part before a licence; the holder's lines of the GNU licences anywhere.
_COPYRIGHT = (r"(?i)\bcopyright\s+\(c\)\s+[0-9]{4}[\s\S]{0,250}?(?=everyone\s+is\s+permitted)"
              rf"|(?<![^\n])[ \t#*/;%\-]*(?:(?:all rights reserved[ \t.,;!]*)?{_HEAD}[^\n]*?(?=\n|\z|\b{_BODY})"
              r"|all rights reserved[ \t\r.!]*(?=\n|\z))")
_VARIANT = f" (?:{'|'.join(a for a, _ in SPELLINGS)}) "
#: Largest table of digests that is broadcast (rows of about 60 bytes).
BROADCAST_DIGESTS = 200_000


def canonical(text: Column) -> Column:
    """Normal form of a text: words without case, punctuation, copyright lines and spelling variants."""
    t = F.regexp_replace(text, _COPYRIGHT, " ")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))

    def spelled(x: Column) -> Column:
        y = F.replace(x, F.lit(" "), F.lit("  "))            # neighbours share no blank
        for a, b in SPELLINGS:
            y = F.replace(y, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
        return F.when(x.rlike(_VARIANT), F.replace(y, F.lit("  "), F.lit(" "))).otherwise(x)    # most texts have none

    return F.trim(F.get(F.transform(F.array(t), spelled), F.lit(0)))


def digest(text: Column) -> Column:
    """SHA-256 of the normal form; null for texts without a word."""
    return F.sha2(F.nullif(canonical(text), F.lit("")).cast("binary"), 256)


def known_digests(licences: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(digest, name): one row per digest; licences of equal normal form are named together."""
    return (licences.select(digest(F.col(text_col)).alias("digest"), F.col(name_col).cast("string").alias("name"))
            .where("digest IS NOT NULL AND name IS NOT NULL").groupBy("digest")
            .agg(F.concat_ws(" or ", F.array_sort(F.collect_set("name"))).alias("name")))


def known_licences(spark: SparkSession, texts: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(texts), "name string, text string")


def standard_texts() -> list[dict]:
    """The shipped table (``license_texts.jsonl``): name, titles, notices, text and appendices of every standard licence."""
    table = resources.files("varietas.llm").joinpath("license_texts.jsonl").read_text(encoding="utf-8")
    return [json.loads(line) for line in table.splitlines()]


def standard_licences(spark: SparkSession) -> DataFrame:
    """(name, text) of every standard licence with and without a title, a template's notice and an appendix."""
    rows = [(r["name"], r["titles"], r["notices"], r["text"], r["appendices"]) for r in standard_texts()]
    each = spark.createDataFrame(rows, "name string, titles array<string>, notices array<string>, text string, appendices array<string>")
    none = F.array(F.lit(""))
    for c, parts in (("title", "titles"), ("notice", "notices"), ("appendix", "appendices")):
        each = each.withColumn(c, F.explode(F.concat(none, parts)))
    return each.select("name", F.concat_ws("\n\n", "title", "notice", "text", "appendix").alias("text"))


def scan(docs: DataFrame, licences: DataFrame, text_col: str = "text", id_col: str = "doc_id",
         name_col: str = "name", licence_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_digest, whole_license, line_licenses, n_license_lines.

    The entire text, and every distinct line as an entire text of its own (a
    notice stands on a line), are looked up by digest.  ``whole_license`` names the
    licence that the text is, ``line_licenses`` (sorted) those that lines of it are.

    Cases: null and empty texts and texts of copyright lines only have a null
    digest and match nothing; licences with equal normal forms share a name; repeated
    rows get equal rows; an empty list matches nothing, an empty table gives
    an empty result; further columns are ignored.

    Scale: one pass; texts and lines become digests before any shuffle.  The digest table is
    broadcast up to ``BROADCAST_DIGESTS`` rows (counted first) and joined by a shuffle beyond.
    """
    known = cut(known_digests(licences, name_col, licence_text))
    side = F.broadcast(known) if known.count() <= BROADCAST_DIGESTS else known
    text = F.col(text_col).cast("string")
    lines = F.transform(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n")), lambda x: F.unhex(digest(x)))
    rows = cut(docs.select(F.col(id_col).alias("id"), digest(text).alias("text_digest"), lines.alias("lines"))
               .withColumn("row", F.monotonically_increasing_id()))
    met = (rows.select("row", F.explode("lines").alias("line"))
           .join(side.select(F.unhex("digest").alias("d"), "name"), F.col("line") == F.col("d"))
           .groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_set("name")).alias("line_licenses"),
                                                 F.count(F.lit(1)).alias("n_license_lines")))
    whole = side.select(F.col("digest").alias("wd"), F.col("name").alias("whole_license"))
    return (rows.drop("lines").join(whole, F.col("text_digest") == F.col("wd"), "left")
            .join(met, F.col("row") == F.col("r"), "left")
            .select("id", "text_digest", "whole_license",
                    F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"),
                    F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")))

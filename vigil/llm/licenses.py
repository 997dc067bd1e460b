"""Licence scans by lookup of canonical digests.

A text is made canonical: lines that only state a copyright go, A-Z in lower case,
equivalent spellings one spelling, everything but letters and digits one space. Its
SHA-256 is joined with those of known texts, made canonical by the same expression.
Whole texts are looked up, and each line by itself, for the notices that stand in
texts of another kind.

Native Spark: expressions, and a join with the table of known texts, which is
broadcast because it is a constant of this module (or of the caller, who passes at
most ``MAX_KNOWN`` texts).
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, unused

MAX_KNOWN = 10_000
#: Letters of a known text's first word that a line must begin with to be looked up.
FIRST = 24

# Equivalent spellings, left to right.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
             ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http")]
#: A line that states a copyright: ``copyright`` or its sign with a year, a sign or a place for a name next, or a year at its end;
#: or that only reserves all rights. A sentence that goes on with ``copyright notice`` is none. Flags differ by engine.
COPYRIGHT_LINE = (r"^[^\n0-9a-z]*(?:(?:copyright|\(c\)|©)[^\n0-9a-z]*(?:c\)|©|[0-9]{4}|[<\[{](?:year|yyyy|name|copyright|owner))[^\n]*"
                  r"|copyright[^\n]*[^\n0-9a-z][0-9]{4}[^\n0-9a-z]*|all rights reserved[^\n0-9a-z]*)$")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Public licence texts and notices, by SPDX name.
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
              "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
              "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
              "substantial portions of the Software.\n\n")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
          "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
            "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
            "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
             "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
             "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
             "disclaimer in the documentation and/or other materials provided with the distribution.\n\n")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
              "this software without specific prior written permission.\n\n")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
KNOWN = [
    ("MIT", _MIT_GRANT + _AS_IS),
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
         "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
         "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not "
         "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
         "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
         "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
              "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
              "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
              "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
              "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
              "under copyright law.\n\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") +
              "\n\nFor more information, please refer to <https://unlicense.org/>")
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
          "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "Zlib": ["zlib License", "The zlib/libpng License"],
          "Unlicense": ["The Unlicense"]}
#: Licences published as files, which stand in ``license_texts`` as they are.
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1",
         "LGPL-3.0-only": "LGPL-3", "MPL-2.0": "MPL-2.0"}


def _published() -> list[tuple[str, str]]:
    """Full texts, numbered or with stars, with and without a title; and licences published as files."""
    out = []
    for name, text in [*[x for x in KNOWN[:6] if not x[1].startswith("MIT License")], ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE)]:
        for form in dict.fromkeys([text, re.sub(r"(?m)^[123]\. ", "* ", text)]):
            out += [(name, title + form) for title in ["", *(f"{t}\n\n" for t in TITLES[name])]]
    return out + [(name, pkgutil.get_data(__package__, f"license_texts/{file}.txt").decode()) for name, file in FILES.items()]


KNOWN += [x for x in _published() if x not in KNOWN]


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: empty)."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    low = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved"),
                 F.regexp_replace(low, f"(?md){COPYRIGHT_LINE}", " ")).otherwise(low)
    plain = F.trim(F.regexp_replace(low, NOT_WORD, " "))
    for said, meant in SPELLINGS:
        plain = F.replace(plain, F.lit(said), F.lit(meant))
    return plain


def known_texts(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(license_id, plain) of the known texts, made canonical; columns of a table of ``MAX_KNOWN`` rows at most."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    return spark.createDataFrame(known, "license_id string, text string").select("license_id", canonical(F.col("text")).alias("plain"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id) of the known texts; the least id where texts are alike."""
    return known_texts(spark, known).groupBy(F.sha2("plain", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _line_pattern(known: DataFrame) -> str | None:
    """A pattern for all lines that may be a known text: those that begin as one does (None: a known text is empty).

    Spellings made equal inside the first word count as written either way.
    """
    starts = {r["w"] for r in known.select(F.split("plain", " ")[0].alias("w")).distinct().collect()}
    if "" in starts:
        return None
    starts |= {w[:at.start()] + said.split(" ")[0] for w in starts for said, meant in SPELLINGS for at in re.finditer(re.escape(meant), w)}
    either = "|".join(re.escape(w[:FIRST]) for w in sorted(starts))
    return r"(?mid)^[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:" + either + r")[^\n]*"


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with canonical_sha256, license_id (of the whole text, or null), notices (sorted ids of its lines) and n_notices.

    A null text counts as empty. A line counts if it stands in the text as a whole line (ended by a line feed or the
    end) and its canonical form is that of a known text; n_notices counts such lines. Lines that do not begin with the
    first letters of some known text are not digested, as they can't be one. Columns with the names of new ones are
    replaced, all others kept.
    """
    spark = docs.sparkSession
    known = KNOWN if known is None else known
    pattern = _line_pattern(known_texts(spark, known))
    digests = F.broadcast(known_digests(spark, known))
    made = ("canonical_sha256", "license_id", "notices", "n_notices")
    text, key = F.coalesce("text", F.lit("")), unused(docs, "__key")
    lines = F.split(text, "\n") if pattern is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = docs.drop(*made).withColumn(key, F.md5(text))
    notices = (rows.select(key, F.posexplode(lines).alias("line", "said")).withColumn("digest", F.sha2(canonical(F.col("said")), 256))
               .join(digests, "digest").select(key, "line", "license_id").distinct()
               .groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.count("*").alias("n_notices")))
    whole = rows.withColumn("canonical_sha256", F.sha2(canonical(F.col("text")), 256))
    return (whole.join(digests.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left").join(notices, key, "left")
            .withColumns({"notices": F.coalesce("notices", F.lit("")), "n_notices": F.coalesce("n_notices", F.lit(0)).cast("bigint")}).drop(key))

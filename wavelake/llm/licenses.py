"""Licence scan by canonical digests, with DataFrame functions alone.

A text's canonical form: A-Z lower-cased; lines that only state copyright dropped;
everything but letters a-z and digits turned into single spaces; spellings that
licence matchers treat as one unified word by word.  The SHA-256 of the canonical
form is hash-joined with the digests of known licences, formed the same way.

Licences and notices inside longer texts are looked up in the same digests, from every line
that is not blank and no copyright line: a known text of n canonical words is found where the next n
canonical words have its digest, however its lines are wrapped.  The longest one counts at each line.
To hash only where a known text can begin, the first ``ANCHOR`` canonical words of each line are held against a
fixed-size Bloom filter of those of the known texts, then joined with them; only lines that pass carry the
words that follow.  Work and memory are proportional to the text, besides those words.

The known licences are a table ``(license, text)`` of any size and with texts of any length; ``KNOWN`` is a small
one of short licences and usual notices.  All lookups are equi-joins on digests; Spark broadcasts
the licences if they are few.  Of the documents, only digests and the words after anchors are shuffled.

Edge cases: null, empty and blank texts, and texts of copyright lines alone, have no
licence (their canonical form is empty); repeated rows are judged alike; of licences with one
canonical form the first by name counts; very long texts are read whole; an empty table of documents or
licences gives no finding; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.storage import scratch

#: Words from which a known text is looked up.
ANCHOR = 3
#: Bits of the filter of anchors, as 64-bit words (32 KB).
_FILTER_WORDS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A line, lower-cased, that only states copyright.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©|all rights reserved)"
#: Such a start of a line that is part of a wrapped sentence.
COPYRIGHT_PROSE = r"^[^a-z0-9]*copyright\s+(holder|notice|owner|law|interest|licen|statement|and |or )"
#: Both for a whole text, in any case: lines to drop.
_DROPPED = r"(?dim)^(?![^a-z0-9\n]*copyright[\t\x0b\f\r ]+(?:holder|notice|owner|law|interest|licen|statement|and |or ))[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"

#: Spellings that count as the same word.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
    "it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any "
    "source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, "
    "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
    "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
    "to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license "
    "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
    "such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
    "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
    "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "


def _gnu_notice(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version "
        f"{version} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\nYou should have received a copy of the GNU {name} along with "
        "this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Fixed values: (licence, text) of whole licences and of usual notices.
KNOWN = (
    ("BSD-2-Clause", _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + "* " + _BSD_SOURCE + "* " + _BSD_BINARY + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + "3. " + _BSD_NAME + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + "3. " + _BSD_NAME + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + "* " + _BSD_SOURCE + "* " + _BSD_BINARY + "* " + _BSD_NAME + _BSD_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MPL-2.0", _MPL_NOTICE + "http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", _MPL_NOTICE + "https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", _gnu_notice("General Public License", "3")),
    ("AGPL-3.0", _gnu_notice("Affero General Public License", "3")),
    ("LGPL-3.0", _gnu_notice("Lesser General Public License", "3")),
    ("GPL-2.0", _gnu_notice("General Public License", "2")),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _clean_lines(text: Column) -> Column:
    """The lines that count, lower-cased, as words with single spaces."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), _DROPPED, "")
    lines = F.split(F.lower(F.regexp_replace(kept, "[^A-Za-z0-9\n]+", " ")), "\n", -1)
    return F.filter(F.transform(lines, lambda l: F.btrim(l)), lambda l: l != "")


def _spelled(words: Column) -> Column:
    """Words with single spaces, in the spelling that stands for all."""

    def of(held: Column) -> Column:
        out, other = held, F.lit(False)
        for a, b in SPELLINGS:
            out, other = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} ")), other | F.contains(held, F.lit(a))
        return F.when(other, out).otherwise(held)

    return F.btrim(_let(F.concat(F.lit(" "), words, F.lit(" ")), of))


def _digest(lines: Column) -> Column:
    return F.sha2(_spelled(F.array_join(lines, " ")), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """``KNOWN`` as a table ``(license, text)``."""
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN]))
    return spark.range(1).select(rows)


def _first(words: Column, n: Column | int) -> Column:
    """The first ``n`` canonical words of words: two words become one at most."""
    n = F.lit(n) if isinstance(n, int) else n
    return _words(_spelled(_words(words, 2 * n + 2)), n)


def _words(text: Column, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(" "), n.cast("int"))


def _bit(anchor: Column) -> tuple[Column, Column]:
    """The word of the filter that an anchor marks, and the bit in it."""
    at = F.pmod(anchor, F.lit(64 * _FILTER_WORDS))
    return F.floor(at / 64).cast("int"), F.pmod(at, F.lit(64)).cast("int")


def _anchor_filter(anchors: DataFrame) -> Column:
    """A Bloom filter with one bit a hash, as an ``array<bigint>`` literal; at most ``_FILTER_WORDS`` rows reach the driver."""
    word, bit = _bit(F.col("anchor"))
    marked = anchors.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    words = [0] * _FILTER_WORDS
    for row in marked.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[row.word] = row.bits
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _held(holds: Column, anchor: Column) -> Column:
    word, bit = _bit(anchor)
    return F.getbit(F.get(holds, word), bit) == 1


def _starts(lines: Column, holds: Column, sizes: list[int], window: int) -> Column:
    """``array<struct<at, anchors, words>>``: the lines at which a known text may begin, with the words from there on."""

    text = lambda i, n: _words(F.array_join(F.slice(lines, i, F.lit(n)), " "), F.lit(n))
    anchors = lambda i: _let(text(i, 2 * ANCHOR + 2), lambda t: F.array(*[F.xxhash64(_first(t, k)) for k in sizes]))
    each = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.struct(i.alias("at"), anchors(i).alias("anchors")))
    found = F.filter(each, lambda s: F.exists(s["anchors"], lambda a: _held(holds, a)))
    return F.when(F.size(lines) > 0, F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["anchors"].alias("anchors"), text(s["at"], window).alias("words"))))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, license, n_notices, notice_licenses``.

    ``license`` is that of the entire text or empty; ``n_notices`` counts the lines at which a known licence or
    notice begins (also those inside a longer one), and ``notice_licenses`` lists the licences of the longest at each of
    these lines, sorted and joined by commas.
    """
    spark = docs.sparkSession
    licenses = known_licenses(spark) if licenses is None else licenses
    forms = licenses.select("license", _clean_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    forms = forms.select("license", _spelled(F.array_join("lines", " ")).alias("form"))
    known = forms.groupBy("form").agg(F.min("license").alias("license"))
    n = F.size(F.split("form", " "))
    known = known.select(F.sha2("form", 256).alias("known"), "license", n.alias("n"), F.xxhash64(F.call_function("substring_index", "form", F.lit(" "), F.lit(ANCHOR))).alias("anchor"))
    with scratch(spark) as keep:
        known = keep(known, "licenses")
        anchors = known.select("anchor", F.least("n", F.lit(ANCHOR)).alias("size"))
        sizes = sorted(r["size"] for r in anchors.select("size").distinct().collect()) or [ANCHOR]
        window = 2 * (known.agg(F.max("n")).first()[0] or 0) + 2
        holds = _anchor_filter(anchors)
        of = lambda lines: F.struct(_digest(lines).alias("digest"), _starts(lines, holds, sizes, window).alias("starts"))
        rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _let(_clean_lines(F.col(f"`{text}`")), of).alias("found")).select("doc_id", "found.*")
        rows = keep(rows.withColumn("key", F.xxhash64("doc_id", "digest", "starts")), "digests")
        # repeated rows are looked up once
        each = rows.where(F.size("starts") > 0).groupBy("key").agg(F.first("starts").alias("starts")).select("key", F.explode("starts").alias("s"))
        each = each.select("key", "s.at", "s.words", F.explode("s.anchors").alias("anchor"))
        hits = each.join(known, "anchor").where(F.sha2(_first(F.col("words"), F.col("n")), 256) == F.col("known"))
        best = hits.groupBy("key", "at").agg(F.max_by("license", "n").alias("license"))
        notices = best.groupBy("key").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notice_licenses"))
        notices = keep(notices, "notices")
    out = rows.join(known, F.col("digest") == F.col("known"), "left").join(notices, "key", "left")
    return out.select("doc_id", "digest", F.coalesce("license", F.lit("")).alias("license"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notice_licenses", F.lit("")).alias("notice_licenses"))

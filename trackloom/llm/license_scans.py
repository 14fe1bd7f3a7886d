"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, without copyright lines, punctuation and runs of white space, and with
equivalent spellings made one. Its SHA-256 is looked up, by a hash join, among the digests of known licences, which are a table.
The whole text counts; a second digest, of each line, finds one-line notices inside longer documents, again as entire lines.
"""

from __future__ import annotations

import hashlib
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import bounded, free, row_keys, stored

#: Rows of the dictionary, and texts with notices, that are broadcast at most: some tens of MB. Beyond it the joins are Spark's choice.
BROADCAST_ROWS = 200_000
#: Spellings that licence texts use alike; each word becomes the one on the right.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("organisation", "organization"), ("authorised", "authorized"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("version", "v"), ("https", "http"), ("and or", "andor"),
]
#: A line that only states a copyright, or that all rights are reserved. It has a year, a sign or a placeholder: lines of a wrapped
#: body begin with the word copyright too, and items of a list with (c), which alone is no sign therefore.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:(?i:copyright\b[^\n]*(?:\d{4}|\(c\)|©|[<\[{](?!http))|\(c\)[^\n]*(?:\d{4}|[<\[{](?!http))|©)[^\n]*|(?i:all\x20rights\x20reserved)[^\p{L}\n]*)$"
#: A word that every known text and notice has.
LINE_HINT = r"(?i)licen[cs]ed?\b|\breleased\b|\bpermi(?:ssion|tted)\b"

#: Public licence texts and notices, as their authors publish them.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
#: Headings above the texts, which have none themselves.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "BSD Zero-Clause License (0BSD)", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD-2-Clause", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD-3-Clause", "BSD License"],
}
#: Other usual wordings; each may be applied or not, to the texts that have the words on the left.
WORDINGS = [("\n1. ", "\n* "), ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"), ("modify, and/or distribute", "modify, and distribute")]
#: Long texts, in files, and the lines of their heading.
LONG = {"Apache-2.0": 3, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 2}
#: One-line notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for old, new in SPELLINGS:  # every word has a space of its own on either side
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of every known licence, with and without its heading and in other usual wordings, and of the notices."""
    out = list(KNOWN.items())
    for name, text in KNOWN.items():
        bodies = [text]
        for old, new in WORDINGS:
            other = [b.replace(old, new) for b in bodies if old in b]
            if old == "\n1. ":  # all numbers become bullets; the numbers of Zlib's list are part of it
                other = [b.replace("\n2. ", "\n* ").replace("\n3. ", "\n* ") for b in other if name.startswith("BSD")]
            bodies += other
        out += [(name, f"{heading}\n\n{body}") for heading, body in product(["", *HEADINGS.get(name, [])], bodies)]
    for name, heading in LONG.items():
        text = (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8").strip()
        terms, mark, _ = text.partition("END OF TERMS AND CONDITIONS")
        for body in dict.fromkeys([text, terms + mark, terms]):  # without the advice on how to apply it
            out += [(name, body), (name, "\n".join(body.split("\n")[heading:]))]
    return [*out, *NOTICES]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license): of licences alike in canonical form, the first name."""
    texts = known_texts() if texts is None else texts
    rows = spark.createDataFrame(list(enumerate(texts)), "o int, t struct<name:string,text:string>")
    return rows.groupBy(digest(F.col("t.text")).alias("digest")).agg(F.min_by("t.name", "o").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text", line_hint: str | None = None) -> DataFrame:
    """The input's columns and ``license_digest``, ``license`` (of the entire text, else null) and ``notices`` (sorted distinct licences of entire lines).

    Null and empty texts, and those with nothing left in canonical form, have no licence. One row per input row; empty tables
    give none. Columns of these names in the input are replaced, others may have any name. ``known`` has rows (digest,
    license); of rows with one digest the smallest name counts. Entire texts and lines meet it in hash joins; lines are
    looked up where they match ``line_hint``. None stands for ``LINE_HINT``, a word that every text of ``known_texts`` has, and
    for all lines if ``known`` is given. Notices come back to their text by 128 bits of it, so a text's copies share them.
    """
    if known is None:
        known, line_hint = known_licenses(docs.sparkSession), line_hint or LINE_HINT
    new = ("license_digest", "license", "notices")
    names = [c for c in docs.columns if c.lower() not in new]
    own = [F.col(f"`{c}`") for c in names]
    body = F.col(f"`{text}`")
    at = [free(c, [*names, *new]) for c in ("__r0", "__r1")]
    keyed = docs.select(*own, digest(body).alias("license_digest"), *[k.alias(c) for k, c in zip(row_keys(text), at, strict=True)])
    table = known.where(F.col("digest") != hashlib.sha256(b"").hexdigest()).groupBy("digest").agg(F.min("license").alias("license"))
    table = bounded(stored(table.toDF("license_digest", "license")), BROADCAST_ROWS)
    lines = F.split(body, "\n")
    lines = docs.select(*[k.alias(c) for k, c in zip(row_keys(text), at, strict=True)], F.explode(F.filter(lines, lambda x: x.rlike(line_hint)) if line_hint else lines).alias("line"))
    found = lines.select(*at, digest(F.col("line")).alias("license_digest")).join(table, "license_digest")
    notices = stored(found.groupBy(*at).agg(F.array_sort(F.collect_set("license")).alias("notices")))
    out = keyed.join(table, "license_digest", "left").join(bounded(notices, BROADCAST_ROWS), at, "left")
    return out.select(*own, "license_digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))

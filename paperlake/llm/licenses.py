"""License scans: canonical digests of whole texts, looked up in the digests of known licences. Column functions only."""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A line that is a notice: copyright with a sign, a year or a name. Licences are wrapped anywhere, so a line that begins
# with "copyright notice", "copyright holder" or a clause (c) belongs to the text.
_NO_NAME = (
    r"(?!(?i:notices?|holders?|owners?|laws?|licen[cs]es?|licen[cs]ed|statements?|interests?|permissions?|treaty|treaties|"
    r"protection|rights?|disclaimers?|terms|claims?|information|management|infringement|and|or|in|on|of|to|for|is|as|that|"
    r"which|with|under|from|has|may|shall|will|this|these|those|any|other|similar)\b)"
)
_NO_CLAUSE = (
    r"(?!\s+(?i:you|the|any|for|to|if|in|all|each|an?|that|such|under|may|must|shall|it|its|with|without|by|use|where|when|"
    r"from|of|or|and|this|these|those|no|not|other|on|at|as|is|are|neither|accompany|convey|keep|include|prohibit|require|"
    r"retain|give|provide|cause|distribute|publicity)\b)"
)
# What may stand before a notice in its line, taken at once: no line break, and nothing that is given back.
_COPYRIGHT = (
    r"[ \t\r\f\x0B*#/;\-]*+(?:(?i:copyright)[ \t:,]*(?:(?i:\(c\))|©|\d|[\[<{]|(?i:by\b|years?\b))"
    rf"|(?:Copyright|COPYRIGHT)[ \t]+{_NO_NAME}\p{{L}}|copyright[ \t]+{_NO_NAME}\p{{Lu}}"
    rf"|©|(?i:\(c\)){_NO_CLAUSE}|(?i:all rights reserved))[^\n]*"
)
_NOTICE = re.compile(f"(?m)^{_COPYRIGHT}$".replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", r"[^\W\d_]"))


def _whole(name: str) -> list[tuple[str, str]]:
    """The stored file of a licence in one line without its notices: with and without its title and its appendix."""
    text = _NOTICE.sub(" ", (files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8")).strip()
    short = re.split(r"(?im)^\s*(?:appendix: |how to apply these terms)", text)[0].strip()
    bare = re.split(r"(?im)^\s*END OF TERMS AND CONDITIONS\s*$", text)[0].strip()
    texts = [x for y in (text, short, bare) for x in (y, y.split("\n", 1)[1])]
    return [(name, x) for x in dict.fromkeys(" ".join(x.split()) for x in texts)]


_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)

_UNLICENSE_END = (
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
    "of all present and future rights to this software under copyright law. "
    + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
)

# Licence texts and the notices that stand for a licence.
LICENSES = (
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
     "associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
     "above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. " + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
     "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
     "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used "
     "to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS "
     "IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
)
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Unlicense": ("The Unlicense",),
}
_SPDX = {
    **{n: (n,) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0",
                         "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")},
    **{n: (n, f"{n}-only", f"{n}-or-later") for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}


def _more() -> tuple[tuple[str, str], ...]:
    """Whole texts with and without titles, and SPDX lines, of every licence."""
    texts = {n: [t for m, t in LICENSES if m == n and len(t) > 200] for n in _TITLES}
    texts["MIT"] = [t.removeprefix("MIT License\n") for t in texts["MIT"]]
    texts["ISC"] = [t.removeprefix("ISC License\n") for t in texts["ISC"]]
    texts["ISC"] += [t.replace("and/or distribute", "and distribute") for t in texts["ISC"]]
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        texts[name] += [re.sub(r" [123]\. ", " ", t) for t in texts[name]]
    texts["Unlicense"] = [
        f"{t} {_UNLICENSE_END} For more information, please refer to <{site}>" for t in texts["Unlicense"]
        for site in ("https://unlicense.org", "http://unlicense.org")
    ]
    rows = [(n, x) for n, own in texts.items() for t in own for x in (t, *[f"{title} {t}" for title in _TITLES[n]])]
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"):
        rows += _whole(name)
    return (*rows, *[(n, f"SPDX-License-Identifier: {x}") for n, own in _SPDX.items() for x in own])


LICENSES += _more()
# Spellings and forms that say the same, applied in this order to lower-cased words between blanks.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"),
    ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("gnu gpl", "gnu general public license"),
    ("gnu lgpl", "gnu lesser general public license"), ("gnu agpl", "gnu affero general public license"),
    ("creative commons attribution", "cc by"), ("v 1", "version 1"), ("v 2", "version 2"), ("v 3", "version 3"),
    ("v1", "version 1"), ("v2", "version 2"), ("v3", "version 3"), ("favour", "favor"), ("organisation", "organization"),
)


def canonical(text: Column) -> Column:
    """Lower case; no copyright notices; words only, in their equivalent spellings, one blank between them."""
    lines = F.lower(F.regexp_replace(text, f"(?m)^{_COPYRIGHT}$", " "))
    words = F.concat(F.lit(" "), F.regexp_replace(F.replace(lines, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for form, same in EQUIVALENT:
        words = F.replace(words, F.lit(f" {form} "), F.lit(f" {same} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def first_word(text: Column) -> Column:
    """The word a text's canonical form is made from first, before equivalent spellings are put in.

    Only a text whose first word may begin a notice is taken apart into lines. No pattern repeats a group, so its depth
    does not grow with the text.
    """
    notice = text.rlike(r"\A[^\p{L}\p{N}©]*+(?:©|(?i:copyright|all rights|c\)))")
    others = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(f"\\A{_COPYRIGHT}\\z"))
    rest = F.when(notice, F.array_join(others, "\n")).otherwise(text)
    found = F.regexp_extract(rest, r"\A[^\p{L}\p{N}]*+([\p{L}\p{N}]*+)", 1)
    ampersand = rest.rlike(r"\A[^\p{L}\p{N}&]*+&")
    return F.when(ampersand, F.lit("and")).otherwise(F.lower(found))


def _first_words(forms: DataFrame) -> DataFrame:
    """Words that texts with one of the canonical forms can start with: an equivalent form may replace the first one."""
    words = forms.select(F.split("_form", " ")[0].alias("first"))
    # Forms are applied in order, so a word can come from a chain of earlier ones: look from the last to the first.
    sources: dict[str, set[str]] = {}
    for form, same in reversed(EQUIVALENT):
        begin, end = form.split()[0], same.split()[0]
        sources.setdefault(end, set()).update({begin} | sources.get(begin, set()))
    begins = F.create_map(*[
        c for end, starts in sources.items() for c in (F.lit(end), F.array(*[F.lit(x) for x in sorted(starts)]))
    ])
    more = F.coalesce(begins[F.col("first")], F.array().cast("array<string>"))
    return words.select(F.explode(F.concat(F.array("first"), more)).alias("first")).distinct()


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table (license, text)."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in LICENSES])
    return spark.range(1).select(F.inline(rows))


def scan_licenses(papers: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Licences that papers consist of, or that stand in them as whole paragraphs or lines.

    ``papers`` has paper_id and text; ``licenses`` license and text (the built-in ones if not given); other columns are
    ignored. A text, each of its paragraphs (between empty lines) and each of its lines (ended by \\n) is brought to canonical
    form, and its digest joined with the digests of the licences' canonical forms: only entire texts match. Returns one row
    per paper, licence and scope: paper_id, license, scope (``text``, ``paragraph``, ``line``; a unit counts in its
    widest scope), matches (long). Papers without a match have no row; null and empty texts match nothing, nor do
    licences without a word. Rows with the same paper_id, null included, count together. Known licences with equal
    forms all match.
    """
    known = known_licenses(papers.sparkSession) if licenses is None else licenses
    forms = known.select("license", canonical(F.col("text")).alias("_form")).where("_form <> ''").distinct()
    text = F.col("text")
    has_line, has_gap = F.contains(text, F.lit("\n")), F.contains(text, F.lit("\n\n")) | F.contains(text, F.lit("\n\r\n"))
    paragraphs = F.when(has_gap, F.split(text, "\n\r?\n")).otherwise(F.array(text))
    several = F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n")))
    none = F.array().cast("array<struct<scope:string,part:string>>")

    def units(scope: str, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("part")))

    parts = F.concat(
        units("text", F.array(text)),
        F.when(has_gap, units("paragraph", paragraphs)).otherwise(none),
        F.when(has_line, units("line", F.flatten(F.transform(several, lambda x: F.split(x, "\n"))))).otherwise(none),
    )
    # Most units start with a word that no licence starts with and need no canonical form.
    likely = (
        papers.where("text IS NOT NULL").select("paper_id", F.explode(parts).alias("unit"))
        .select("paper_id", "unit.scope", "unit.part", first_word(F.col("unit.part")).alias("first"))
        .join(_first_words(forms), "first", "left_semi")
    )
    digests = likely.select("paper_id", "scope", F.sha2(canonical(F.col("part")), 256).alias("digest"))
    known_digests = forms.select("license", F.sha2("_form", 256).alias("digest"))
    return digests.join(known_digests, "digest").groupBy("paper_id", "license", "scope").agg(F.count("*").alias("matches"))

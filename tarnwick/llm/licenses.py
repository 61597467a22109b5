"""Licence scan: canonical digests of entire texts, looked up in a table of known licences."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import let

#: Spellings that count as equal, first to second, replaced in this order. Fixed values.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "),
    ("per cent", "percent"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&amp;", "and"), ("&", "and"), ("©", "(c)"),
)
#: Lines end at \n alone here, as in SQL: Java's flag d keeps ^ and $ from standing at \r and others.
LINES, SQL_LINES = "(?dm)", "(?m)"
#: Whole lines that only say who holds the copyright.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(]*(?:copyright|\(c\))[ \t]*(?:\(c\)|copyright|[0-9<\[{])[^\n]*$"
#: The same with a plain name behind the word; not before words that follow it in licence texts, however these are wrapped.
NAMED_LINE = (
    r"^[^\p{L}\p{N}\n(]*copyright[ \t]+(?:by[ \t]+)?(?!(?:holders?|notices?|owners?|ownership|and|or|laws?|disclaimers?|interests?|the|permissions?|on|in|to|by|is|as|"
    r"license[sd]?|statements?|treaty|treaties|if|are|of|including|doctrines?|for|with|from|that|which|may|shall|claims?|infringements?|protection|act|status|works?|rights?|under|lines?)\b)\p{L}[^\n]{0,120}$"
)
RIGHTS_LINE = r"^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
BETWEEN = r"[^\p{L}\p{N}]+"

_PERMIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\n"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Entire licence texts and whole-line notices by SPDX name. Fixed values; the SQL knows these only.
TEXTS = (
    ("MIT", _PERMIT + _AS_IS), ("MIT", "MIT License\n\n" + _PERMIT + _AS_IS), ("MIT", "The MIT License (MIT)\n\n" + _PERMIT + _AS_IS),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD3 + _BSD_END),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Every notice has these letters in either spelling, so lines without them need no digest.
NOTICE_MARK = "licen"


#: Full texts, one file each, named by licence; a second dot tells versions of one text apart.
FOLDER = Path(__file__).parent / "license_texts"
#: Where the licence proper ends and advice on its use begins.
APPENDICES = ("\n   APPENDIX: How to apply", "How to Apply These Terms to Your New", "How to Apply These Terms to Your New Libraries", "ADDENDUM: How to use this License", "Exhibit A - Source Code Form")
#: The same line of the Free Software Foundation's texts over the years.
ADDRESSES = (
    "", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA",
)
#: Names that notices call a licence by, by SPDX name.
_GNU = {"GPL": ("GNU General Public License", "GNU GPL", "GPL"), "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")"),
    "MIT": ("MIT License", "MIT", "MIT/X11 License", "Expat License"), "ISC": ("ISC License", "ISC"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License", "Revised BSD License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",), "Zlib": ("zlib License", "zlib/libpng License"), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero License"), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "NCSA": ("University of Illinois/NCSA Open Source License",),
    "Artistic-2.0": ("Artistic License 2.0",), "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License"), "WTFPL": ("WTFPL",),
    **{f"{g}-{v}": tuple(f"{n}{m}" for n in names for m in (f", version {v}", f" version {v}", f" v{v}", f", v{v}", f" {v}", f"v{v}", *((f", version {v[0]}", f" version {v[0]}", f" v{v[0]}", f"v{v[0]}", f" {v[0]}") if v.endswith(".0") else ())))
       for g, names in _GNU.items() for v in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}[g]},
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"CC-{k} {v}", *(f"Creative Commons {n} {v}{m}" for n in {full, full.replace("NoDerivatives", "NoDerivs")} for m in (" International License", " International", " Unported License", " License", " Generic License")))
       for k, full in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")},
}
#: How a canonical line that names a licence begins; all such beginnings count as equal.
PHRASE = (
    r"^(?:license )?(?:(?:this|the|it|all|our)(?: [\p{L}\p{N}]+){0,5}? (?:is|are) )?(?:also )?(?:(?:free )?software )?"
    r"(?:licensed|released|distributed|published|provided|(?:made )?available) (?:to you )?under (?:the terms of )?(?:the |an? )?"
)
PLAIN = ("License: {}", "Licensed {}")
#: Notices of several lines; each is looked for in two lines that follow each other.
HEADERS = (
    *((f"{name}{later}", f"{start} under the terms of the {full} as published by the Free Software Foundation; {either} {v}{of} of the License{tail}")
      for start in ("it", "modify it", "This program is free software; you can redistribute it and/or modify it")
      for g, full in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("LGPL", "GNU Library General Public License"), ("AGPL", "GNU Affero General Public License"))
      for v, name in (("1", f"{g}-1.0"), ("2", f"{g}-2.0"), ("2.1", f"{g}-2.1"), ("3", f"{g}-3.0")) if (g, v) in {("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")}
      for later, either, of, tail in (("-or-later", "either version", "", ", or"), ("-or-later", "either version", "", ", or (at your option)"), ("-or-later", "either version", "", ", or (at your option) any later version."), ("", "version", "", "."), ("", "version", "", ""))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)


@cache
def all_texts() -> tuple[tuple[str, str], ...]:
    """TEXTS and the files, these also without their appendices and with any of the addresses."""
    out = list(TEXTS)
    for path in sorted(FOLDER.glob("*.txt")):
        name, whole = path.stem.removesuffix(".spdx"), path.read_text("utf-8")
        forms = {whole, *(whole[: whole.index(mark)] for mark in APPENDICES if mark in whole)}
        for form in sorted(forms):
            lines = form.split("\n")
            at = [i for i, x in enumerate(lines[:12]) if "Boston, MA" in x or "Cambridge, MA" in x]
            out += [(name, "\n".join([*lines[: at[0]], a, *lines[at[0] + 1 :]])) for a in ADDRESSES] if at else [(name, form)]
            out.append((name, form))
    return tuple(dict.fromkeys(out))


@cache
def all_notices() -> tuple[tuple[str, str], ...]:
    """NOTICES, every name in a phrase, headers and an SPDX line for every SPDX name.

    "or later" licences keep that name; "only" is the licence itself.
    """
    ids = (FOLDER / "SPDX_IDS").read_text("utf-8").split()
    out = [(name.removesuffix("-only"), "SPDX-License-Identifier: " + name) for name in ids]
    out += [(name, p.format(called)) for name, names in NAMES.items() for called in names for p in ("Licensed under {}", *PLAIN)]
    out += [(f"{name}-or-later", f"Licensed under {called} or {x}") for name, names in NAMES.items() if name.split("-")[0] in _GNU for called in names for x in ("later", "any later version")]
    return (*NOTICES, *HEADERS, *out)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, single spaces instead of punctuation."""
    t = F.lower(text)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    for line in (NAMED_LINE, COPYRIGHT_LINE, RIGHTS_LINE):
        t = F.regexp_replace(t, LINES + line, "")
    return F.trim(F.regexp_replace(t, BETWEEN, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def notice_digest(line: Column) -> Column:
    return F.sha2(F.regexp_replace(canonical(line), PHRASE, "under "), 256)


def known_digests(spark: SparkSession, texts=TEXTS, digest=digest) -> DataFrame:
    """(known, license_id), one row per digest; a digest of two names keeps the lesser.

    ``texts`` is a sequence of (name, text) or a table (license_id, text) of any size.
    """
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(t, n) for n, t in texts], "text string, license_id string")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, texts=None, notices=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id and notices for every row of ``docs``.

    digest is of the canonical entire text (null for a null text; an empty text has the digest of
    no bytes) and license_id the known licence that it equals, else null. notices lists, without
    repeats and in order, the licences whose notice some whole line of the text, or two lines that
    follow each other, equal. ``texts`` (``all_texts`` unless given) may be a table of any size:
    its digests are counted, broadcast up to 50,000 and joined by hash beyond. The notices
    (``all_notices`` unless given) are a constant list. Repeated rows get equal answers; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    known = known_digests(spark, all_texts() if texts is None else texts).withColumnRenamed("known", "digest")
    if not isinstance(texts, DataFrame) or known.count() <= 50_000:
        known = F.broadcast(known)
    lines = {r["known"]: r["license_id"] for r in known_digests(spark, notices or all_notices(), notice_digest).collect()}

    def marked(x: Column) -> Column:
        return F.lower(x).contains(NOTICE_MARK)

    def joined(x: Column) -> Column:
        return F.concat(x, F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.concat_ws(" ", a, b)))

    text = F.col(text_col)
    split = F.filter(let(F.split(F.when(marked(text), text), "\n"), joined), lambda x: marked(x))
    names = F.from_json(F.lit(json.dumps(dict(sorted(lines.items())))), "map<string,string>")
    named = F.transform(split, lambda x: F.try_element_at(names, notice_digest(x)))
    found = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    scanned = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("notices"))
    return scanned.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def scan_sql(texts=TEXTS, notices=NOTICES) -> str:
    """The same scan in ANSI SQL with regular expressions; notices as one comma-joined string."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def clean(x: str) -> str:
        x = f"lower({x})"
        for old, new in SPELLINGS:
            x = f"replace({x}, {quoted(old)}, {quoted(new)})"
        for pattern, new in ((SQL_LINES + COPYRIGHT_LINE, ""), (SQL_LINES + RIGHTS_LINE, ""), (BETWEEN, " ")):
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
        return f"sha256(trim({x}))"

    def values(rows) -> str:
        return ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in rows)

    return f"""
        with known as (select {clean('t')} as digest, min(n) as license_id from (values {values(texts)}) as v(n, t) group by 1),
        lines as (select {clean('t')} as digest, min(n) as license_id from (values {values(notices)}) as v(n, t) group by 1),
        split as (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents),
        said as (select doc_id, string_agg(distinct l.license_id, ',' order by l.license_id) as notices
                 from split join lines l on {clean('line')} = l.digest where contains(lower(line), '{NOTICE_MARK}') group by doc_id),
        whole as (select doc_id, {clean('text')} as digest from documents)
        select w.doc_id, w.digest, k.license_id, coalesce(s.notices, '') as notices
        from whole w left join known k on w.digest = k.digest left join said s on w.doc_id = s.doc_id
    """

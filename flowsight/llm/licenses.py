"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (copyright lines out, A-Z lowered,
punctuation to spaces, equivalent spellings to one, white space to one space) and
its SHA-256 is hash-joined to the digests of known licence texts.  Digests cover
entire texts only: the whole document, every line of it on its own, and every run
of lines that begins as a known text and has its canonical length, however it is
wrapped, since notices stand on lines of their own inside other text.

The known texts are a parameter table (licence, text); the default are ``NOTICES``,
``HEADERS`` and the full texts in ``licence_texts`` under their usual titles.
The lines' digests are computed only for lines whose canonical length some known
text has, so few rows are joined; nothing of a document's text is shuffled.  The
beginnings and lengths of the known texts are sent to the workers.

Cases: null, empty and copyright-only texts have no licence; texts known under
several names give all of them, sorted; repeated rows are each returned; an empty
table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.llm.common import UPPER, LOWER, map_batches, materialise, prepare

# Equivalent spellings in licence texts (left to right).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "colour": "color", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "sublicence": "sublicense",
    "https": "http",
}
# Spellings in two words.
PAIRS = {"sub license": "sublicense", "sub licensed": "sublicensed", "non commercial": "noncommercial",
         "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders"}
# Usual one-line notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_GPL = """This %s is free software%s you can redistribute it and/or modify it under the terms of the GNU %s as
published by the Free Software Foundation%s version %s of the License, or (at your option) any later version.

This %s is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU %s for more details."""
_GPL_COPY = "You should have received a copy of the GNU %s along with this %s.  If not, see <http://www.gnu.org/licenses/>."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.  See the License for the
specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at %smozilla.org/MPL/2.0/."""


def _gnu_headers() -> Iterator[tuple[str, str]]:
    for licence, name, version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
                                   ("LGPL-2.1", "Lesser General Public License", "2.1"),
                                   ("LGPL-3.0", "Lesser General Public License", "3"),
                                   ("AGPL-3.0", "Affero General Public License", "3")):
        for what in ("program", "library", "software"):
            for either in (", either", "; either"):
                text = _GPL % (what, ":", name, either, version, what, name)
                yield licence, text
                yield licence, text + "\n\n" + _GPL_COPY % (name, what)


# Usual notices of several lines.
HEADERS = [("Apache-2.0", _APACHE), *[("MPL-2.0", _MPL % x) for x in ("http://", "")], *_gnu_headers()]
# Titles that licences' bodies stand under, besides none.
TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License",
                     "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Usual other wordings of the bodies, one licence's (pattern, replacements).
WORDINGS = {
    "BSD-2-Clause": [(r"(?m)^ *\d\. ", ["* "])],
    "BSD-3-Clause": [(r"(?m)^ *\d\. ", ["* "]),
                     (r"the name of the copyright holder nor", ["the name of the copyright holders nor", "the name of the author nor",
                                                               "the name of the University nor"]),
                     (r"COPYRIGHT\s+HOLDER OR CONTRIBUTORS BE", ["COPYRIGHT OWNER OR CONTRIBUTORS BE", "COPYRIGHT HOLDERS OR CONTRIBUTORS BE"])],
    "ISC": [("and/or", ["and"])],
    "Apache-2.0": [(r"(?s)\s*APPENDIX: How to apply.*", [""]), (r"(?m)^ *Copyright \[yyyy\].*$", [""])],
    "Unlicense": [("http://unlicense.org", ["http://unlicense.org"]), (r"(?s)\s*For more information.*", [""])],
}


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full texts, in their usual wordings and under their titles."""
    out = []
    for path in sorted((resources.files(__package__) / "licence_texts").iterdir(), key=lambda x: x.name):
        if path.name.endswith(".txt"):
            licence = path.name.removesuffix(".txt")
            bodies = [path.read_text(encoding="utf-8")]
            for pattern, others in WORDINGS.get(licence, []):
                bodies += [re.sub(pattern, lambda m, o=o: o, b) for b in bodies for o in others]
            out += [(licence, f"{title}\n\n{b}" if title else b) for b in bodies for title in ["", *TITLES.get(licence, [])]]
    return list(dict.fromkeys(out))


# ASCII other than letters and digits, and usual typographic signs, separate words.
_SEPARATORS = {chr(c): " " for c in [*(i for i in range(128) if not chr(i).isalnum()), 0xA0, 0xB7, *range(0x2010, 0x2016),
                                     0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2026, 0xFEFF]}
_CANON = str.maketrans({**_SEPARATORS, **dict(zip(UPPER, LOWER))})
COPYRIGHT = re.compile(r"^[^\w©\n]*(?:(?:copyright\b|\(c\)|©)[^\n]*?(?:\(c\)|©|\d{4})[^\n]*"
                       r"|(?:\(c\)|©)[^\n]*|all rights reserved\W*)$", re.IGNORECASE | re.MULTILINE)
_MAYBE = re.compile(r"copyright|\(c\)|©|all rights", re.IGNORECASE)
_PAIR = re.compile(r"\b(?:" + "|".join(sorted(PAIRS, key=len, reverse=True)) + r")\b")


def canonical(text: str) -> str:
    """The canonical form; empty where nothing but copyright lines is left."""
    if _MAYBE.search(text):
        text = COPYRIGHT.sub("", text)
    words = " ".join([SPELLINGS.get(w, w) for w in text.translate(_CANON).split()])
    return _PAIR.sub(lambda m: PAIRS[m.group()], words)


#: Characters that a run of lines must share with a known text to be looked at.
HEAD = 24


def run_digests(lines: list[str], canon: list[str], sizes: dict[str, list[int]], heads: set[str]) -> set[bytes]:
    """Digests of the runs of two lines or more that begin as a known text and have
    its length; canon: of the single lines, sizes: lengths by head, heads: all
    beginnings of heads."""
    out = set()
    for i, c in enumerate(canon):
        # joined spellings begin with their first word, so a line cut there is a beginning too
        if c[:HEAD] not in heads:
            continue
        start, j = c, i + 1
        while len(start) <= 2 * HEAD and j < len(lines):
            j += 1
            start = canonical("\n".join(lines[i:j]))
        for n in sorted({n for k in range(1, HEAD + 1) for n in sizes.get(start[:k], [])}):
            # lengths grow with the run: the first end at which it is long enough
            low, high = i + 2, min(len(lines), i + 2)
            while high < len(lines) and len(canonical("\n".join(lines[i:high]))) < n:
                low, high = high + 1, min(len(lines), i + 2 * (high - i))
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if len(canonical("\n".join(lines[i:mid]))) < n else (low, mid)
            run = canonical("\n".join(lines[i:high]))
            if len(run) == n and high > i + 1:
                out.add(digest(run))
    return out


def digest(canon: str) -> bytes | None:
    return hashlib.sha256(canon.encode()).digest() if canon else None


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licences, n_chars, head) of a table (licence, text); head: the first
    HEAD characters of the canonical form."""
    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        canon = [canonical(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest, canon), pa.binary()),
                                          pa.array(map(len, canon), pa.int32()), pa.array([c[:HEAD] for c in canon])],
                                         ["licence", "digest", "n_chars", "head"])
    return map_batches(known.select("licence", "text"), one, "licence string, digest binary, n_chars int, head string") \
        .where("digest is not null and licence is not null") \
        .groupBy("digest").agg(F.array_sort(F.collect_set("licence")).alias("licences"), F.max("n_chars").alias("n_chars"),
                               F.max("head").alias("head"))


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES + HEADERS + full_texts(), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, canonical_sha256 (hex; null where nothing is left),
    licences (of the entire text, null if none), line_licences (of entire lines
    and runs of lines that are not the whole text, sorted, empty if none)."""
    spark = docs.sparkSession
    prepare(spark)
    known_d = materialise(known_digests(known if known is not None else default_known(spark)), "licences")
    longest = known_d.agg(F.min("n_chars"), F.max("n_chars")).first()
    low, high = longest[0] or 0, longest[1] or 0
    sizes: dict[str, list[int]] = {}
    for k in known_d.select("head", "n_chars").distinct().orderBy("head", "n_chars").collect():
        sizes.setdefault(k["head"], []).append(k.n_chars)
    heads = {h[:i] for h in sizes for i in range(1, len(h) + 1)}
    sel = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(sel.dtypes)["doc_id"]

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole, lines = [], []
        for t in b.column(1).to_pylist():
            t = t or ""
            whole.append(digest(canonical(t)))
            if "\n" not in t:
                lines.append([])
                continue
            split = t.split("\n")
            canon = [canonical(x) for x in split]
            runs = run_digests(split, canon, sizes, heads) - {whole[-1]}
            lines.append(sorted({digest(c) for c in canon if low <= len(c) <= high and c} | runs))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary()), pa.array(lines, pa.list_(pa.binary()))],
                                         ["doc_id", "whole", "lines"])
    rows = materialise(map_batches(sel, one, f"doc_id {kind}, whole binary, lines array<binary>"), "licence-rows")
    # rows with the same lines share their result: no row identity is needed
    some = rows.where(F.size("lines") > 0)
    per_line = (some.select("lines").distinct()
                .select("lines", F.explode("lines").alias("digest")).join(known_d, "digest")
                .groupBy("lines").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("licences")))).alias("line_licences")))
    lined = some.join(per_line, "lines", "left").select("doc_id", "whole", "line_licences") \
        .unionByName(rows.where(F.size("lines") == 0).select("doc_id", "whole", F.lit(None).cast("array<string>").alias("line_licences")))
    return (lined
            .join(known_d.select(F.col("digest").alias("whole"), "licences"), "whole", "left")
            .select("doc_id", F.lower(F.hex("whole")).alias("canonical_sha256"), "licences",
                    F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences")))

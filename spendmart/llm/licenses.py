"""License scans by conditional compression.

Lines and sentences that mention licensing are candidate blocks, and so are runs of neighbouring lines that hold enough
three-word sequences of a template, each run about as long as its template. A block is compressed plainly and with every
template as a zstandard raw dictionary; the template that saves most bytes, relative to the block, wins. The winner is
confirmed by comparing wordings: the words the block lacks, adds or changes are listed, and too many of them reject it.
Lines of a confirmed run are no candidates of their own. Texts without a trigger word never leave the JVM; everything is
row by row, without a shuffle.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One-line mentions
MENTIONS = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
}
_CC = 'This work is licensed under a Creative Commons {} 4.0 International License.'
_GNU = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation; "
    "either version {3} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. "
    "You should have received a copy of the GNU {2} along with {4}"
)
_FROM = "this {}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = "this {}. If not, see <https://www.gnu.org/licenses/>."
# Notices as their licences give them
NOTICES = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "cc-by-4.0": _CC.format("Attribution"),
    "cc-by-sa-4.0": _CC.format("Attribution-ShareAlike"),
    "cc-by-nc-sa-4.0": _CC.format("Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd-4.0": _CC.format("Attribution-NoDerivatives"),
    "cc-by-nc-nd-4.0": _CC.format("Attribution-NonCommercial-NoDerivatives"),
    "cc0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the "
    "public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along "
    "with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "epl-1.0-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
    "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": _GNU.format("This program", ";", "General Public License", 2, _FROM.format("program")),
    "gpl-3.0-notice": _GNU.format("This program", ":", "General Public License", 3, _SEE.format("program")),
    "lgpl-2.1-notice": _GNU.format("This library", ";", "Lesser General Public License", 2.1, _FROM.format("library")),
    "lgpl-3.0-notice": _GNU.format("This library", ":", "Lesser General Public License", 3, _SEE.format("library")),
    "agpl-3.0-notice": _GNU.format("This program", ":", "Affero General Public License", 3, _SEE.format("program")),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# Whole texts, in license_texts
BODIES = ["agpl-3.0", "apache-2.0", "artistic-1.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "gfdl-1.3", "gpl-2.0", "gpl-3.0", "isc",
          "lgpl-2.1", "lgpl-3.0", "mit", "mpl-1.1", "mpl-2.0", "unlicense", "zlib"]
TEMPLATES = MENTIONS | NOTICES | {f"{name}-text": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in BODIES}
TRIGGER = r"(?i)licen[cs]e|all rights reserved|copyright|creative commons|implied\s+warrant"
LONG_WORDS = 60  # a longer line is cut into sentences, and a longer sentence into overlapping pieces
MAX_DIFFERENT = 0.25  # words that differ, against the template's
SEED = 3  # words of a sequence by which runs are found
LEAST_SEEDS = 0.2  # of a template's sequences; a quarter of the words changed leaves a quarter of them
STRETCH = 1.3  # a run's words, against the template's
_WORD = re.compile(r"[\w.+-]*\w", re.UNICODE)
_TRIGGER = re.compile(TRIGGER)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def lines_of(text: str) -> list[tuple[int, int, int]]:
    """(line number from 0, start, end) of every candidate inside one line."""
    out, begin = [], 0
    for number, line in enumerate(text.split("\n")):
        if _TRIGGER.search(line):
            ends = [(0, len(line))]
            if len(line.split()) > LONG_WORDS:
                cuts = [(m.start(), m.end()) for m in re.finditer(r"(?<=[.;!?])\s+", line)]
                ends = list(zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(line)], strict=True))
            for low, high in ends:
                words = [(m.start() + low, m.end() + low) for m in re.finditer(r"\S+", line[low:high])]
                for k in range(0, len(words), LONG_WORDS // 2) if len(words) > LONG_WORDS else ([0] if words else []):
                    part = words[k : k + LONG_WORDS]
                    if _TRIGGER.search(line[part[0][0] : part[-1][1]]):
                        out.append((number, begin + part[0][0], begin + part[-1][1]))
        begin += len(line) + 1
    return out


_PLAIN = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
_WITH = {
    name: zstandard.ZstdCompressor(
        level=19, write_content_size=False, write_checksum=False,
        dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
    )
    for name, text in TEMPLATES.items()
}
_TEMPLATE_WORDS = {name: words_of(text) for name, text in TEMPLATES.items()}
_BAGS = {name: Counter(words) for name, words in _TEMPLATE_WORDS.items()}
_SEEDS: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
for _name, _words in _TEMPLATE_WORDS.items():
    for _k in range(len(_words) - SEED + 1):
        _SEEDS[tuple(_words[_k : _k + SEED])].append((_name, _k))


def differences(template: list[str], block: list[str]) -> tuple[int, list[str]]:
    """(template words not there as they are, wording changes as `-gone +new`)."""
    missing, changes = 0, []
    for kind, a, b, c, d in SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
        if kind != "equal":
            missing += b - a
            changes.append(" ".join([f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[c:d]]))
    return missing, changes


def _judged(block: str) -> tuple | None:
    raw, mine = block.encode(), words_of(block)
    plain, bag = len(_PLAIN.compress(raw)), Counter(mine)
    # a template that lacks too many words in any order lacks them in its own
    open_ = [n for n, theirs in _BAGS.items() if (theirs - bag).total() <= MAX_DIFFERENT * len(_TEMPLATE_WORDS[n])]
    saved = {name: (plain - len(_WITH[name].compress(raw))) / plain for name in open_}
    # in the order of savings, until a wording is confirmed; ties by name
    for name in sorted(saved, key=lambda n: (-saved[n], n)):
        if saved[name] <= 0:
            return None
        theirs = _TEMPLATE_WORDS[name]
        missing, changes = differences(theirs, mine)
        if missing <= MAX_DIFFERENT * len(theirs):
            return name, round(saved[name], 6), missing, len(mine) - (len(theirs) - missing), changes
    return None


_short, _long = lru_cache(maxsize=1 << 15)(_judged), lru_cache(maxsize=1 << 8)(_judged)


def judge(block: str) -> tuple | None:
    """(license, share of bytes saved, template words missing, other words, changes), or None if no wording is near enough."""
    return (_short if len(block) <= 1000 else _long)(block)


def _densest(seeds: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Of one template's (word position, template position) in a text, those of the stretch that holds most different ones."""
    span, low, best, held = STRETCH * length + SEED, 0, (0, 0, 0), Counter()
    for high, (at, offset) in enumerate(seeds):
        held[offset] += 1
        while at - seeds[low][0] > span:
            held[seeds[low][1]] -= 1
            if not held[seeds[low][1]]:
                del held[seeds[low][1]]
            low += 1
        if len(held) > best[0]:
            best = (len(held), low, high + 1)
    part = seeds[best[1] : best[2]]
    # a sequence far from its place belongs to something else
    middle = sorted(at - offset for at, offset in part)[len(part) // 2]
    return [(at, offset) for at, offset in part if abs(at - offset - middle) <= max(8, (STRETCH - 1) * length)]


def runs_of(text: str) -> list[tuple[int, int, int, tuple]]:
    """(line number from 0, start, end, verdict) of every confirmed block that is more than one line or sentence."""
    found = list(_WORD.finditer(text))
    words = [m.group().lower() for m in found]
    seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for at in range(len(words) - SEED + 1):
        for name, offset in _SEEDS.get(tuple(words[at : at + SEED]), ()):
            seeds[name].append((at, offset))
    edges = [0, *(m.end() for m in re.finditer("\n", text))]
    edge_of = lambda at: bisect_right(edges, at) - 1
    length = {name: len(_TEMPLATE_WORDS[name]) for name in seeds}
    out, later, taken = [], [], bytearray(len(words))
    near = {name: _densest(mine, length[name]) for name, mine in seeds.items()}
    held = {name: len({offset for _, offset in part}) for name, part in near.items()}

    def again(name):
        seeds[name] = [x for x in seeds[name] if not taken[x[0]]]
        near[name] = _densest(seeds[name], length[name]) if seeds[name] else []
        held[name] = len({offset for _, offset in near[name]})

    while True:
        # the template with most sequences there first; what a confirmed run holds is gone for the others
        name = min(held, key=lambda n: (-held[n], length[n], n), default=None)
        if name is None or not held[name]:
            break
        if any(taken[at] for at, _ in near[name]):
            again(name)
            continue
        if held[name] < LEAST_SEEDS * (length[name] - SEED + 1):
            held[name] = 0
            continue
        first, last = min(near[name]), max(near[name])
        low, high = max(0, first[0] - first[1]), min(len(words), last[0] + length[name] - last[1])
        while low < first[0] and any(taken[low : first[0]]):
            low += 1
        while high > last[0] + SEED and any(taken[last[0] : high]):
            high -= 1
        start, end = found[low].start(), found[high - 1].end()
        begins, ends = edge_of(start), edge_of(end - 1)
        for edge in {begins, ends}:  # short lines as wholes, long ones as far as the words go
            stop = edges[edge + 1] - 1 if edge + 1 < len(edges) else len(text)
            if len(text[edges[edge] : stop].split()) <= LONG_WORDS:
                start, end = (edges[edge] if edge == begins else start), (stop if edge == ends else end)
        while end < len(text) and not text[end].isspace():
            end += 1
        block = text[start:end].strip()
        several = begins < ends or len(block.split()) > LONG_WORDS or re.search(r"(?<=[.;!?])\s+\S", block)
        verdict = judge(block) if several and _TRIGGER.search(block) else None
        if verdict and verdict[0] == name:
            out.append((begins, start, end, verdict))
            taken[low:high] = b"\1" * (high - low)
        elif verdict:
            later.append((begins, start, end, verdict))
        gone = set(near[name])
        seeds[name] = [x for x in seeds[name] if x not in gone]
        again(name)
    # blocks whose wording is another template's, where that one has none of its own
    lone = [(start, end) for _, start, end in lines_of(text) if judge(text[start:end])] if later else []
    for run in later:
        if not any(run[1] < end and start < run[2] for start, end in [*((s, e) for _, s, e, _ in out), *lone]):
            out.append(run)
    return out


def blocks_of(text: str) -> list[tuple[int, str, tuple | None]]:
    """(line number from 0, block, verdict) of every candidate, in the order of the text."""
    runs = runs_of(text)
    rest = [(line, start, end) for line, start, end in lines_of(text) if not any(s < end and start < e for _, s, e, _ in runs)]
    every = [(start, line, text[start:end].strip(), judge(text[start:end].strip())) for line, start, end in rest]
    every += [(start, line, text[start:end].strip(), verdict) for line, start, end, verdict in runs]
    return [x[1:] for x in sorted(every, key=lambda x: x[:3])]


def _found(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for number, (line, _, verdict) in enumerate(blocks_of(text)):
                if verdict:
                    for column, value in zip(out, (doc, number, line, *verdict), strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                                         names=["doc_id", "block", "line", "license", "saved", "n_missing", "n_other", "changes"])


def license_blocks(docs: DataFrame) -> DataFrame:
    """Per confirmed block of docs (doc_id, text): doc_id, block, line, license, saved, n_missing, n_other, changes.

    block: number of the candidate in its document; saved: share of compressed bytes the template saves; n_missing:
    template words the block lacks; n_other: words it has besides; changes: the differing wordings. Null and empty texts,
    and blocks near no template, give no row; repeated rows repeat theirs.
    """
    candidates = docs.select("doc_id", "text").filter(F.col("text").rlike(TRIGGER))
    schema = "doc_id long, block int, line int, license string, saved double, n_missing int, n_other int, changes array<string>"
    return candidates.mapInArrow(_found, schema)

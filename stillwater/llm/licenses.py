"""License scan: winnowed fingerprints pick candidates, banded alignment confirms.

Templates and documents are sequences of lower-cased words.  The hashes of all
runs of ``GRAM`` words are winnowed (the smallest of every ``WINDOW`` runs); an
inverted index maps a template's fingerprints to its places.  A document's
fingerprints that meet the index vote for (template, diagonal).  A cluster of
votes is aligned with the template inside a band: around one diagonal for a
template of a few words, along the chain of the votes for a long one, whose
diagonal drifts with every word put in or left out.  The report gives the words
matched, the share of the template covered and the span in the original text;
of templates that claim the same place, the one with the most words matched.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .common import LOWER, RollingHash, mix, text_blocks, word_bounds
from .decontaminate import WORD

GRAM, WINDOW = 3, 2
BAND = 4
#: A copy's diagonal may drift by the template's words divided by this.
DRIFT = 2
#: Least share of a template's words, in thousandths, that is reported.
LEAST_COVERAGE = 700

_GNU = (
    "is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. "
    "{3} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. "
    "You should have received a copy of the GNU {1} along with {4}; if not, "
)
_POST = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_WEB = "see <https://www.gnu.org/licenses/>."


def _gnu(license: str, version: str, what: str, end: str) -> str:
    return f"This {what} " + _GNU.format(":", license, version, f"This {what}", f"this {what}") + end


# Public license notices and the headers that licenses ask for, (license, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _gnu("General Public License", "2", "program", _POST)),
    ("GPL-3.0", _gnu("General Public License", "3", "program", _WEB)),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library", _POST)),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "program", _WEB)),
    ("AGPL-3.0", _gnu("Affero General Public License", "3", "program", _WEB)),
]


@cache
def all_templates() -> list[tuple[str, str]]:
    """``TEMPLATES`` and the whole texts in ``license_texts``, each named by its file."""
    texts = sorted((f for f in (files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return TEMPLATES + [(f.name[:-4], f.read_text(encoding="utf-8")) for f in texts]


def words_of(data: np.ndarray, offsets: np.ndarray):
    lowered = LOWER[data]
    starts, ends, per = word_bounds(lowered, offsets, WORD)
    return RollingHash(lowered).span(starts, ends), starts, ends, per


def winnow(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word positions: the rightmost smallest of each window."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[j : j + n])
    if n <= window:
        at = np.array([n - 1 - int(np.argmin(h[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
        at = np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))
    return h[at], at


class TemplateIndex:
    """Inverted index of the templates' fingerprints; the size is that of the templates."""

    def __init__(self, templates):
        self.names = [n for n, _ in templates]
        self.bits = {}  # by template and distinct word: the word's places
        self.words, self.bags, prints, owners, places, single = [], [], [], [], [], []
        for k, (_, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            words = words_of(raw, np.array([0, len(raw)]))[0]
            self.words.append(words)
            self.bags.append(np.unique(words, return_counts=True))
            h, at = winnow(words, window=1)
            prints.append(h)
            owners.append(np.full(len(h), k))
            places.append(at)
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            single.append(counts[inverse] == 1)
        prints, owners, places, single = (np.concatenate(x) for x in (prints, owners, places, single))
        order = np.argsort(prints, kind="stable")
        self.prints, self.owners, self.places, self.single = prints[order], owners[order], places[order], single[order]

    def votes(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By template: (place in it, place in the document, whether the template has the run once) of each fingerprint met."""
        h, at = winnow(words)
        lo, hi = np.searchsorted(self.prints, h, "left"), np.searchsorted(self.prints, h, "right")
        n = hi - lo
        e = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(h) else np.zeros(0, int)
        found = np.stack([self.places[e], np.repeat(at, n), self.single[e]], axis=1).astype(np.int64)
        return {int(k): found[self.owners[e] == k] for k in np.unique(self.owners[e])}

    def within_reach(self, k: int, words: np.ndarray) -> bool:
        """Whether ``words`` hold enough of the template's words, in its order, to be reported; no alignment matches more."""
        (values, counts), n = self.bags[k], len(self.words[k])
        at = np.minimum(np.searchsorted(values, words), len(values) - 1)
        at = at[values[at] == words]
        if 1000 * int(np.minimum(np.bincount(at, minlength=len(values)), counts).sum()) < LEAST_COVERAGE * n:
            return False
        if k not in self.bits:
            self.bits[k] = [0] * len(values)
            for i, v in enumerate(np.searchsorted(values, self.words[k]).tolist()):
                self.bits[k][v] |= 1 << i
        bits, every = self.bits[k], (1 << n) - 1
        row = every  # bit-parallel longest common subsequence: its length is the number of zeros
        for v in at.tolist():
            u = row & bits[v]
            row = ((row + u) | (row - u)) & every
        return 1000 * (n - row.bit_count()) >= LEAST_COVERAGE * n


def banded(template: np.ndarray, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: words matched, first and end word of the span.

    A match scores 2, a mismatch or gap -1; only document words from ``first[i]``
    to before ``end[i]`` are tried for the template's word ``i``.
    """
    best, score = (0, 0, 0, 0), {}
    for i, t in enumerate(template.tolist()):
        row, a, b = {}, max(0, int(first[i])), min(len(words), int(end[i]))
        for j, word in enumerate(words[a:b].tolist(), a):
            same = t == word
            s, m, start = score.get(j - 1, (0, 0, j))
            options = [(0, 0, j + 1), (s + (2 if same else -1), m + same, start if s > 0 else j)]
            for cell in (score.get(j), row.get(j - 1)):
                if cell:
                    options.append((cell[0] - 1, cell[1], cell[2]))
            row[j] = max(options, key=lambda c: (c[0], -c[2]))
            if row[j][0] > best[0]:
                best = (*row[j], j + 1)
        score = row
    return best[1], best[2], best[3]


def chain(votes: np.ndarray) -> np.ndarray:
    """Longest run of votes that goes forward in template and document."""
    votes = votes[np.lexsort((-votes[:, 0], votes[:, 1]))]
    tails, ends, back = [], [], []
    for k, i in enumerate(votes[:, 0].tolist()):
        at = bisect_left(tails, i)
        tails[at:at + 1], ends[at:at + 1] = [i], [k]
        back.append(ends[at - 1] if at else -1)
    path, k = [], ends[-1]
    while k >= 0:
        path.append(k)
        k = back[k]
    return votes[path[::-1]]


def along(path: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end document word for each of ``n`` template words: a band along the votes of ``path``."""
    i, d = path[:, 0], path[:, 1] - path[:, 0]
    row = np.arange(n)
    after = np.minimum(np.searchsorted(i, row), len(i) - 1)  # the vote at the row or after it
    before = np.maximum(np.searchsorted(i, row, "right") - 1, 0)
    low, high = row + np.minimum(d[before], d[after]), row + np.maximum(d[before], d[after])
    inside = (row >= i[0]) & (row <= i[-1])  # between two votes only their rectangle is tried
    low, high = np.where(inside, np.maximum(low, path[before, 1]), low), np.where(inside, np.minimum(high, path[after, 1]), high)
    return low - BAND, high + BAND + 1


def scan_text(index: TemplateIndex, words: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, words matched, first word, end word) of every confirmed place."""
    out = set()
    for k, votes in index.votes(words).items():
        n = len(index.words[k])
        if not index.within_reach(k, words):
            continue
        drift = max(BAND, n // DRIFT)
        while len(votes):
            d = votes[:, 1] - votes[:, 0]
            seen, counts = np.unique(d, return_counts=True)
            top = int(seen[np.argmax(counts)])
            group = votes[np.abs(d - top) <= drift]
            if not index.within_reach(k, words[max(0, top - drift - BAND) : max(0, top + n + drift + BAND)]):
                votes = votes[np.abs(d - top) > max(BAND, drift // 8)]
                continue
            votes = votes[np.abs(d - top) > drift]
            sure = group[group[:, 2] == 1]
            path = chain(sure) if len(sure) else group[group[:, 1] - group[:, 0] == top]
            matched, first, end = banded(index.words[k], words, *along(path, n))
            if 1000 * matched >= LEAST_COVERAGE * n:
                out.add((k, matched, first, end))
                votes = votes[(votes[:, 1] < first) | (votes[:, 1] >= end)]
    kept = []
    for x in sorted(out, key=lambda x: (-x[1], len(index.words[x[0]]), x[2], x[0])):
        if 2 * sum(max(0, min(x[3], y[3]) - max(x[2], y[2])) for y in kept) <= x[3] - x[2]:
            kept.append(x)
    return sorted(kept, key=lambda x: (x[2], x[0], x[1], x[3]))


def _scanner(templates):
    def run(batches):
        index = TemplateIndex(templates)
        for batch, a, b, data, offsets in text_blocks(batches):
            words, starts, ends, per = words_of(data, offsets)
            rows = []
            for k in range(b - a):
                for t, matched, first, end in scan_text(index, words[per[k] : per[k + 1]]):
                    rows.append((a + k, index.names[t], matched, 1000 * matched // len(index.words[t]), int(starts[per[k] + first] - offsets[k]), int(ends[per[k] + end - 1] - offsets[k])))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1])] + [pa.array(c, pa.int64()) for c in cols[2:]],
                    ["id", "license", "matched_words", "coverage_permille", "start_byte", "end_byte"],
                )

    return run


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per place where a license template matches; ``all_templates`` if none are given.

    ``id_col, license, matched_words, coverage_permille, start_byte, end_byte``;
    byte offsets are those of the original UTF-8 text.  Null and empty texts and
    texts without a license give no row; repeated rows repeat theirs; templates
    of fewer than ``GRAM`` words are never found.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    templates = all_templates() if templates is None else templates
    schema = "id long, license string, matched_words long, coverage_permille long, start_byte long, end_byte long"
    return rows.mapInArrow(_scanner(templates), schema).withColumnRenamed("id", id_col)

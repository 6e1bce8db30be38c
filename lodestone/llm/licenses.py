"""Licence scans with a generalised suffix automaton over the words of licence texts.

A document's words stream through the automaton. At each word it knows the longest suffix of the words so far that
stands in some template (the matching statistic). Words of no template reset it, so only runs of template words are
walked. Matches of MIN_MATCH words or more are chained in order for each template, and a template is found if its
chain covers enough of it. Each place where a template stands is a span: the best chain's words are taken out and the
rest is chained anew, and a chain is cut where the template goes back if both sides cover enough. Templates share
wording; where spans of two lie over each other, the one whose template is covered more stays. Base phrases are
templates of their own; each place where one stands is counted.

Nulls and edge cases: a null or empty text has no words, no places and no labels. A very long text is scanned whole;
memory follows its matches. Of chains that cover as much the shortest in the document counts, and of these one in the
middle; of templates that cover equally over each other the first in the list. Repeated rows get the same result
each. An empty table gives no rows. All columns pass through; `licence` is added, in place of a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts_of, with_struct
from .words import ALNUM, LOWER, bounds, hashes

# The texts of public licences (MIT, BSD, ISC, zlib, Unlicense), and of the notices that others are applied
# by (Apache, GPL, LGPL, AGPL, MPL, CC BY), lower-cased, words only.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
}
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MIN_MATCH = 4
#: Share of a template's words that its chain must cover.
COVERED = 0.5

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StringType())),
]


class SuffixAutomaton:
    """Of several token sequences; each state knows one place (sequence, end) for every sequence that its words stand in."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]
        for which, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence, 1):
                last = self._extend(last, token)
                self.places[last].setdefault(which, []).append(end)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for which, ends in self.places[state].items():
                if self.link[state] > 0:
                    held = self.places[self.link[state]].setdefault(which, [])
                    held.extend(e for e in ends if e not in held)

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.places.append({})
        return len(self.link) - 1

    def _split(self, p: int, token: int) -> int:
        """The state that holds just the words of p and then the token."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, token)
        return state


def _best(hits: list[tuple[int, int, int]], total: int) -> tuple[int, int, int]:
    """Words that the best chain covers, with its first and end word in the document; of equal ones the closest, and of those a middle one.

    hits: sorted (end word, end in the template, length). They are chained in the order of the document and of the
    template; overlaps count once.
    """
    if not hits:
        return 0, 0, 0
    at, ends = np.array([h[0] for h in hits]), np.array([h[1] for h in hits])
    covered, firsts = np.zeros(len(hits), np.int64), np.zeros(len(hits), np.int64)
    low = np.searchsorted(at, at - 4 * total)
    for k, (end, e, size) in enumerate(hits):
        covered[k], firsts[k] = size, end - size
        near = low[k] + np.flatnonzero((ends[low[k] : k] < e) & (at[low[k] : k] < end))
        if len(near):
            gain = np.minimum(size, np.minimum(e - ends[near], end - at[near])) + covered[near]
            most = gain.max()
            if most > size:
                covered[k], firsts[k] = most, firsts[near[gain == most]].max()
    top = np.flatnonzero(covered == covered.max())
    top = top[(at - firsts)[top] == (at - firsts)[top].min()]
    k = int(top[len(top) // 2])
    return int(covered[k]), int(firsts[k]), hits[k][0]


def _clip(hits: list[tuple[int, int, int]], first: int, end: int) -> list[tuple[int, int, int]]:
    """What of the hits stands in the document's words first to end."""
    out = []
    for at, e, size in hits:
        over, under = max(0, at - end), max(0, first - (at - size))
        if size > over + under:
            out.append((at - over, e - over, size - over - under))
    return sorted(out)


def _spans(hits: list[tuple[int, int, int]], total: int, top: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """First and end word of all chains that cover enough, and the words they cover, in order; no two overlap."""
    out, left = [], [(hits, top)]
    while left:
        hits, (covered, first, end) = left.pop()
        if covered / total < COVERED:
            continue
        inside = _clip(hits, first, end)
        parts = []
        for (_, e, _), (at, e_next, size_next) in zip(inside, inside[1:]):
            if e_next - size_next < e:  # the template goes back
                parts = [(p, _best(p, total)) for p in (_clip(hits, 0, at - size_next), _clip(hits, at - size_next, hits[-1][0]))]
                if all(best[0] / total >= COVERED for _, best in parts):
                    break
                parts = []
        if not parts:
            out.append((first, end, covered))
            parts = [(p, _best(p, total)) for p in (_clip(hits, 0, first), _clip(hits, end, hits[-1][0]))]
        left += parts
    return sorted(out)


class Scanner:
    def __init__(self) -> None:
        names = [*TEMPLATES, *PHRASES]
        texts = [t.split() for t in [*TEMPLATES.values(), *PHRASES]]
        vocabulary = sorted({w for t in texts for w in t})
        flat = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        hashed = hashes(flat, *bounds(flat, np.array([0, len(flat)]), ALNUM))
        order = np.argsort(hashed)
        self.hashed, self.token = hashed[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[number[w] for w in t] for t in texts]
        self.n_templates, self.names = len(TEMPLATES), names
        self.automaton = SuffixAutomaton(self.sequences)
        self.phrase_at: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]  # (length, phrase) that end a state's words
        for p in range(self.n_templates, len(names)):
            state = 0
            for t in self.sequences[p]:
                state = self.automaton.next[state][t]
            for s in range(1, len(self.automaton.link)):
                u = s
                while u > 0 and u != state:
                    u = self.automaton.link[u]
                if u == state:
                    self.phrase_at[s].append((len(self.sequences[p]), p))

    def matches(self, tokens: list[int], at: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Maximal matches (end word, length, state) of MIN_MATCH or more; places (start word, phrase). tokens stand at words `at`."""
        nexts, link, longest = self.automaton.next, self.automaton.link, self.automaton.length
        state, size, previous, found, places = 0, 0, -2, [], []
        for token, place in zip(tokens, at):
            if place != previous + 1:
                if size >= MIN_MATCH:
                    found.append((previous + 1, size, state))
                state, size = 0, 0
            before = (state, size)
            while state and token not in nexts[state]:
                state = link[state]
                size = longest[state]
            if token in nexts[state]:
                state, size = nexts[state][token], size + 1
            if size <= before[1] and before[1] >= MIN_MATCH:
                found.append((previous + 1, before[1], before[0]))
            for length, phrase in self.phrase_at[state]:
                if size >= length:
                    places.append((place - length + 1, phrase))
            previous = place
        if size >= MIN_MATCH:
            found.append((previous + 1, size, state))
        return found, places

    def chain(self, found: list[tuple[int, int, int]]) -> dict[int, tuple[float, list[tuple[int, int, int]]]]:
        """For each template the share that the best chain covers, and first, end and number of covered words of each chain that covers enough."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in found:
            for which, ends in self.automaton.places[state].items():
                if which < self.n_templates:
                    by.setdefault(which, []).extend((end, e, size) for e in ends)
        out = {}
        for which, hits in by.items():
            total, hits = len(self.sequences[which]), sorted(hits)
            top = _best(hits, total)
            out[which] = (min(1.0, top[0] / total), _spans(hits, total, top) if top[0] / total >= COVERED else [])
        return self._apart(out)

    def _apart(self, found: dict[int, tuple[float, list[tuple[int, int, int]]]]) -> dict[int, tuple[float, list[tuple[int, int, int]]]]:
        """Without spans of which half or more lies over a span that covers a larger share of another template."""
        spans = sorted((-covered / len(self.sequences[which]), which, first, end, covered) for which, (_, held) in found.items() for first, end, covered in held)
        taken, kept = np.zeros(max((end for *_, end, _ in spans), default=0), bool), {which: [] for which in found}
        for _, which, first, end, covered in spans:
            if 2 * np.count_nonzero(taken[first:end]) < end - first:
                taken[first:end] = True
                kept[which].append((first, end, covered))
        return {which: (share, sorted(kept[which])) for which, (share, _) in found.items()}

    def batch(self, batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[list] = [[] for _ in FIELDS]
        for i, j, data, offsets in slices(texts_of(batch)):
            low = LOWER[data]
            starts, ends = bounds(low, offsets, ALNUM)
            hashed, begins = hashes(low, starts, ends), np.searchsorted(starts, offsets)
            k = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
            known = np.flatnonzero(self.hashed[k] == hashed)
            # a match needs two neighbours at least
            pair = np.zeros(len(known), bool)
            close = np.diff(known) == 1
            pair[1:] |= close
            pair[:-1] |= close
            known = known[pair]
            token, cuts = self.token[k[known]], np.searchsorted(known, begins)
            for r in range(j - i):
                a, b = cuts[r], cuts[r + 1]
                found, places = self.matches(token[a:b].tolist(), (known[a:b] - begins[r]).tolist()) if b > a else ([], [])
                chains = self.chain(found) if found else {}
                base = sorted({PHRASES[self.names[p]] for _, p in places})
                more = {self.names[w] for w, (_, held) in chains.items() if held}
                score = max([0.5 if base else 0.0, *(share for share, _ in chains.values())])
                spans = [f"{self.names[w]}:{x}-{y}" for w, (_, held) in sorted(chains.items()) for x, y, _ in held]
                at = [s for s, _ in places]
                row = (int(begins[r + 1] - begins[r]), len(at), min(at, default=None), max(at, default=None), base, sorted({*base, *more}), float(score), spans)
                for column, value in zip(out, row):
                    column.append(value)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.string())]
        return [pa.array(x, kind) for x, kind in zip(out, kinds)]


def scan(docs: DataFrame) -> DataFrame:
    """The documents with `licence`: words, places of base phrases, labels, score and covered template spans.

    Matches that lie further apart than four times the template's length belong to different copies of it. The score is the largest share
    of a template that is covered, or 0.5 if a base phrase stands in the text and that is more.
    """
    return with_struct(docs, "licence", FIELDS, lambda: Scanner().batch)

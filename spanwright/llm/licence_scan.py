"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the licence templates, as words. A file is streamed
through it; at each word it gives the longest substring of any template that ends there (its
matching statistic) and where that substring stands in each template. Long maximal matches
are then chained, template by template, in the order of both file and template, with bounded
gaps; a chain covers a span of the file and a share of its template, and skips no word that makes
another licence of it. Templates then take their words, the one that covers most first, so that
a notice labels its own licence and not those that differ from it in a word. All disjoint chains that
cover enough are spans; a template of which all its chains together cover enough adds its label
(and, if none does alone, all of them as spans). Phrases that name a licence are counted beside it.

Words of the templates are numbered; other words end every match, so runs of numbered words
are all that needs streaming.

The templates are notices and typical passages of the full texts, not whole licences.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows each
come back; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that name a licence, and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Licence texts and notices (fixed values).
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "gpl",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other "
        "practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is "
        "intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    (
        "gpl",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is "
        "intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General "
        "Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public "
        "License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "agpl",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure "
        "cooperation with the community in the case of network server software.",
    ),
    (
        "lgpl",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public "
        "License along with this library. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "apache",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
        "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "apache",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or "
        "Object form, provided that You meet the following conditions: You must give any other recipients of the Work or Derivative Works a copy of "
        "this License; and You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in "
        "the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form "
        "of the Work, excluding those notices that do not pertain to any part of the Derivative Works.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "mpl",
        "The Initial Developer hereby grants You a world-wide, royalty-free, non-exclusive license, subject to third party intellectual property "
        "claims, under intellectual property rights other than patent or trademark licensable by Initial Developer to use, reproduce, modify, "
        "display, perform, sublicense and distribute the Original Code",
    ),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software.",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. The person who associated "
        "a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law.",
    ),
)

#: Creative Commons licences: the parts of their names, their versions and the sentences that name them (fixed values).
CC_PARTS = {"cc-by": "", "cc-by-sa": "-ShareAlike", "cc-by-nc": "-NonCommercial", "cc-by-nd": "-NoDerivatives", "cc-by-nc-sa": "-NonCommercial-ShareAlike", "cc-by-nc-nd": "-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("4.0 International", "3.0 Unported", "2.0 Generic")
CC_SENTENCES = ("This work is licensed under a Creative Commons Attribution{} {} License.", "Creative Commons Attribution{} {}", "CC Attribution{} {}")
TEMPLATES += tuple((label, sentence.format(part, version)) for label, part in CC_PARTS.items() for version in CC_VERSIONS for sentence in CC_SENTENCES)
TEMPLATES += tuple((label, sentence.format(part.replace("NoDerivatives", "NoDerivs"), "3.0 Unported")) for label, part in CC_PARTS.items() if "NoDerivatives" in part for sentence in CC_SENTENCES)

#: Words that make another licence of the same sentence (fixed values): a chain can't skip one that its other side has not.
VARIANTS = "affero lesser library sharealike noncommercial noderivatives noderivs".split()

#: Words of the shortest match that is chained, words that may be skipped between two matches of
#: a chain (in file and template), and the share of a template that must be covered for its label;
#: for templates of at most SHORT words it is SHORT_COVERED.
MIN_MATCH, MAX_GAP, MIN_COVERED, SHORT, SHORT_COVERED = 4, 12, 0.5, 8, 0.75

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """All substrings of several word sequences; a state knows its length, its first end in each sequence and,
    if its substrings have `least` words or more, all its ends."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        reached = []
        for which, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(which, at)
                reached.append((last, which, at))
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state, which, at in reached:
            self.places[state].append((which, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for which, at in self.ends[state].items():
                up[which] = min(at, up.get(which, at))
            if self.length[self.link[state]] >= least:
                self.places[self.link[state]] += self.places[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length), self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest word sequence followed by `word`, cut off its longer ones if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def statistics(self, words: list[int]):
        """(state, length of the longest match that ends here) for each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        texts = [[w for w in words_of(t)] for _, t in templates]
        phrases = [words_of(p) for p, _ in PHRASES]
        numbered = dict.fromkeys(w for s in [*texts, *phrases] for w in s)
        self.labels = [label for label, _ in templates]
        self.number = {w: i for i, w in enumerate(numbered)}
        self.sizes = [len(t) for t in texts]
        self.needed = [SHORT_COVERED if n <= SHORT else MIN_COVERED for n in self.sizes]
        self.automaton = SuffixAutomaton([[self.number[w] for w in t] for t in texts], MIN_MATCH)
        self.phrases = [([self.number[w] for w in p], label) for p, (_, label) in zip(phrases, PHRASES, strict=True)]
        self.variants = np.array(sorted(self.number[w] for w in map(str.encode, VARIANTS) if w in self.number), np.int64)
        self.varied = [[(i, self.number[w]) for i, w in enumerate(t) if w.decode() in VARIANTS] for t in texts]

    def matches(self, words: list[int], at: int):
        """Maximal matches of at least MIN_MATCH words at all their places: (file start, template, template start, length)."""
        before = (0, 0)
        for i, now in enumerate([*self.automaton.statistics(words), (0, 0)]):
            state, length = before
            if length >= MIN_MATCH and now[1] != length + 1:  # it goes no further
                for which, end in self.automaton.places[state]:
                    yield at + i - length, which, end - length + 1, length
            before = now

    def chains(self, found: list[tuple[int, int, int, int]], varied: list[tuple[int, int]] = ()) -> list[tuple[int, int, int, int, list]]:
        """Disjoint chains of each template, best first: (template, first word, last word, words covered,
        their places in the template). `varied` are the words of the file that make another licence, with their places."""
        by_template: dict[int, list] = {}
        for start, which, place, length in found:
            by_template.setdefault(which, []).append((start, place, length))

        def skipped(words: list[tuple[int, int]], begin: int, end: int) -> set[int]:
            return {w for _, w in words[bisect(words, (begin, -1)) : bisect(words, (end, -1))]} if words else set()

        out = []
        for which, parts in by_template.items():
            parts.sort()
            own_varied = self.varied[which]
            best: list[tuple[int, int]] = []  # words covered by the best chain that ends here, the match before
            for i, (start, place, length) in enumerate(parts):
                covered, previous = length, -1
                for j in range(i - 1, -1, -1):
                    s, p, n = parts[j]
                    if start - s - n > MAX_GAP:
                        if start - s > self.sizes[which] + MAX_GAP:  # no match is longer than its template
                            break
                        continue
                    overlap = max(0, s + n - start, p + n - place)
                    if s < start and p < place and place - p - n <= MAX_GAP and best[j][0] + length - overlap > covered:
                        if (varied or own_varied) and skipped(varied, s + n, start) != skipped(own_varied, p + n, place):
                            continue
                        covered, previous = best[j][0] + length - overlap, j
                best.append((covered, previous))
            taken: list[tuple[int, int]] = []  # file words of the chains so far, in order

            def free(first: int, last: int) -> bool:
                k = bisect(taken, (last + 1,))
                return k == 0 or taken[k - 1][1] < first

            for k in sorted(range(len(parts)), key=lambda i: (-best[i][0], i)):
                start, place, length = parts[k]
                last = start + length - 1
                if not free(start, last):
                    continue
                covered, j, places = length, best[k][1], [(place, place + length)]
                while j >= 0 and free(parts[j][0], last):  # back to where another chain has the words
                    s, p, n = parts[j]
                    covered += n - max(0, s + n - start, p + n - place)
                    start, place, j = s, p, best[j][1]
                    places.append((p, p + n))
                insort(taken, (start, last))
                out.append((which, start, last, covered, places))
        return out

    def spans(self, chains: list[tuple[int, int, int, int, list]]) -> tuple[list[dict], float]:
        """The spans of the templates that a file holds, and the best share covered of any.

        Templates take their words in the order of how many they cover: a chain of which more than half
        lies in spans that a better one took is no evidence (so a notice of one licence is none of another
        that differs from it in a word). A template whose remaining chains together cover enough is found;
        its chains that cover enough are spans or, if none does alone, all of them.
        """

        def union(own) -> float:
            covered = end = 0
            for a, b in sorted(x for c in own for x in c[4]):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            return covered

        by_template: dict[int, list] = {}
        for c in chains:
            by_template.setdefault(c[0], []).append(c)
        shares = {w: union(own) / self.sizes[w] for w, own in by_template.items()}
        taken: list[tuple[int, int]] = []
        out, score = [], max(shares.values(), default=0.0)
        for w in sorted(by_template, key=lambda w: (-sum(c[3] for c in by_template[w]), -shares[w], w)):
            if shares[w] < self.needed[w]:
                continue
            own = []
            for c in by_template[w]:
                k, lost = bisect(taken, (c[1], c[1])), 0
                for a, b in taken[max(0, k - 1) :]:
                    if a > c[2]:
                        break
                    lost += max(0, min(b, c[2]) - max(a, c[1]) + 1)
                if 2 * lost <= c[2] - c[1] + 1:
                    own.append(c)
            if not own or union(own) < self.needed[w] * self.sizes[w]:
                continue
            alone = [c for c in own if c[3] >= self.needed[w] * self.sizes[w]]
            for _, first, last, covered, _ in sorted(alone or own, key=lambda c: (-c[3], c[1])):
                out.append({"label": self.labels[w], "first": first, "last": last, "covered": min(1.0, covered / self.sizes[w])})
                while taken and (k := bisect(taken, (last + 1,))) and taken[k - 1][1] >= first:  # joined, so that they stay disjoint
                    a, b = taken.pop(k - 1)
                    first, last = min(a, first), max(b, last)
                insort(taken, (first, last))
        return sorted(out, key=lambda x: (-x["covered"], x["first"], x["label"])), score

    def scan(self, texts: list[str | None]) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each text."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(counts + 1) - counts - 1  # one gap between texts
        ids = np.full(int(counts.sum()) + len(words) + 8, -1, np.int64)
        for at, w in zip(starts.tolist(), words, strict=True):
            ids[at : at + len(w)] = np.fromiter(map(self.number.get, w, repeat(-1)), np.int64, len(w))
        size = len(ids) - 8
        base: dict[int, list] = {}
        for phrase, label in self.phrases:
            hit = np.logical_and.reduce([ids[i : size + i] == w for i, w in enumerate(phrase)])
            at = np.flatnonzero(hit)
            doc = np.searchsorted(starts, at, "right") - 1
            for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                base.setdefault(d, []).append((p - int(starts[d]), label))
        edge = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= MIN_MATCH
        found: dict[int, list] = {}
        docs = np.searchsorted(starts, begin[long], "right") - 1
        for d, a, b in zip(docs.tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
            found.setdefault(d, []).extend(self.matches(ids[a:b].tolist(), a - int(starts[d])))
        other = np.flatnonzero(np.isin(ids[:size], self.variants)) if found else np.empty(0, np.int64)
        varied: dict[int, list] = {}
        for d, p in zip((np.searchsorted(starts, other, "right") - 1).tolist(), other.tolist(), strict=True):
            varied.setdefault(d, []).append((p - int(starts[d]), int(ids[p])))
        out = []
        for d, n in enumerate(counts.tolist()):
            places = base.get(d, [])
            spans, score = self.spans(self.chains(found[d], varied.get(d, []))) if d in found else ([], 0.0)
            labels = {label for _, label in places}
            every = labels | {s["label"] for s in spans}
            at = [p for p, _ in places]
            out.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), min(1.0, score), spans))
        return out


_scanner: list[Scanner] = []

_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_chars: int = 8_000_000) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > batch_chars:
                    columns = list(zip(*_scanner[0].scan(texts[begin:i]), strict=True)) or [[]] * len(types)
                    arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i - begin), *arrays], names=[key, *names])
                    begin, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    spans = "array<struct<label: string, first: long, last: long, covered: double>>"
    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op9_licence_scan(spark, sf_dir):
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")

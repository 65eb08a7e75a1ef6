"""License scans: matching statistics in a generalised suffix automaton of licence
texts, and chains of long matches.

The automaton holds every run of words of every template; each template is read
from the root, so no run spans two. Streaming a text through it gives, at each
word, the state of the longest run ending there that some template has. Where it
has at least SEED words, the state's suffix link of SEED words says at which places
of which templates the last SEED words end, and seeds that follow one another in
text and template make a template's own longest runs (a template may stand within
another). Runs that follow one another in the same template, in text and template
alike, are chained into the spans that cover most of it; a template whose words are
covered by COVER is labelled.

Labels: the base phrases' labels always, and a template's label if a span covers
it. The score is the largest covered share of a template, and 1 where a base
phrase stands.

Edge cases: a null or empty text has no words, no places, no labels and score 0;
repeated rows give the same result each; other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, small_batches, table, text_bytes

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Least words of a run that takes part in a chain, share of a template's words that labels it, and words that a chain may leave out between runs.
SEED, COVER, GAP = 3, 0.75, 40

#: Fixed texts of public licences and notices, with the labels they give; a notice stands beside its licence, as files often hold it alone.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl", "GNU Lesser General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]

_GAPS = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_GAPS).split()


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: The places (sequence, word) where a state's runs end, but for those that its links lead down from.
        self.own: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, w)
                self.own[last].append((k, i))

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def ends(self, size: int) -> list[list[tuple[int, int]] | None]:
        """For each state of at least `size` words, where its last `size` words end."""
        anchor: list[int | None] = [None] * len(self.next)
        places: dict[int, list[tuple[int, int]]] = {}
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= size:
                anchor[v] = v if self.length[self.link[v]] < size else anchor[self.link[v]]
                places.setdefault(anchor[v], []).extend(self.own[v])
        return [None if a is None else places[a] for a in anchor]

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(length of the longest known run ending here, its state) at each word."""
        state = size = 0
        moves, link, length = self.next, self.link, self.length
        for w in ids:
            while state and w not in moves[state]:
                state = link[state]
                size = length[state]
            if (to := moves[state].get(w)) is not None:
                state, size = to, size + 1
            else:
                size = 0
            yield size, state


class Scanner:
    """Templates and phrases made ready; one for each task."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], seed: int, cover: float):
        self.seed, self.cover = seed, cover
        runs = [words(t.encode()) for _, t in templates]
        self.labels = [x for x, _ in templates]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in r] for r in runs]
        self.sizes = [len(r) for r in runs]
        self.automaton = Automaton(coded)
        self.ends = self.automaton.ends(seed)
        self.phrases = [(p.split(), label) for p, label in ((p.encode(), x) for p, x in phrases.items())]

    def base(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, words) of every place of a phrase, and the labels."""
        at, labels = [], set()
        have = set(found) if any(p[0] in found for p, _ in self.phrases) else ()
        for phrase, label in self.phrases:
            if not all(w in have for w in phrase):
                continue
            i = -1
            while True:
                try:
                    i = found.index(phrase[0], i + 1)
                except ValueError:
                    break
                if found[i : i + len(phrase)] == phrase:
                    at.append((i, len(phrase)))
                    labels.add(label)
        return at, labels

    def spans(self, found: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of chains."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in found]
        # Each template's own longest runs, in order of the text: a seed continues the run one place before it in both, or begins one.
        runs: dict[int, list[list[int]]] = {}
        live: dict[tuple[int, int], list[int]] = {}
        n, i = len(ids), 0
        while i < n:  # stretches of known words; shorter ones have no long run
            if ids[i] < 0:
                i += 1
                continue
            j = i
            while j < n and ids[j] >= 0:
                j += 1
            if j - i >= self.seed:
                for at, (size, state) in enumerate(self.automaton.statistics(ids[i:j]), i):
                    if size < self.seed:
                        continue
                    for k, end in self.ends[state]:
                        run = live.get((k, end - at))
                        if run and run[0] + run[2] == at:
                            run[2] += 1
                        else:
                            live[k, end - at] = run = [at - self.seed + 1, end - self.seed + 1, self.seed]
                            runs.setdefault(k, []).append(run)
            i = j
        return [(self.labels[k], first, last, covered / self.sizes[k]) for k, own in runs.items() for first, last, covered in chains(own, self.cover * self.sizes[k])]


def chains(runs: list[list[int]], least: float) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of the chains that cover most, at least
    `least` words each, of a template's runs (start, place, words), which come in order
    of their starts; chains do not overlap in the text."""
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends with the run, and its first word
    reach = GAP + max(size for _, _, size in runs)
    for j, (start, place, size) in enumerate(runs):
        before = (0, start)
        for i in range(j - 1, -1, -1):
            s, p, z = runs[i]
            if start - s > reach:
                break
            if 0 <= start - s - z <= GAP and p + z <= place and best[i][0] > before[0]:
                before = best[i]
        best.append((before[0] + size, before[1]))
    out: list[tuple[int, int, int]] = []  # in order of the text
    for covered, first, last in sorted(((c, f, s + z - 1) for (c, f), (s, _, z) in zip(best, runs, strict=True) if c >= least), key=lambda x: (-x[0], *x[1:])):
        i = bisect.bisect(out, (first,))
        if (i == 0 or out[i - 1][1] < first) and (i == len(out) or last < out[i][0]):
            out.insert(i, (first, last, covered))
    return out


def scan(docs: DataFrame, templates=None, phrases=None, seed: int = SEED, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, first_word, last_word, covered) for each row of docs."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    small_batches(docs.sparkSession)
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, seed, cover)
        for b in batches:
            out = []
            for text in b.column("text"):
                found = words(text.as_py())
                base, labels = scanner.base(found)
                spans = scanner.spans(found)
                every = labels | {s[0] for s in spans}
                score = 1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0))
                out.append((len(found), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, [dict(zip(("label", "first_word", "last_word", "covered"), s, strict=True)) for s in spans]))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield batch_of(doc_id=b.column("doc_id"), **{c: pa.array(x, kinds[c]) for c, x in zip(kinds, columns, strict=True)})

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, covered double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")

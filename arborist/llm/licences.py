"""Licence scans with a generalised suffix automaton of licence tokens.

A text's words are streamed through the automaton of all templates; every maximal match of SEED words or more is a
piece of a template, and pieces in the same order in text and template are chained. A template whose words are
covered to its threshold gives its label and a span. Base phrases are looked up on their own and keep their labels.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.automaton import SuffixAutomaton
from arborist.llm.common import alnum_words, arrow_rows, binary

#: Words of the shortest match that counts, words that may lie between chained matches, share of a template to be covered.
SEED, GAP, COVERED = 4, 40, 0.6

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licences and their labels.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "gpl-2": "licensed under the GNU General Public License, version 2",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at""",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form",
}

# Further passages of the same licences, and other licences; what is before a colon is the label.
PARTS = {
    "mit:conditions": """The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd:endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "bsd:warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc:warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2:warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""",
    "apache-2:title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl:warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    "gpl:preamble": """The GNU General Public License is a free, copyleft license for software and other kinds of works. The
        licenses for most software and other practical works are designed to take away your freedom to share and change the
        works.""",
    "lgpl:warranty": """This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
    "agpl": """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "unlicense:terms": """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software""",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
}


class Scanner:
    """Automaton of all templates, and the phrases as bytes between spaces."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> None:
        templates = TEMPLATES | PARTS if templates is None else templates
        phrases = PHRASES if phrases is None else phrases
        self.labels = [name.partition(":")[0] for name in templates]
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        items = [[known.setdefault(w, len(known)) for w in alnum_words(t.encode())] for t in templates.values()]
        self.sizes = [len(x) for x in items]
        self.automaton = a = SuffixAutomaton(items)
        self.places: list[list[tuple[int, int]]] = [list(x) for x in a.ends]
        for v in a.states_by_length():
            if a.length[a.link[v]] >= SEED:
                self.places[a.link[v]].extend(self.places[v])
        self.phrases = [(b" " + b" ".join(alnum_words(p.encode())) + b" ", label) for p, label in phrases.items()]

    def base(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of every place of a base phrase."""
        joined = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.phrases:
            n, at = phrase.count(b" ") - 1, joined.find(phrase)
            while at >= 0:
                start = joined.count(b" ", 0, at)
                found.append((start, start + n, label))
                at = joined.find(phrase, at + 1)
        return sorted(found)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, start in text, start in template, length) of maximal matches."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).view(np.int8), 0])).reshape(-1, 2)
        found = []
        for start, stop in edges[edges[:, 1] - edges[:, 0] >= SEED].tolist():
            run = list(self.automaton.statistics(ids[start:stop].tolist()))
            for k, (v, n) in enumerate(run):
                if n >= SEED and (k + 1 == len(run) or run[k + 1][1] <= n):
                    at = start + k + 1
                    # positions of the state's longest run are those of the match itself: both end there
                    while self.automaton.length[self.automaton.link[v]] >= n:
                        v = self.automaton.link[v]
                    found += [(item, at - n, end + 1 - n, n) for item, end in self.places[v]]
        return found

    def chains(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, words covered) of the best chain from every match that begins one.

        A match goes on from an earlier one that ends at most GAP words before it, if its place in the template lies
        further on; words that both cover count once. It takes the one that covers most.
        """
        by: dict[int, set[tuple[int, int, int]]] = {}
        for item, at, place, n in self.matches(words):
            by.setdefault(item, set()).add((at, place, n))
        found = []
        for item, pieces in by.items():
            open_: list[tuple[int, int, int, int]] = []  # text end, template end, covered, text start
            best: dict[int, tuple[int, int]] = {}  # by text start: covered, text end
            for at, place, n in sorted(pieces):
                open_ = [x for x in open_ if at - x[0] <= GAP]
                mine = (at + n, place + n, n, at)
                for end, upto, covered, first in open_:
                    skip = max(0, end - at, upto - place)
                    if skip < n and covered + n - skip > mine[2]:
                        mine = (at + n, place + n, covered + n - skip, first)
                open_.append(mine)
                if mine[2] > best.get(mine[3], (0, 0))[0]:
                    best[mine[3]] = (mine[2], mine[0])
            found += [(item, start, end, covered) for start, (covered, end) in best.items()]
        return found

    def spans(self, words: list[bytes], covered: float = 0.0) -> list[tuple[int, int, str, float]]:
        """(start, end, label, share of the template covered) of chains of at least a share; those of one label do not overlap.

        Where they would, the one with the larger share stays, then the one with more words, then the earlier one. A span
        that lies in one of another label with more covered words goes.
        """
        ranked = sorted((-n / self.sizes[k], -n, start, end, k) for k, start, end, n in self.chains(words) if n >= covered * self.sizes[k])
        taken: dict[str, list[tuple[int, int]]] = {}  # by label: sorted, apart
        found = []
        for share, _, start, end, k in ranked:
            label = self.labels[k]
            others = taken.setdefault(label, [])
            at = bisect_left(others, (start, end))
            if (at and others[at - 1][1] > start) or (at < len(others) and others[at][0] < end):
                continue
            others.insert(at, (start, end))
            found.append((start, -end, label, -share, round(-share * self.sizes[k])))
        # a span inside one that covers more words of another template is a part of that licence's wording
        out, open_ = [], []
        for mine in sorted(found):
            open_ = [x for x in open_ if -x[1] > mine[0]] + [mine]
            if not any(x[1] <= mine[1] and x[4] > mine[4] for x in open_):
                out.append((mine[0], -mine[1], *mine[2:4]))
        return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", scanner: Scanner | None = None, covered: float = COVERED) -> DataFrame:
    """`keep` columns, n_words, base and spans (arrays of start, end, label, score) of every row.

    spans holds every template chain covered to the threshold or more; score in base is 1. Null texts have no words;
    repeated rows are scanned each; the templates are fixed, so nothing grows with the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        named = lambda rows: [dict(zip(("start", "end", "label", "score"), r, strict=True)) for r in rows]
        for batch in arrow_rows(batches):
            k = batch.num_columns - 1
            counts, base, spans = [], [], []
            for text in batch.column(k).to_pylist():
                words = alnum_words(text)
                counts.append(len(words))
                base.append(named([(*x, 1.0) for x in scanner.base(words)]))
                spans.append(named(scanner.spans(words, covered)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(counts, pa.int64()), pa.array(base, kind), pa.array(spans, kind)],
                names=[*batch.schema.names[:k], "n_words", "base", "spans"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    spans = "array<struct<start:bigint,end:bigint,label:string,score:double>>"
    return docs.select(*keep, binary(text_col).alias("__text")).mapInArrow(run, f"{kinds}n_words bigint, base {spans}, spans {spans}")

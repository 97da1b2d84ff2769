"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template; each state knows which templates its
runs stand in. A text streams through it and yields matching statistics: for each word the
longest run ending there that some template holds. Runs that can't be extended and have at least
``MIN_RUN`` words are chained per template: matches in text order at most ``GAP`` words apart, whether
the templates know these words or not, become one span, whose score is the share of the template's words
that it covers, each counted once. A span that covers ``MIN_COVER`` of its template gives the template's label if it covers one of its
distinctive words, which no template of another label has, or else the whole template; and it gives way to a span of
another label that overlaps it and covers more words. The base phrases are templates of their own, found exactly.

Only stretches of licence words that hold a ``MIN_RUN``-word run of a template can hold such a match,
so the automaton streams over these; elsewhere the statistics stay below ``MIN_RUN``. Chains run
over all such stretches of a text by their places in it.

Cases: null, empty and word-free texts have no words, labels '' and score 0; repeated rows are
scanned one by one; ties between templates give all their labels.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import chain, groupby

import numpy as np
from pyspark.sql import DataFrame

from folioscan.llm.common import map_texts
from folioscan.llm.decontaminate import _keys, tokens

MIN_RUN = 3
MIN_COVER = 0.6
GAP = 6

#: The phrases of the base rule with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Published notices and clauses that identify a licence.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("lgpl", "This library is free software; you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]


class Automaton:
    """Generalised suffix automaton over sequences of word ids."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.mask = [0]
        for number, sequence in enumerate(sequences):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            state = 0
            for word in sequence:
                state = self.next[state][word]
                up = state
                while up > 0 and not self.mask[up] >> number & 1:
                    self.mask[up] |= 1 << number
                    up = self.link[up]

    def _state(self, length: int, link: int, edges: dict[int, int], mask: int = 0) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.mask.append(mask)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A state for the runs of ``target`` no longer than ``at`` and one word."""
        clone = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]), self.mask[target])
        self.link[target] = clone
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def matches(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, templates' mask) of every match that the next word doesn't extend."""
        found, state, length = [], 0, 0
        for i, word in enumerate(ids):
            before = (state, length)
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state = length = 0
            if before[1] and length <= before[1]:
                found.append((i, before[1], self.mask[before[0]]))
        if length:
            found.append((len(ids), length, self.mask[state]))
        return found


class Covered:
    """Spans as the disjoint stretches that they cover together, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.stops: list[int] = []

    def meets(self, begin: int, stop: int) -> bool:
        at = bisect_left(self.begins, stop)
        return at > 0 and self.stops[at - 1] > begin

    def add(self, begin: int, stop: int) -> None:
        lo, hi = bisect_left(self.stops, begin), bisect_right(self.begins, stop)
        if lo < hi:
            begin, stop = min(begin, self.begins[lo]), max(stop, self.stops[hi - 1])
        self.begins[lo:hi], self.stops[lo:hi] = [begin], [stop]


class Scanner:
    """Templates as word ids, their automaton, and the scan of a batch of texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        ids = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text.encode())]
        self.phrases = [(np.array(ids(text)), label) for text, label in phrases]
        self.labels = [label for label, _ in templates]
        self.sequences = [ids(text) for _, text in templates]
        self.automaton = Automaton(self.sequences)
        self.places: list[dict[tuple[int, ...], list[int]]] = []
        for s in self.sequences:
            self.places.append({})
            for k in range(len(s) - MIN_RUN + 1):
                self.places[-1].setdefault(tuple(s[k : k + MIN_RUN]), []).append(k)
        # Places of each template's words that no template of another label has.
        holders: dict[int, set[str]] = {}
        for label, sequence in zip(self.labels, self.sequences):
            for w in sequence:
                holders.setdefault(w, set()).add(label)
        self.telling = [{k for k, w in enumerate(x) if len(holders[w]) == 1} for x in self.sequences]
        self.seeds = np.unique(np.concatenate([_keys(np.array(s), MIN_RUN) for s in self.sequences]))

    def spans(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, set[int]]]:
        """(template, begin, stop, covered places) of the chains over a text's stretches, given with their places."""
        chains: dict[int, list] = {}
        done: list[tuple[int, int, int, set[int]]] = []
        for offset, ids in stretches:
            for end, length, mask in self.automaton.matches(ids):
                if length < MIN_RUN:
                    continue
                run, begin = ids[end - length : end], offset + end - length
                for t, sequence in enumerate(self.sequences):
                    if mask >> t & 1:
                        own = chains.get(t)
                        if own is None or begin - own[1] > GAP:
                            if own is not None:
                                done.append((t, *own))
                            own = chains[t] = [begin, begin, set()]
                        # Words of the text that an earlier match holds count there; a run that the template
                        # repeats goes where it covers most.
                        new = max(0, own[1] - begin)
                        at = [k for k in self.places[t][tuple(run[:MIN_RUN])] if sequence[k : k + length] == run]
                        own[2] |= max((set(range(k + new, k + length)) for k in at), key=lambda x: len(x - own[2]))
                        own[1] = max(own[1], begin + length)
        return done + [(t, *own) for t, own in chains.items()]

    def tells(self, span: tuple[int, int, int, set[int]]) -> bool:
        """Whether a chain may give its label: it holds a word that only this label's templates have, or all of its template."""
        return bool(span[3] & self.telling[span[0]]) or len(span[3]) == len(self.sequences[span[0]])

    def named(self, found: list[tuple[int, int, int, set[int]]]) -> list[tuple[str, int, int]]:
        """(label, begin, stop) of the chains that give their label; one that overlaps a larger chain of another label gives way."""
        good = [x for x in found if self.tells(x) and len(x[3]) >= MIN_COVER * len(self.sequences[x[0]])]
        # From the largest down; ``larger`` has the words that kept chains of a label cover which are larger than those at hand.
        kept: list[tuple[str, int, int]] = []
        larger: dict[str, Covered] = {}
        for _, same in groupby(sorted(good, key=lambda x: (-len(x[3]), x[1], x[0])), key=lambda x: len(x[3])):
            stays = [(self.labels[t], b, e) for t, b, e, _ in same if not any(v.meets(b, e) for k, v in larger.items() if k != self.labels[t])]
            for label, begin, stop in stays:
                larger.setdefault(label, Covered()).add(begin, stop)
            kept += stays
        return sorted(set(kept), key=lambda x: (x[1], x[2], x[0]))

    def scan(self, texts: list[bytes]) -> dict[str, list]:
        get = self.vocabulary.get
        lists = [[get(w, 0) for w in tokens(t)] for t in texts]
        n = len(texts)
        lengths = np.fromiter(map(len, lists), np.int64, n)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        ids = np.fromiter(chain.from_iterable((*x, 0) for x in lists), np.int64, int(starts[-1]))
        base: list[set[str]] = [set() for _ in texts]
        count = np.zeros(n, np.int64)
        first = np.full(n, np.iinfo(np.int64).max)
        last = np.full(n, -1)
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids == phrase[0])
            for j, word in enumerate(phrase[1:].tolist(), 1):
                at = at[at + j < len(ids)]
                at = at[ids[at + j] == word]
            owner = np.searchsorted(starts, at, side="right") - 1
            np.add.at(count, owner, 1)
            np.minimum.at(first, owner, at - starts[owner])
            np.maximum.at(last, owner, at - starts[owner])
            for d in np.unique(owner).tolist():
                base[d].add(label)
        labels = [set(x) for x in base]
        spans: list[list[str]] = [[] for _ in texts]
        score = [1.0 if x else 0.0 for x in base]
        keys = _keys(ids, MIN_RUN)
        hits = np.flatnonzero(keys)
        slot = np.minimum(np.searchsorted(self.seeds, keys[hits]), len(self.seeds) - 1)
        hits = hits[self.seeds[slot] == keys[hits]]
        breaks = np.flatnonzero(ids == 0)
        stretches: dict[int, list[tuple[int, list[int]]]] = {}
        for end in np.unique(np.searchsorted(breaks, hits)).tolist():
            lo, hi = (int(breaks[end - 1]) + 1 if end else 0), int(breaks[end])
            d = int(np.searchsorted(starts, lo, side="right") - 1)
            stretches.setdefault(d, []).append((lo, ids[lo:hi].tolist()))
        for d, of in stretches.items():
            found = self.spans(of)
            score[d] = max([score[d], *(len(x[3]) / len(self.sequences[x[0]]) for x in found if self.tells(x))])
            for label, begin, stop in self.named(found):
                labels[d].add(label)
                spans[d].append(f"{label}:{begin - starts[d]}:{stop - starts[d]}")
        some = count > 0
        return {
            "n_words": lengths,
            "n_base": count,
            "first_word": [int(f) if s else None for f, s in zip(first, some)],
            "last_word": [int(x) if s else None for x, s in zip(last, some)],
            "base_labels": [",".join(sorted(x)) for x in base],
            "labels": [",".join(sorted(x)) for x in labels],
            "score": score,
            "spans": [",".join(x) for x in spans],
        }


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates=None, phrases=None) -> DataFrame:
    """``keep`` columns with n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label:start:end of the chained spans that gave labels, in words from 0, ends exclusive.
    """
    scanner = Scanner(templates or TEMPLATES, phrases or PHRASES)
    return map_texts(
        docs, list(keep), lambda: lambda texts, _: scanner.scan(texts),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )

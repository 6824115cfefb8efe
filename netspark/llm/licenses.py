"""License notices in documents by patience alignment.

Places where a template's words lie close together are candidates. There the words that occur once in both the
candidate and the template are anchors; the longest run of anchors in rising order is kept, and the gaps
between them are aligned in the same way. The share of the template's words that find a partner is its
coverage. The words that tell it from its siblings must be among them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netspark.llm.workers import prepared

#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: Share of a template's words that a window of its length and half as much must hold to be aligned.
CANDIDATE = 0.6

# Notices by which works are put under common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at"
    ),
}

# Words that tell a license from its siblings, also from those without a template; each group stands together.
IDENTITY = {
    "Apache-2.0": ("apache", "2.0"),
    "Apache-2.0 header": ("apache", "2.0"),
    "MIT": ("mit",),
    "CC-BY-4.0": ("cc by", "4.0"),
    "CC-BY-NC-4.0": ("cc by-nc", "4.0"),
    "CC-BY-SA-4.0": ("cc by-sa", "4.0"),
    "GPL-3.0": ("gnu general public", "3"),
    "GPL header": ("gnu general public", "3"),
    "MPL-2.0": ("mozilla public", "2.0"),
}

FIELDS = "license string, coverage double, first_word long, n_words long"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """Words between white space, lower-case, without punctuation around them; a bare sign stays empty."""
    return [_EDGES.sub("", w).lower() for w in text.split()]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both, by patience: anchors first, then the gaps between."""
    found: list[tuple[int, int]] = []
    waiting = [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        # Equal words at the edges of a gap need no anchor.
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1 and there.get(w) == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if w in where]
        anchors = rising(anchors)
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        waiting += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(found)


def rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose first places rise: patience sorting with links to the pile before."""
    tops: list[int] = []
    piles: list[int] = []
    before = []
    for k, (place, _) in enumerate(anchors):
        pile = bisect_left(tops, place)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            piles.append(k)
        else:
            tops[pile], piles[pile] = place, k
    chain = []
    k = piles[-1] if piles else -1
    while k >= 0:
        chain.append(anchors[k])
        k = before[k]
    return chain[::-1]


def apart(results: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Those that overlap none of the kept ones before them."""
    kept: list[tuple[str, float, int, int]] = []
    for r in results:
        if all(r[2] + r[3] <= o[2] or o[2] + o[3] <= r[2] for o in kept):
            kept.append(r)
    return kept


class Scanner:
    """Finds the templates in texts; knows the words of all of them."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.names = list(templates)
        self.templates = list(templates.values())
        self.words = [words_of(t) for t in templates.values()]
        self.required = [self._required(k) for k in range(len(self.names))]
        vocabulary = sorted({w for own in self.words for w in own if w})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.has = np.zeros((len(self.names), len(vocabulary)), bool)
        for k, own in enumerate(self.words):
            self.has[k, [self.number[w] for w in own if w]] = True
        self.seen: dict[str, int] = {}

    def _required(self, k: int) -> list[list[int]]:
        """Places of the template's words that must be aligned; those of a group with neighbours in the text.

        They are its words of IDENTITY, and those that another template lacks which would else pass for it.
        """
        own = self.words[k]
        groups = []
        phrases = IDENTITY.get(self.names[k], ()) if TEMPLATES.get(self.names[k]) == self.templates[k] else ()
        for phrase in phrases:
            parts = phrase.split()
            at = next(i for i in range(len(own)) if own[i : i + len(parts)] == parts)
            groups.append(list(range(at, at + len(parts))))
        for sibling in self.words:
            shared = {j for _, j in align(sibling, own)}
            if len(shared) >= self.coverage * len(own):
                groups += [[j] for j in range(len(own)) if j not in shared]
        return groups

    def _number(self, token: str) -> int:
        number = self.seen.get(token)
        if number is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            number = self.seen[token] = self.number.get(_EDGES.sub("", token).lower(), -1)
        return number

    def found(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """License, coverage, first word and words of each notice, in order of place."""
        tokens = text.split() if text else []
        numbers = np.array([self._number(t) for t in tokens], np.int64)
        hits = np.flatnonzero(numbers >= 0)
        results: list[tuple[str, float, int, int]] = []
        for k, template in enumerate(self.words):
            own = hits[self.has[k, numbers[hits]]] if len(hits) else hits
            size = len(template)
            need = max(2, int(np.ceil(CANDIDATE * size)))
            if len(own) < need:
                continue
            width = size + size // 2
            held = np.searchsorted(own, own + width) - np.arange(len(own))
            own_results = {self._aligned(k, tokens, start, width) for start in own[held >= need].tolist()} - {None}
            # Of overlapping alignments of one template the best covered stands, of equal ones the tightest.
            results += apart(sorted(own_results, key=lambda r: (-r[1], r[3], r[2])))
        # Of notices that overlap the best covered stands, of equal ones the longer, then the earlier template.
        results.sort(key=lambda r: (-r[1], -r[3], r[2], self.names.index(r[0])))
        return sorted(apart(results), key=lambda r: r[2])

    def _aligned(self, k: int, tokens: list[str], start: int, width: int) -> tuple[str, float, int, int] | None:
        template = self.words[k]
        window = [_EDGES.sub("", t).lower() for t in tokens[start : start + width]]
        pairs = align(window, template)
        share = len(pairs) / len(template)
        if share < self.coverage:
            return None
        place = {j: i for i, j in pairs}
        for group in self.required[k]:
            if any(j not in place or place[j] - j != place[group[0]] - group[0] for j in group):
                return None
        first, last = pairs[0][0], pairs[-1][0]
        return self.names[k], share, start + first, last - first + 1


def license_notices(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """A row per notice: the columns of ``docs`` but ``text``, then license, coverage, first_word, n_words.

    A notice that lacks the words which tell a license from its siblings is none of it: "the BSD License" is not
    MIT, "CC BY-ND 4.0" not CC-BY-4.0. Words lie between white space and are counted from 0. A template that occurs twice gives two rows; where
    templates overlap, the one with the highest coverage stands. A row without a notice, with a null or an
    empty text gives no row; repeated rows give theirs each. Columns named like the result's are replaced.
    Templates travel with the tasks: a short list, whatever the corpus.
    """
    prepared(docs.sparkSession)
    added = [f.split()[0] for f in FIELDS.split(", ")]
    kept = [c for c in docs.columns if c != "text" and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text")):
                own = scanner.found(text.as_py())
                rows += [k] * len(own)
                found += own
            if rows:
                left = batch.select(kept).take(pa.array(rows))
                types = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*left.columns, *new], names=[*kept, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join(x for x in (fields, FIELDS) if x))

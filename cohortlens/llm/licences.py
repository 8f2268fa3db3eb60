"""License scans by matching statistics against a generalised suffix automaton.

The automaton holds the words of all templates. A file is streamed through it once; at
every word it knows the longest stretch of any template that ends there. Stretches that
cannot be extended are matches; long ones, in order and at rising template places, are
chained into spans that cover a template. Base phrases are short templates: a phrase
ends where its state lies on the suffix path of the current state."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening notices of public licences.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of anything but ASCII other than digits and small letters, on lower-cased bytes.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(body: bytes) -> list[bytes]:
    return _WORD.findall(body.translate(_LOWER))


class SuffixAutomaton:
    """Generalised over word lists: states with their longest length, suffix link,
    transitions, and for each template the places where the state's strings end."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, seq in enumerate(lists):
            at = 0
            for place, w in enumerate(seq):
                at = self._extend(at, w, ends)
                ends[at].append((t, place))
        self.ends = ends
        for v in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]

    def _add(self, size: int, ends) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        ends.append([])
        return len(self.size) - 1

    def _extend(self, last: int, w: int, ends) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w, ends)
        cur, p = self._add(self.size[last] + 1, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w, ends)
        return cur

    def _clone(self, p: int, q: int, w: int, ends) -> int:
        c = self._add(self.size[p] + 1, ends)
        self.next[c], self.link[c], self.link[q] = dict(self.next[q]), self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """Matching statistics after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        if w in self.next[state]:
            return self.next[state][w], size + 1
        return 0, 0


class Scanner:
    """``least``: words of a match that counts; ``gap``: words a chain may skip in the
    file; ``cover``: covered share of a template that makes its label."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = 3, gap: int = 8, cover: float = 0.6):
        self.least, self.gap, self.cover = least, gap, cover
        texts = [words(t.encode()) for _, t in templates]
        self.phrases = [words(p.encode()) for p, _ in phrases]
        self.phrase_labels = [x for _, x in phrases]
        self.labels = [x for x, _ in templates]
        self.lengths = [len(t) for t in texts]
        vocabulary = sorted({w for t in [*texts, *self.phrases] for w in t})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        ids = [[self.number[w] for w in t] for t in texts]
        pids = [[self.number[w] for w in p] for p in self.phrases]
        self.automaton = a = SuffixAutomaton(ids + pids)
        self.shortest = min(map(len, pids), default=self.least)
        # Phrases that end with each state's longest string, and those that lie above it.
        self.ending: list[list[tuple[int, int]]] = [[] for _ in a.size]
        for k, p in enumerate(pids):
            s = n = 0
            for w in p:
                s, n = a.step(s, n, w)
            self.ending[s].append((k, len(p)))
        for v in sorted(range(1, len(a.size)), key=lambda s: a.size[s]):
            self.ending[v] = self.ending[v] + self.ending[a.link[v]]

    def scan(self, ids: list[int]):
        """Places (phrase, first word) of base phrases, and maximal matches of at least
        ``least`` words as (first word, length, state)."""
        a, found, matches = self.automaton, [], []
        state = size = 0
        for i, w in enumerate(ids):
            was = (state, size)
            if w < 0:
                state = size = 0
            else:
                state, size = a.step(state, size, w)
                for k, n in self.ending[state]:
                    if n <= size:
                        found.append((k, i - n + 1))
            if was[1] >= self.least and size <= was[1]:
                matches.append((i - was[1], was[1], was[0]))
        if size >= self.least:
            matches.append((len(ids) - size, size, state))
        return found, matches

    def spans(self, matches) -> list[dict]:
        """Chains of matches by template: file words first..last, covered share."""
        open_: dict[int, list] = {}
        closed = []
        for first, n, state in matches:
            for t, end in sorted(set(self.automaton.ends[state])):
                if t >= len(self.lengths):
                    continue
                start = end - n + 1
                chain = open_.get(t)
                # [first, last, template end, covered]
                if chain and first - chain[1] - 1 <= self.gap and end > chain[2]:
                    chain[3] += end - max(chain[2], start - 1)
                    chain[1], chain[2] = max(chain[1], first + n - 1), end
                elif not chain or first > chain[1]:
                    if chain:
                        closed.append((t, chain))
                    open_[t] = [first, first + n - 1, end, n]
        closed += open_.items()
        return [
            {"label": self.labels[t], "first": c[0], "last": c[1], "covered": min(1.0, c[3] / self.lengths[t])}
            for t, c in closed
            if c[3] >= self.cover * self.lengths[t]
        ]

    def document(self, body: bytes) -> dict:
        w = words(body)
        number = self.number
        ids = [number.get(x, -1) for x in w]
        base, spans = [], []
        # Only stretches of known words can match; the others need no steps.
        lo, n = 0, len(ids)
        while lo < n:
            if ids[lo] < 0:
                lo += 1
                continue
            hi = lo
            while hi < n and ids[hi] >= 0:
                hi += 1
            if hi - lo >= min(self.shortest, self.least):
                found, matches = self.scan(ids[lo:hi])
                base += [(k, lo + i) for k, i in found]
                spans += [(lo + i, m, s) for i, m, s in matches]
            lo = hi
        starts = [i for _, i in base]
        covered = self.spans(spans)
        own = {self.phrase_labels[k] for k, _ in base}
        return {
            "n_words": n, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(own), "labels": sorted(own | {s["label"] for s in covered}), "spans": covered,
            "score": 1.0 if base else max((s["covered"] for s in covered), default=0.0),
        }


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("spans", _SPAN), ("score", pa.float64())]
)
_DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "spans array<struct<label: string, first: long, last: long, covered: double>>, score double"
)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (smallest and largest start, or null),
    ``base_labels``, ``labels`` (with those of covered templates), ``spans`` and
    ``score`` (1 with a base phrase, else the largest covered share). ``options`` go to
    :class:`Scanner`.

    A null or empty text has no words and no labels. Rows are scanned one by one, whole,
    so repeated rows and null ids give rows alike; other columns are not read."""

    def run(batches):
        scanner = Scanner(**options)
        for b in batches:
            data, offsets = blobs(b.column("text"))
            body = memoryview(data)
            rows = [scanner.document(bytes(body[x:y])) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            cols = [pa.array([r[f.name] for r in rows], f.type) for f in list(_SCHEMA)[1:]]
            yield pa.record_batch([b.column("doc_id"), *cols], schema=_SCHEMA)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _DDL)

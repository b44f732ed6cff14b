"""License scans: a generalised suffix automaton over licence tokens gives matching statistics, long matches chain into covered template spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import register
from .ragged import alnum_words, hash_word, hash_words, texts, words

MIN_MATCH = 4   # tokens of a match that counts
GAP = 12        # tokens of the text between two matches of one span
COVER = 0.7     # share of a template that a span must hold to give its label

# fixed values: phrases that always give a label
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: licence notices, (label, text)
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
_ALNUM = alnum_words()


def tokens_of(text: str) -> list[int]:
    """Word hashes of a notice."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), _ALNUM)
    return hash_words(data, start, end).tolist()


class SuffixAutomaton:
    """All substrings of several token sequences. ``ends[state]`` maps a sequence to the ascending places where the state's strings end in it."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for s, tokens in enumerate(sequences):
            last = 0
            for k, c in enumerate(tokens):
                last = self._extend(last, c)
                self.ends[last].setdefault(s, set()).add(k)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            for s, places in self.ends[v].items():
                self.ends[self.link[v]].setdefault(s, set()).update(places)
        self.ends = [{s: sorted(p) for s, p in e.items()} for e in self.ends]

    def _copy(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of ``q`` that are at most one longer than those of ``p``."""
        clone = self._copy(q, self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # another sequence has this prefix already
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.ends.append({})
        new, p = len(self.next) - 1, last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """Matching statistics at every place: (place, length of the longest string of any sequence that ends there, its state)."""
        state, length = 0, 0
        for k, c in enumerate(tokens):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield k, length, state


class Scanner:
    """The automaton of the notices, and what finds the few places of a text worth streaming through it."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        sequences = [tokens_of(t) for _, t in templates]
        self.size = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.pairs = np.unique(np.array([self._pair(np.uint64(a), np.uint64(b)) for s in sequences for a, b in zip(s, s[1:])], np.uint64))
        self.phrases = [([np.uint64(hash_word(w)) for w in phrase.split()], label) for phrase, label in phrases.items()]

    @staticmethod
    def _pair(a, b):
        with np.errstate(over="ignore"):
            return a * np.uint64(0x9E3779B97F4A7C15) ^ b

    def base(self, h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Places (in ``h``) and label of every phrase; a phrase does not run over the end of a text."""
        out = []
        for phrase, label in self.phrases:
            n = len(h) - len(phrase) + 1
            hit = np.flatnonzero(h[:n] == phrase[0]) if n > 0 else np.zeros(0, np.int64)
            for k, w in enumerate(phrase[1:], 1):
                hit = hit[h[hit + k] == w]
            text = np.searchsorted(at, hit, "right")
            out.append((hit[hit + len(phrase) <= at[np.minimum(text, len(at) - 1)]], label))
        return out

    def candidates(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words in which all neighbours are neighbours in some notice: every match of MIN_MATCH tokens lies in one."""
        if len(h) < MIN_MATCH:
            return
        q = self._pair(h[:-1], h[1:])
        ok = self.pairs[np.minimum(np.searchsorted(self.pairs, q), len(self.pairs) - 1)] == q
        ok[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(h))] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 >= MIN_MATCH:
                yield a, b + 1

    def spans(self, h: np.ndarray, stretches: list[tuple[int, int]], offset: int) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, coverage) of every chain of matches of one text.

        A chain follows one notice: its matches come in the order of the notice, at most GAP words of the text apart.
        """
        open_: dict[int, list[int]] = {}  # notice -> first word, last word, last place in the notice, tokens covered
        out = []

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            out.append((self.labels[t], first - offset, last - offset, covered / self.size[t]))

        for a, b in stretches:
            found = list(self.automaton.matches(h[a:b].tolist()))
            for (k, n, state), after in zip(found, [*found[1:], (0, 0, 0)]):
                if n < MIN_MATCH or after[1] > n:
                    continue
                last, first = a + k, a + k - n + 1
                for t, places in self.automaton.ends[state].items():
                    chain = open_.get(t)
                    if chain and first - chain[1] > GAP + 1:
                        close(t)
                        chain = None
                    if chain:
                        place = next((p for p in places if p > chain[2]), None)
                        if place is not None:
                            chain[3] += min(n, place - chain[2], last - chain[1])
                            chain[1], chain[2] = last, place
                            continue
                        close(t)
                    open_[t] = [first, last, places[0], n]
        for t in list(open_):
            close(t)
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``id``, ``n_words``, ``phrases`` (label, place) and ``spans`` (label, first and last word, coverage of the notice) of every row.

    The whole text is read as words of letters and digits, A-Z lower-cased. Spans of less than COVER of a notice are listed as well; ``labels_of`` drops them.
    Null and empty texts have no words and no spans. Null and repeated ids stay. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for i, j, data, bounds in texts(batch.column(1)):
                start, end, at = words(data, bounds, _ALNUM)
                h = hash_words(data, start, end)
                base = [[] for _ in range(j - i)]
                for places, label in scanner.base(h, at):
                    for p, row in zip(places.tolist(), (np.searchsorted(at, places, "right") - 1).tolist()):
                        base[row].append({"label": label, "place": p - int(at[row])})
                stretches = [[] for _ in range(j - i)]
                for a, b in scanner.candidates(h, at):
                    stretches[int(np.searchsorted(at, a, "right")) - 1].append((a, b))
                spans = [[dict(zip(("label", "first", "last", "coverage"), s)) for s in scanner.spans(h, x, int(at[r]))] if x else [] for r, x in enumerate(stretches)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64())]))),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])))], names=["id", "n_words", "phrases", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, phrases array<struct<label:string,place:long>>, "
                                "spans array<struct<label:string,first:long,last:long,coverage:double>>")


def labels_of(scanned: DataFrame, cover: float = COVER) -> DataFrame:
    """Digest of a scan: counts, first and last phrase, labels of phrases and of spans that cover enough, and the best coverage (1 if a phrase stands)."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("phrases", lambda x: x["label"])
    spans = F.transform(F.filter("spans", lambda x: x["coverage"] >= cover), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: F.least(x["coverage"], F.lit(1.0)))), F.lit(0.0))
    return scanned.select("id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(F.transform("phrases", lambda x: x["place"])).alias("first_word"),
                          F.array_max(F.transform("phrases", lambda x: x["place"])).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, spans)).alias("labels"),
                          F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"))


@register("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).withColumnRenamed("id", "doc_id")

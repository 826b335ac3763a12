"""License scan: an exact containment join of text blocks with templates, by prefix, length and positional filters."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import record_batches
from .words import alnum_words

#: Places of these phrases give these labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Customary notices and the labels they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
#: Share of a template's distinct words that a block (a line, or a window of words as below) must have.
CONTAINMENT = 0.8
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.int64())])
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks long"


class Templates:
    """Template words in the order of their global frequency, the rarest first, with an index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], containment: float):
        words = {w for _, t in templates for w in alnum_words(t.encode())}
        self.order = {w: i for i, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets, self.prefix, self.windows = [], {}, []
        for k, (label, text) in enumerate(templates):
            mine = sorted({self.order[w] for w in alnum_words(text.encode())})
            need = math.ceil(containment * len(mine) - 1e-9)
            self.sets.append((label, mine, need))
            # a window has room for the template with as many other words as may be missing
            self.windows.append((frozenset(alnum_words(text.encode())), math.ceil(len(alnum_words(text.encode())) / containment)))
            for i in range(len(mine) - need + 1):
                self.prefix.setdefault(mine[i], []).append((k, i))
        back = {i: w for w, i in self.order.items()}
        self.prefix_words = frozenset(back[i] for i in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of each template that the block has enough of."""
        # words of no template can't be shared: they stand before all others and drop out of the merge
        block = sorted({self.order[w] for w in words if w in self.order})
        tried, out = set(), []
        for j, word in enumerate(block):
            for k, i in self.prefix.get(word, ()):
                if k in tried:
                    continue
                tried.add(k)
                label, mine, need = self.sets[k]
                if len(block) < need:  # length
                    continue
                if 1 + min(len(mine) - i - 1, len(block) - j - 1) < need:  # position: this is the first shared word
                    continue
                shared = len(set(mine).intersection(block))
                if shared >= need:
                    out.append((label, shared / len(mine)))
        return out

    def stretches(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, containment, first, stop) of each stretch of overlapping windows that have enough of a template; windows begin at every word."""
        present, out = set(words), []
        for (label, mine, need), (wanted, width) in zip(self.sets, self.windows):
            if len(wanted & present) < need:
                continue
            places = [k for k, w in enumerate(words) if w in wanted]
            counts, left, best, now = {}, 0, 0, None
            for at in places:
                counts[words[at]] = counts.get(words[at], 0) + 1
                while at - places[left] >= width:
                    gone = words[places[left]]
                    counts[gone] -= 1
                    if not counts[gone]:
                        del counts[gone]
                    left += 1
                if len(counts) >= need:
                    if now and places[left] < now[1]:
                        now, best = (now[0], at + 1), max(best, len(counts))
                    else:
                        if now:
                            out.append((label, best / len(mine), *now))
                        now, best = (places[left], at + 1), len(counts)
            if now:
                out.append((label, best / len(mine), *now))
        return out


def word_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How often each of these words stands in all texts; one row a word and task is shuffled."""
    shared = frozenset(words)

    def run(batches):
        from collections import Counter

        seen = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(filter(shared.__contains__, alnum_words(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    got = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()
    return {bytes(r[0]): r[1] for r in got}  # at most as many rows as the templates have words


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks for each row of docs.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; null is empty. Blocks
    are lines, and windows of words about as long as a template, so that notices wrapped over lines are found. score is
    the largest containment of a template in a block if it reaches the threshold, else 0; blocks counts the lines with a
    match and the stretches of overlapping windows that touch no such line. No label is an empty string. Repeated rows
    give repeated results.
    """
    counts = word_counts(docs, {w for _, t in templates for w in alnum_words(t.encode())})
    index = Templates(templates, counts, containment)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]

    def one(text: bytes):
        words = alnum_words(text)
        starts, base, more, score, blocks = [], set(), set(), 0.0, 0
        if b"license" in words:
            for at, word in enumerate(words):
                if word == b"license":
                    for phrase, label in phrases:
                        first = at - len(phrase) + 1
                        if first >= 0 and tuple(words[first : at + 1]) == phrase:
                            starts.append(first)
                            base.add(label)
        if not index.prefix_words.isdisjoint(words):
            at, lines = 0, []
            for line in text.split(b"\n"):
                mine = alnum_words(line)
                if found := index.matches(mine):
                    lines.append((at, at + len(mine)))
                    more.update(label for label, _ in found)
                    score = max(score, *(s for _, s in found))
                at += len(mine)
            blocks, merged = len(lines), []
            for label, share, first, stop in sorted(index.stretches(words), key=lambda s: s[2]):
                more.add(label)
                score = max(score, share)
                if merged and first < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([first, stop])
            blocks += sum(all(stop <= lo or hi <= first for lo, hi in lines) for first, stop in merged)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, blocks

    def run(batches):
        yield from record_batches(((i.as_py(), *one(t.as_py() or b"")) for b in batches for i, t in zip(b.column(0), b.column(1))), _OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _DDL)

"""License scans by a positional rare-token index.

The index holds where each word stands in each license template. Of the template words that a
text has, the ones that are rarest in the corpus are looked up; every place in the text and
every posting votes for the place where the template would start; places with enough rarity
behind them become matches if the template's key phrases stand near.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procspark.llm.bytescan import ALNUM, Chunk, Words, columns, hash_words, scan, with_fields
from procspark.llm.winnow import word_list

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices and titles (label, notice, phrases that must be there).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted",
                                                                                            "free of charge"]),
    ("apache-2.0", "licensed under the apache license, version 2.0", ["apache license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license, version 3", ["general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", ["general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ["lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license"]),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4.0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4.0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4.0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1.0 universal", ["cc0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ["unencumbered software released into the public domain"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
]
#: Rare words of a template that are looked up in a text.
LOOKUPS = 6
#: Share of a template's rarity that must stand at its place.
COVER = 0.6
#: Words by which places may be off within one match.
SLACK = 2
RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


class TemplateIndex:
    """Postings of a bounded template list; ``rarity`` maps each template word to its weight."""

    def __init__(self, templates, rarity: dict[str, float]):
        self.vocab = sorted({w for _, t, _ in templates for w in word_list(t)}
                            | {w for p in [*PHRASES, *(x for _, _, m in templates for x in m)] for w in word_list(p)})
        code = {w: i for i, w in enumerate(self.vocab)}
        with np.errstate(over="ignore"):
            h = hash_words(self.vocab)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.phrases = [([code[w] for w in word_list(p)], label) for p, label in PHRASES.items()]
        self.templates = []
        for label, text, keys in templates:
            words = [code[w] for w in word_list(text)]
            posts = defaultdict(list)
            for q, w in enumerate(words):
                posts[w].append(q)
            weight = {w: rarity[self.vocab[w]] for w in posts}
            total = sum(weight[w] for w in words)
            rare = sorted(posts, key=lambda w, weight=weight: (-weight[w], w))
            self.templates.append((label, len(words), posts, weight, total, rare, [[code[w] for w in word_list(p)] for p in keys]))

    def codes(self, words: Words) -> np.ndarray:
        """Vocabulary number of each word, -1 for others."""
        near = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[near] == words.hashes, self.order[near], -1)

    def base(self, at: dict[int, list[int]], seq: dict[int, int]) -> list[tuple[int, str]]:
        return [(p, label) for words, label in self.phrases for p in at.get(words[0], ())
                if all(seq.get(p + j) == w for j, w in enumerate(words))]

    def search(self, at: dict[int, list[int]], seq: dict[int, int]) -> dict[str, float]:
        """Label to the best share of template rarity; at: places by word, seq: word by place."""
        best: dict[str, float] = {}
        for label, n, posts, weight, total, rare, keys in self.templates:
            if any(w not in at for key in keys for w in key):
                continue
            votes: dict[int, float] = defaultdict(float)
            looked = [w for w in rare if w in at][:LOOKUPS]
            bar = COVER / 2 * sum(weight[w] for w in looked)
            for w in looked:
                for p in at[w]:
                    for q in posts[w]:
                        votes[p - q] += weight[w]
            for start in votes:
                if sum(votes.get(start + d, 0) for d in range(-SLACK, SLACK + 1)) < bar:
                    continue
                cover = sum(weight[w] for w, qs in posts.items() for q in qs
                            if any(seq.get(start + q + d) == w for d in range(-SLACK, SLACK + 1))) / total
                if cover >= COVER and all(self._near(key, start, n, at, seq) for key in keys):
                    best[label] = max(best.get(label, 0.0), min(1.0, cover))
        return best

    @staticmethod
    def _near(key, start, n, at, seq) -> bool:
        return any(start - SLACK <= p <= start + n + SLACK and all(seq.get(p + j) == w for j, w in enumerate(key))
                   for p in at.get(key[0], ()))


def word_rarity(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[str, float]:
    """Inverse document frequency over all texts of the template words (a bounded vocabulary)."""
    index = TemplateIndex(templates, defaultdict(lambda: 1.0))

    def work(chunk: Chunk) -> dict | None:
        words = chunk.words(ALNUM)
        code = index.codes(words)
        hit = np.flatnonzero(code >= 0)
        pair = np.unique(words.doc[hit] * len(index.vocab) + code[hit])
        count = np.bincount(pair % len(index.vocab), minlength=len(index.vocab))
        return {"word": np.append(np.arange(len(index.vocab)), -1), "n": np.append(count, chunk.n)}

    counts = dict(scan(docs.select(F.col(text).alias("text")), work, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    total = counts.get(-1, 0)
    return {w: math.log((1 + total) / (1 + counts.get(i, 0))) + 0.1 for i, w in enumerate(index.vocab)}


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """docs' other columns with RESULT: n_words, places and labels of the fixed phrases, labels, score.

    Words are lower-cased runs of ASCII letters and digits or anything from 0x80. ``labels`` has the labels of the
    phrases and those of matched templates; ``score`` is the best share of a template's rarity found at one place,
    1 where a phrase stands. Null, empty and wordless texts have no labels and score 0; first_word and last_word
    are null without a phrase. All places with enough votes are tried, so ties between them do not matter. Repeated rows get equal results; columns
    of docs named as the result are replaced; the text column is not returned. An empty table gives no rows.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]
    docs = docs.drop(*[c for c in names if c != text])
    index = TemplateIndex(templates, word_rarity(docs, templates, text))
    rest = [c for c in docs.columns if c != text]

    def work(chunk: Chunk) -> dict:
        words = chunk.words(ALNUM)
        code = index.codes(words)
        hit = np.flatnonzero(code >= 0)
        n = chunk.n
        count, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
        base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
        cuts = np.searchsorted(words.doc[hit], np.arange(n + 1))
        for d in np.flatnonzero(np.diff(cuts)):
            places = hit[cuts[d]:cuts[d + 1]]
            seq = dict(zip((places - words.bounds[d]).tolist(), code[places].tolist()))
            at: dict[int, list[int]] = defaultdict(list)
            for p, w in seq.items():
                at[w].append(p)
            base, found = index.base(at, seq), index.search(at, seq)
            if base:
                starts = [p for p, _ in base]
                count[d], first[d], last[d] = len(base), min(starts), max(starts)
                base_labels[d] = ",".join(sorted({x for _, x in base}))
            labels[d] = ",".join(sorted({x for _, x in base} | set(found)))
            score[d] = 1.0 if base else max(found.values(), default=0.0)
        held = columns(chunk)
        return {c: held[c] for c in rest} | dict(zip(names, (
            words.counts, count, pa.array(first, pa.int64()), pa.array(last, pa.int64()), base_labels, labels, score)))

    return scan(docs, work, with_fields(docs.select(*rest), RESULT), text)

"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-grams of words the one with the smallest hash is kept, the last of
equal ones, so a shared run of ``k + w - 1`` words always shares a kept k-gram. With k + w - 1
equal to the window length no window can be missed. Shared fingerprints are then extended word by
word, and runs of at least the window length are hits.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from procspark.llm.bytescan import ALNUM, U64, Chunk, Words, as_long, columns, mix, scan, with_fields
from procspark.llm.store import row_key, stash

WINDOW = 10
GRAM = 5
#: Benchmark text up to this many bytes goes to the tasks as one index; beyond it fingerprints are joined.
INDEX_BYTES = 16_000_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_LOWER = {i: i + 32 for i in range(65, 91)}
RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_TO_LOWER))


def kept_grams(words: Words, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) of the kept grams, for shared runs of ``length`` words."""
    k = min(gram, length)
    w = length - k + 1
    whole = words.whole(length)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = words.runs(k)
    n = len(whole)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        later = g[j:j + n]
        take = later <= best
        best[take] = later[take]
        at[take] = j
    pos = np.unique((at + np.arange(n))[whole])
    return pos, mix(g[pos] + U64(length))


def runs_of(doc: list[str], item: list[str], places, window: int):
    """Extend places (doc position, item position) to equal runs; yields those of window length."""
    need = min(window, len(item))
    done: dict[int, int] = {}
    for p, q in sorted(places):
        if done.get(p - q, -1) >= p:
            continue
        a, b = 0, 0
        while p > a and q > a and doc[p - a - 1] == item[q - a - 1]:
            a += 1
        while p + b < len(doc) and q + b < len(item) and doc[p + b] == item[q + b]:
            b += 1
        done[p - q] = p + b - 1
        if a + b >= need:
            yield p - a, p + b


def judge(text: str, found: list, window: int) -> tuple[int, set]:
    """(hit words, ids of occurring items); found has (item id, item words, places)."""
    doc = word_list(text)
    hit, ids = np.zeros(len(doc), bool), set()
    for item_id, item, places in found:
        for s, e in runs_of(doc, item, places, window):
            hit[s:e] = True
            ids.add(str(item_id))
    return int(hit.sum()), ids


def digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


class Index:
    """Fingerprints of a bounded set of items."""

    def __init__(self, items: list[tuple[object, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.items = [(i, w) for i, t in items if (w := word_list(t))]
        self.lengths = sorted({min(window, len(w)) for _, w in self.items})
        places: dict[int, list] = defaultdict(list)
        for n, (_, w) in enumerate(self.items):
            raw = [x.encode() for x in w]
            text = b" ".join(raw)
            words = Chunk(None, np.frombuffer(text, np.uint8), np.array([0, len(text)])).words(ALNUM)
            for q, fp in zip(*kept_grams(words, min(window, len(w)), gram)):
                places[int(fp)].append((n, int(q)))
        self.places = dict(places)
        self.prints = np.sort(np.fromiter(self.places, U64, len(self.places)))

    def find(self, words: Words) -> dict[int, list]:
        """Text number to its (item id, item words, places)."""
        by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for length in self.lengths:
            pos, fp = kept_grams(words, length, self.gram)
            near = np.minimum(np.searchsorted(self.prints, fp), len(self.prints) - 1)
            for i in np.flatnonzero(self.prints[near] == fp):
                p = int(pos[i])
                d = int(words.doc[p])
                for n, q in self.places[int(fp[i])]:
                    by[d][n].append((p - int(words.bounds[d]), q))
        return {d: [(*self.items[n], at) for n, at in x.items()] for d, x in by.items()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
                  index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All columns of docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it lies in any occurrence of an item window (``window`` consecutive item words;
    a shorter item is one window). Null or empty texts have no words and no hits; items without id or
    words never match; repeated rows get equal results each; columns of docs with the names of the
    result or ``_row`` are replaced. An empty docs table gives no rows, an empty benchmark no hits.

    The size of the benchmark is looked up first. Up to ``index_bytes`` of text its fingerprints
    go to the tasks and docs are read once, without a shuffle. A larger one is joined by fingerprint;
    only the places found are grouped by document. Both ways give the same rows.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]
    docs = docs.drop(*names, "_row")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where(
        "item_id is not null and item_text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0))).first()[0]
    if size <= index_bytes:
        return _by_index(docs, Index([(r[0], r[1]) for r in items.collect()], window, gram), text, names)
    return _by_join(docs, items, id_col, text, window, gram)


def _by_index(docs: DataFrame, index: Index, text: str, names: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(chunk: Chunk) -> dict:
        words = chunk.words(ALNUM)
        n = chunk.n
        hit, items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [digest(set())] * n
        for d, found in (held.value.find(words) if held.value.items else {}).items():
            hit[d], ids = judge(chunk.text(d), found, held.value.window)
            items[d], sha[d] = len(ids), digest(ids)
        return columns(chunk) | dict(zip(names, (words.counts, hit, items, sha, hit > 0)))

    return scan(docs, work, with_fields(docs, RESULT), text)


def _by_join(docs: DataFrame, items: DataFrame, id_col: str, text: str, window: int, gram: int) -> DataFrame:
    items = stash(items.select(F.xxhash64("item_id", "item_text").alias("_item"), "item_id", "item_text"), "items")
    sizes = F.least(F.lit(window), F.size(F.regexp_extract_all(F.translate(
        "item_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD.pattern), F.lit(0))))
    lengths = sorted(r[0] for r in items.select(sizes.alias("n")).where("n > 0").distinct().collect())  # ≤ window

    def prints(key: str, pick):
        def work(chunk: Chunk) -> dict:
            words = chunk.words(ALNUM)
            keys = chunk.rows.column(0).to_numpy(zero_copy_only=False)
            got = [(pos[ok], fp[ok]) for n in lengths for pos, fp in [kept_grams(words, n, gram)]
                   for ok in [pick(words, pos, n)]]
            pos, fp = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in (0, 1))
            d = words.doc[pos]
            return {key: keys[d], "at": pos - words.bounds[d], "print": as_long(fp.astype(U64))}
        return work

    a = scan(items.select("_item", F.col("item_text").alias("text")), prints(
        "_item", lambda w, pos, n: np.minimum(w.counts, window)[w.doc[pos]] == n), "_item long, at long, print long"
        ).withColumnRenamed("at", "q")
    b = scan(docs.select(row_key(id_col, text), F.col(text).alias("text")).dropDuplicates(["_row"]), prints(
        "_row", lambda w, pos, n: np.ones(len(pos), bool)), "_row long, at long, print long")
    found = (b.join(a, "print").groupBy("_row", "_item").agg(F.collect_list(F.struct("at", "q")).alias("places"))
             .join(items, "_item").groupBy("_row")
             .agg(F.collect_list(F.struct("item_id", "item_text", "places")).alias("_found")))

    def work(chunk: Chunk) -> dict:
        out = columns(chunk)
        counts = chunk.words(ALNUM).counts
        n = chunk.n
        hit, number, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [digest(set())] * n
        for d, each in enumerate(out.pop("_found").to_pylist()):
            if each:
                hit[d], ids = judge(chunk.text(d), [(x["item_id"], word_list(x["item_text"]), [
                    (p["at"], p["q"]) for p in x["places"]]) for x in each], window)
                number[d], sha[d] = len(ids), digest(ids)
        return out | {"n_words": counts, "n_hit": hit, "n_items": number, "items_sha256": sha,
                      "contaminated": hit > 0}

    joined = docs.withColumn("_row", row_key(id_col, text)).join(found, "_row", "left").drop("_row")
    return scan(joined, work, with_fields(docs, RESULT), text)

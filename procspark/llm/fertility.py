"""Quality rules on tokeniser fertility.

Each distinct word of a chunk is encoded once by each public vocabulary, as a word after a space.
Characters per token, the share of byte-fallback tokens and the entropy of a text's tokens are
held against bands around the middle of all texts of its language.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procspark.llm.bytescan import BLANK_SPLIT, Chunk, Words, columns, scan, with_fields
from procspark.llm.store import stash

TOKENIZERS = os.environ.get("PROCSPARK_TOKENIZERS", "/opt/tokenizers")
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = "chars_per_piece double, byte_share double, entropy double, chars_per_byte_token double"
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("cjk", 0x2E80, 0x9FFF),
           ("hangul", 0xAC00, 0xD7AF)]


@lru_cache(maxsize=2)
def vocabularies(folder: str):
    """Encoders of word lists to id arrays; (pieces, byte ids, byte-level)."""
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    fallback = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    with open(f"{folder}/{BYTES}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte_level = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return pieces, fallback, byte_level


def encode_words(words: list[str], folder: str) -> tuple[list[list[int]], np.ndarray, list[int]]:
    """(piece ids of each word, which ids are bytes, byte-level token count of each word)."""
    pieces, fallback, byte_level = vocabularies(folder)
    return pieces.encode(words, num_threads=1), fallback, [len(byte_level.encode_ordinary(" " + w)) for w in words]


def token_measures(words: Words, chars: np.ndarray, folder: str) -> list[pa.Array]:
    """MEASURES of each text of a chunk; null without words. chars: code points in each word."""
    n = words.chunk.n
    empty = words.counts == 0
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    ids, fallback, byte_tokens = encode_words([words.word(i).decode("utf-8", "replace") for i in first], folder)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for w in ids for x in w), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bytes_in = np.add.reduceat(np.append(fallback[flat], 0), starts[:-1]) * (sizes > 0) if len(sizes) else sizes
    per_doc = lambda x: np.bincount(words.doc, weights=x, minlength=n)
    tokens, fell = per_doc(sizes[inverse]), per_doc(bytes_in[inverse])
    level, letters = per_doc(np.array(byte_tokens, float)[inverse] if len(first) else inverse), per_doc(chars)
    # tokens of all words in order, then (text, token) counts
    long = sizes[inverse]
    at = np.repeat(starts[:-1][inverse] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
    pair, count = np.unique(np.repeat(words.doc, long) * len(fallback) + flat[at], return_counts=True)
    doc = pair // len(fallback)
    share = count / tokens[doc]
    entropy = np.bincount(doc, weights=-share * np.log2(share), minlength=n) + 0.0
    some = np.maximum(tokens, 1)
    return [pa.array(x, mask=empty) for x in (letters / some, fell / some, entropy, letters / np.maximum(level, 1))]


def repeated_cover(words: Words, k: int = 5) -> np.ndarray:
    """True for each word in a k-word window that its text has twice or more."""
    covered = np.zeros(len(words) + 1, np.int64)
    whole = np.flatnonzero(words.whole(k))
    if len(whole):
        runs, doc = words.runs(k)[whole], words.doc[whole]
        order = np.lexsort((runs, doc))
        same = (runs[order][1:] == runs[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = whole[order[np.append(same, False) | np.append(False, same)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + k, -1)
    return np.cumsum(covered)[:-1] > 0


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def script_of(text: Column) -> Column:
    """The script with the first letter of a text, for rows without a language."""
    code = F.ascii(F.regexp_extract(text, r"\p{L}", 0))
    out = F.lit("other")
    for name, low, high in reversed(SCRIPTS):
        out = F.when(code.between(low, high), name).otherwise(out)
    return out


def measure(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """docs' columns but the text, with BASE and MEASURES."""
    rest = [c for c in docs.columns if c != text]
    names = [c.split()[0] for c in f"{BASE}, {MEASURES}".split(", ")]

    def work(chunk: Chunk) -> dict:
        words = chunk.words(BLANK_SPLIT, lower=False)
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        chars = points[words.end] - points[words.start]
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[chunk.data])])
        lines = np.array([repeated_lines(chunk.text(i)) for i in range(chunk.n)], np.int64)
        base = (words.counts, np.bincount(words.doc, weights=chars, minlength=chunk.n).astype(np.int64),
                np.diff(symbols[chunk.offsets]), lines,
                np.bincount(words.doc, weights=repeated_cover(words), minlength=chunk.n).astype(np.int64))
        held = columns(chunk)
        return {c: held[c] for c in rest} | dict(zip(names, [*base, *token_measures(words, chars, folder)]))

    return scan(docs, work, with_fields(docs.select(*rest), f"{BASE}, {MEASURES}"), text)


#: A band goes so many robust deviations of a text of its length below and above the middle (a text of common words only
#: strays upwards and is no junk), and at least so much in the measure's own unit.
BELOW, ABOVE = 5.0, 8.0
LEAST = {"chars_per_piece": 0.03, "chars_per_byte_token": 0.03, "byte_share": 0.05}
#: Shortest text, in words, of those that form the bands; all texts are held against them.
ENOUGH = 20


def bands(stats: DataFrame, group: str) -> DataFrame:
    """(group, mid_<measure>, dev_<measure> ...) from all texts of ``ENOUGH`` words, one row a group.

    A measure is a mean over words, so it strays with one over the square root of their number: dev is the median
    of the distances from the middle times that root, as a normal deviation.
    """
    long = stats.where(F.col("n_words") >= ENOUGH)
    mid = long.groupBy(group).agg(*[F.percentile_approx(m, 0.5, 2000).alias(f"mid_{m}") for m in LEAST])
    away = {m: F.abs(F.col(m) - F.col(f"mid_{m}")) * F.sqrt("n_words") for m in LEAST}
    mid = stash(mid, "middles")
    dev = with_small(long, mid, group).groupBy(group).agg(
        *[(F.percentile_approx(x, 0.5, 2000) * 1.4826).alias(f"dev_{m}") for m, x in away.items()])
    return stash(mid.join(dev, group), "bands")


#: Rows of a table of groups up to which it goes to all tasks.
SMALL = 10_000


def with_small(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """rows with the columns of their group, where it has any. A stored table of up to ``SMALL`` groups goes to the rows, which stay
    where they are however many are of one group; the rows go by group only to a larger one."""
    return rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, group, "left")


def expected_entropy(n_tokens: Column) -> Column:
    """Least token entropy of running text: half of what its length allows, three bits at most."""
    return F.least(F.log2(F.greatest(n_tokens, F.lit(1.0))) * 0.5, F.lit(3.0))


def fertility_rules(docs: DataFrame, text: str = "text", lang: str = "lang", folder: str = TOKENIZERS) -> DataFrame:
    """docs' other columns with BASE, MEASURES, base_failed and kept.

    Words are runs of anything but space and 0x09-0x0D. base_failed: under 10 words, or over 20 % of them in
    repeated 5-word windows. kept: not base_failed, characters per token (both vocabularies) and byte share within
    the bands of the text's language (its script where that is null), and enough token entropy. Bands come
    from all texts of a language; a language without texts of ``ENOUGH`` words has none and rejects nothing. Null,
    empty and blank texts have zero counts, null measures, and fail. Repeated rows get equal results;
    columns of docs named as results are replaced. An empty table gives no rows.
    """
    names = [c.split()[0] for c in f"{BASE}, {MEASURES}".split(", ")] + ["base_failed", "kept", "_group"]
    docs = docs.drop(*names)
    group = F.coalesce(lang, script_of(F.col(text))) if lang in docs.columns else script_of(F.col(text))
    stats = stash(measure(docs.withColumn("_group", group), text, folder), "fertility")
    limits = bands(stats, "_group")
    inside = F.lit(True)
    for m in LEAST:
        off, dev = F.col(m) - F.col(f"mid_{m}"), F.col(f"dev_{m}") / F.sqrt(F.greatest("n_words", F.lit(1)))
        inside &= F.coalesce(off.between(-BELOW * dev - LEAST[m], ABOVE * dev + LEAST[m]), F.lit(True))
    varied = F.col("entropy") >= expected_entropy(F.col("word_chars") / F.col("chars_per_piece"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = [c for c in stats.columns if c != "_group"]
    return (with_small(stats, limits, "_group").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & inside & F.coalesce(varied, F.lit(True)))
            .select(*out, "base_failed", "kept"))

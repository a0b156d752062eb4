"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Features of the line and its neighbours feed the states, and a 2 x 2 table
links neighbouring states. Forward-backward gives each line's chance of being good; a document's
score is their mean by line length. Lines of labelled documents learn the document's label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from procspark.llm.bytescan import BLANK_SPLIT, U64, Chunk, columns, mix, scan, with_fields
from procspark.llm.fertility import repeated_cover
from procspark.llm.store import labelled_rows, row_key

#: Labelled documents that the field is fitted on at most, lines of one of them, and of all.
MAX_DOCS, MAX_LINES, MAX_TOTAL = 4000, 2000, 500_000
ROUNDS, RATE, PENALTY = 250, 0.05, 1e-3
GOOD = 0.7


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_B = np.arange(256)
_CLASSES = {"symbol": _class(b"#*$%&|<>~^\\{}[]_=+@"), "bar": _class(b"|"), "upper": (_B >= 65) & (_B <= 90),
            "lower": (_B >= 97) & (_B <= 122), "digit": (_B >= 48) & (_B <= 57), "shout": _class(b"!?"),
            "stop": _class(b".,;:"), "wide": _B >= 128}
_NEIGHBOUR = ("symbol", "bar", "upper", "shout", "repeat", "same", "copy")


def line_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, line lengths in bytes, first line of each text); a text has one line at least."""
    data, off = chunk.data, chunk.offsets
    nl = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(nl, off)) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(chunk.n), per)
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    start[head], start[~head] = off[:-1], nl + 1
    end[tail], end[~tail] = off[1:], nl
    length = end - start
    share = {}
    for name, kind in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(kind[data])])
        share[name] = (total[end] - total[start]) / np.maximum(length, 1)
    words = chunk.words(BLANK_SPLIT)
    at = np.searchsorted(words.start, start)
    to = np.searchsorted(words.start, end)
    count = to - at
    some = np.maximum(count, 1)

    def mean(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(flag)])
        return (total[to] - total[at]) / some

    h = words.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    size = words.end - words.start
    share["same"], share["repeat"] = mean(same), mean(repeated_cover(words))
    # lines with a word that stand earlier in their text
    run = np.concatenate([[U64(0)], np.cumsum(h, dtype=U64)])
    line = mix((run[to] - run[at]) + mix(count.astype(U64) * U64(2) + U64(1)) + mix(length.astype(U64)))
    order = np.lexsort((line, doc))
    copy = np.zeros(len(line), bool)
    copy[order[1:]] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    share["copy"] = (copy & (count > 0)).astype(float)
    letters = np.maximum(share["upper"] + share["lower"], 1e-9)
    n_lines = np.repeat(per, per)
    own = [np.sqrt(share[x]) for x in ("symbol", "bar", "digit", "shout", "stop", "wide")]
    own += [share["upper"] / letters, share["same"], share["repeat"], share["copy"], np.log1p(length) / 10, np.log1p(count) / 8,
            np.minimum(mean(size), 30) / 10, mean(size <= 3), count < 3, head, tail, np.log1p(n_lines) / 5, count == 0]
    near = np.array([share[x] for x in _NEIGHBOUR])
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[:, 1:], after[:, :-1] = near[:, :-1], near[:, 1:]
    before[:, head], after[:, tail] = 0, 0
    return np.vstack([*own, before, after, np.ones(len(doc))]).T.astype(np.float64), length, first


class Field:
    """Weights of the field: ``unary`` on standardised features for good against bad, ``step`` between states."""

    def __init__(self, width: int):
        self.unary, self.step = np.zeros(width), np.zeros((2, 2))
        self.middle, self.spread = np.zeros(width), np.ones(width)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) / self.spread) @ self.unary

    def marginals(self, good: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(chance of good by line, expected steps (2 x 2), log normaliser) of lines ``first[i]:first[i+1]``."""
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        at, sizes = first[:-1][order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences with a line t
        unary = np.stack([np.zeros(len(good)), good], 1)
        ahead, back = np.empty_like(unary), np.zeros_like(unary)
        if longest:
            ahead[at] = unary[at]
        for t in range(1, longest):
            i = at[:active[t]] + t
            p = ahead[i - 1]
            ahead[i] = np.logaddexp(p[:, :1] + self.step[0], p[:, 1:] + self.step[1]) + unary[i]
        steps = np.zeros((2, 2))
        last = at + sizes - 1
        norm = np.logaddexp(ahead[last, 0], ahead[last, 1]) if longest else np.zeros(0)
        for t in range(longest - 1, 0, -1):
            i = at[:active[t]] + t
            q = back[i] + unary[i]
            back[i - 1] = np.logaddexp(self.step[:, 0] + q[:, :1], self.step[:, 1] + q[:, 1:])
            steps += np.exp(ahead[i - 1][:, :, None] + self.step + q[:, None, :]
                            - norm[:active[t], None, None]).sum(0)
        both = ahead + back
        total = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        return total, steps, float(norm.sum())

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
        """Gradient ascent on the likelihood of lines labelled as their documents, each document weighing the same."""
        self.middle, self.spread = x.mean(0), x.std(0) + 1e-6
        self.middle[-1], self.spread[-1] = 0, 1
        z = (x - self.middle) / self.spread
        sizes = np.diff(first)
        y = np.repeat(labels, sizes).astype(float)
        n = len(y)
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = (sizes - 1)[labels == v].sum()
        moment = [np.zeros(len(self.unary) + 4), np.zeros(len(self.unary) + 4)]
        for r in range(1, ROUNDS + 1):
            p, steps, _ = self.marginals(z @ self.unary, first)
            grad = np.concatenate([z.T @ (y - p) / n - PENALTY * self.unary,
                                   ((seen - steps) / n - PENALTY * self.step).ravel()])
            moment[0] = 0.9 * moment[0] + 0.1 * grad
            moment[1] = 0.99 * moment[1] + 0.01 * grad * grad
            move = RATE * (moment[0] / (1 - 0.9**r)) / (np.sqrt(moment[1] / (1 - 0.99**r)) + 1e-9)
            self.unary = self.unary + move[:-4]
            self.step = self.step + move[-4:].reshape(2, 2)
        return self

    def document_scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        p, _, _ = self.marginals(self.scores(x), first)
        weight = length + 1.0
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_field(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES,
              max_total: int = MAX_TOTAL) -> Field:
    """Fit on ``max_docs`` labelled rows at most, taken in the order of a hash of their ids; never on held-out ids.

    docs has (doc_id, text), labels (doc_id, quality). Labelled texts of over ``max_lines`` lines are left to be
    scored only, as are those after which the rest would have over ``max_total`` lines. Without labels of both kinds all weights
    stay zero and every score is 0.5.
    """
    marks = (labels.where("quality is not null and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = labelled_rows(docs, marks, max_docs).withColumn("n", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    rows = rows.where(F.col("n") <= max_lines).withColumn("_row", row_key())
    order = rows.select("_row", "n").orderBy(F.xxhash64("doc_id"), "doc_id", "_row").collect()  # at most max_docs pairs
    most = int(np.searchsorted(np.cumsum([r.n for r in order]), max_total, "right"))
    rows = rows.where(F.col("_row").isin([r["_row"] for r in order[:most]])) if most < len(order) else rows

    def work(chunk: Chunk) -> dict:
        x, _, first = line_features(chunk)
        return {"y": columns(chunk)["quality"], "id": columns(chunk)["doc_id"].cast("string"),
                "x": [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]}

    got = sorted(scan(rows.select("doc_id", "quality", "text"), work, "y long, id string, x binary").collect(),
                 key=lambda r: (r.id, bytes(r.x)))
    width = line_features(Chunk(None, np.zeros(0, np.uint8), np.zeros(2, np.int64)))[0].shape[1]
    field = Field(width)
    if len({int(r.y > 0) for r in got}) < 2:
        return field
    each = [np.frombuffer(r.x, np.float32).reshape(-1, width).astype(np.float64) for r in got]
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    return field.fit(np.vstack(each), first, np.array([int(r.y > 0) for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                  quality: str = "quality", good: float = GOOD, **bounds) -> DataFrame:
    """docs' columns with held_out, score and predicted; a row for each row.

    The score reads the text only. Null texts count as empty; empty texts have one empty line and are scored by it;
    rows with a null id are scored and never learnt from; repeated rows get equal scores; labels that repeat an id
    count once, with the lowest quality. Columns of docs named as the result are replaced. An empty table gives
    no rows, an empty label table scores of 0.5.
    """
    docs = docs.drop("held_out", "score", "predicted")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(quality).cast("long").alias("quality"))
    field = fit_field(plain, marks, **bounds)

    def work(chunk: Chunk) -> dict:
        return columns(chunk) | {"score": field.document_scores(*line_features(chunk))}

    return (scan(docs, work, with_fields(docs, "score double"), text).withColumn("held_out", held_out(id_col))
            .withColumn("predicted", (F.col("score") >= good).cast("int")))

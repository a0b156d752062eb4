"""Mixing documents to target weights of softly known domains.

A classifier fitted on the labelled table gives each document chances of the domains. Projected
gradient least squares then finds document rates of zero or more whose expected tokens per
domain meet the targets. Documents keep their posterior only; a step is one sum of K numbers
over all of them, and a document's rate is folded from the K-vectors of the steps so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procspark.llm.bytescan import ALNUM, U64, Chunk, as_long, columns, scan, with_fields
from procspark.llm.crf import line_features
from procspark.llm.store import labelled_rows, stash

#: Domains by (quality, toxic), and the share of all tokens that each is to have.
DOMAINS = {"good": (1, 0), "poor": (0, 0), "good_toxic": (1, 1), "poor_toxic": (0, 1)}
TARGETS = {"good": 0.93, "poor": 0.05, "good_toxic": 0.015, "poor_toxic": 0.005}
#: Tokens to be drawn, as a share of those there are.
BUDGET = 0.5
#: Labelled documents that the classifier is fitted on at most, and telling words of a domain.
MAX_DOCS, TELLING = 4000, 64
ROUNDS, RATE, PENALTY = 300, 0.05, 1e-3
STEPS, CLOSE, RIDGE = 60, 1e-5, 0.003


def document_features(chunk: Chunk) -> np.ndarray:
    """Mean line features of each text, by line length."""
    x, length, first = line_features(chunk)
    weight = length + 1.0
    return np.add.reduceat(x * weight[:, None], first[:-1]) / np.add.reduceat(weight, first[:-1])[:, None]


class Posterior:
    """Softmax on document features and on the presence of telling words."""

    def __init__(self, classes: int):
        self.classes, self.words = classes, np.zeros(0, U64)
        self.weights: np.ndarray | None = None
        self.middle = self.spread = None

    def presence(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(texts x telling words, words by text)."""
        words = chunk.words(ALNUM)
        out = np.zeros((chunk.n, len(self.words)))
        if len(self.words):
            near = np.minimum(np.searchsorted(self.words, words.hashes), len(self.words) - 1)
            hit = self.words[near] == words.hashes
            out[words.doc[hit], near[hit]] = 1
        return out, words.counts

    def _x(self, features: np.ndarray, presence: np.ndarray) -> np.ndarray:
        return np.hstack([(features - self.middle) / self.spread, presence, np.ones((len(features), 1))])

    def chances(self, features: np.ndarray, presence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(features), self.classes), 1 / self.classes)
        return softmax(self._x(features, presence) @ self.weights)

    def fit(self, features: np.ndarray, here: np.ndarray, y: np.ndarray) -> Posterior:
        """here: the presence of ``words`` by text; y: domain numbers. Without two domains chances stay even."""
        if len(np.unique(y)) < 2:
            return self
        self.middle, self.spread = features.mean(0), features.std(0) + 1e-6
        x = self._x(features, here)
        want = np.eye(self.classes)[y]
        w = np.zeros((x.shape[1], self.classes))
        m, s = np.zeros_like(w), np.zeros_like(w)
        for r in range(1, ROUNDS + 1):
            g = x.T @ (softmax(x @ w) - want) / len(y) + PENALTY * w
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - RATE * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-9)
        self.weights = w
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def telling_words(rows: DataFrame, size: np.ndarray, most: int = TELLING) -> np.ndarray:
    """Sorted hashes of the ``most`` words that tell each domain best, by the texts (text, y) that have them; size: texts by domain."""
    def work(chunk: Chunk) -> dict:
        words = chunk.words(ALNUM)
        own = [np.unique(words.hashes[a:b]) for a, b in zip(words.bounds, words.bounds[1:])]
        y = columns(chunk)["y"].to_numpy()
        return {"word": as_long(np.concatenate(own)), "y": np.repeat(y, [len(w) for w in own])}

    counts = scan(rows.select("text", "y"), work, "word long, y long").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(len(size))])
    counts = stash(counts.where("n >= 3"), "words")
    found: set[int] = set()
    for k, texts in enumerate(size):
        rate = (F.col(f"n{k}") + 0.5) / float(texts + 1)
        rest = (F.col("n") - F.col(f"n{k}") + 0.5) / float(size.sum() - texts + 1)
        told = F.sqrt(F.greatest(rate, rest)) * F.log(rate / rest)
        found |= {r.word for r in counts.orderBy(told.desc(), F.col("word").bitwiseXOR(F.lit(-2**63))).limit(most).collect()}
    return np.sort(np.array(sorted(found), np.int64).view(U64))


def fit_posterior(docs: DataFrame, labels: DataFrame, domain: Column, classes: int, max_docs: int = MAX_DOCS) -> Posterior:
    """Fit on ``max_docs`` labelled documents at most, by a hash of their ids. docs has (doc_id, text).

    Words are counted by Spark; what reaches the driver is one row of fixed size for each of these documents.
    """
    marks = (labels.select("doc_id", domain.alias("y")).where("doc_id is not null and y is not null")
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    rows = labelled_rows(docs, marks, max_docs)
    size = np.zeros(classes, np.int64)
    for r in rows.groupBy("y").count().collect():
        size[r.y] = r["count"]
    model = Posterior(classes)
    if (size > 0).sum() < 2:
        return model
    model.words = telling_words(rows, size)

    def work(chunk: Chunk) -> dict:
        held = columns(chunk)
        return {"y": held["y"], "id": held["doc_id"].cast("string"), "x": [r.tobytes() for r in document_features(chunk)],
                "here": [r.astype(np.uint8).tobytes() for r in model.presence(chunk)[0]]}

    got = scan(rows.select("doc_id", "y", "text"), work, "y long, id string, x binary, here binary").collect()
    got.sort(key=lambda r: (r.id, bytes(r.x)))
    return model.fit(np.array([np.frombuffer(r.x) for r in got]), np.array([np.frombuffer(r.here, np.uint8) for r in got], float),
                     np.array([r.y for r in got]))


def fold_rates(p: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps: each moves along a document's posterior and is cut at zero."""
    r = np.full(len(p), start)
    for g in steps:
        r = np.maximum(r - p @ g, 0)
    return r


def fit_rates(table: DataFrame, classes: int, targets: np.ndarray, budget: float) -> tuple[float, list[np.ndarray]]:
    """(start rate, steps) for the least squares fit; table has (n_tokens, p).

    Documents are measured by their tokens, so a step of the gradient moves a rate along the document's posterior.
    Residuals are weighted by the inverse of M = sum(tokens * p p') plus a share ``RIDGE`` of all tokens, over the
    documents whose rate is above zero: a unit step is then safe, and a domain with next to no tokens cannot outweigh the
    others. A step that raises the misfit is halved. One pass over the table gives a step's K residuals and K x K moments.
    """
    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    p, t = _posterior(b, classes), b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                    r = fold_rates(p, budget, steps)
                    m = (p * (t * (r > 0))[:, None]).T @ p
                    yield pa.RecordBatch.from_pydict({"k": np.arange(classes * (classes + 1)),
                                                      "v": np.concatenate([(r * t) @ p, m.ravel()])})

        out = np.zeros(classes * (classes + 1))
        for k, v in table.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
            out[k] = v
        return out[:classes], out[classes:].reshape(classes, classes)

    _, whole = sums([])
    tokens = whole.sum()
    if tokens == 0:
        return budget, []
    want, floor = targets * budget * tokens, np.eye(classes) * RIDGE * tokens
    inverse = np.linalg.inv(whole + floor)
    steps, best, least = [], [], np.inf
    for _ in range(STEPS):
        mass, active = sums(steps)
        off = mass - want
        misfit = float(off @ inverse @ off) / tokens
        if misfit < least:
            gained, best, least = least - misfit, steps, misfit
            if np.abs(off).max() <= CLOSE * budget * tokens or gained <= 1e-12 * least:
                break
            steps = [*steps, np.linalg.solve(active + floor, off)]
        elif len(steps) > len(best) and np.abs(steps[-1]).max() > 1e-9:
            steps = [*best, steps[-1] / 2]
        else:
            break
    return budget, best


def _posterior(batch: pa.RecordBatch, classes: int, name: str = "p") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET,
                  domains: dict[str, tuple[int, int]] = DOMAINS, id_col: str = "doc_id", text: str = "text",
                  keep_text: bool = False) -> DataFrame:
    """docs' columns (the text only with keep_text), with n_tokens, p_<domain> and rate.

    The rates are those nearest to ``budget`` (in tokens) whose expected tokens per domain are ``targets`` * budget *
    all tokens, as close as rates of zero or more come to it. Null and empty texts have no tokens and
    take a rate by their posterior like others; labels with nulls or repeated ids count once or not at all; without
    labels of two domains all chances are even. Repeated rows get equal rates. Columns of docs named
    as the result are replaced; an empty table gives no rows.
    """
    names = list(domains)
    domain = F.lit(None).cast("long")
    for i, (quality, toxic) in enumerate(domains.values()):
        domain = F.when((F.col("quality") == quality) & (F.col("toxic") == toxic), i).otherwise(domain)
    docs = docs.drop("n_tokens", "rate", *(f"p_{n}" for n in names))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    model = fit_posterior(plain, labels.withColumnRenamed(id_col, "doc_id"), domain, len(names))
    rest = [c for c in docs.columns if keep_text or c != text]

    def work(chunk: Chunk) -> dict:
        presence, n = model.presence(chunk)
        p = model.chances(document_features(chunk), presence)
        held = columns(chunk)
        return {c: held[c] for c in rest} | {"n_tokens": n, "rate": list(p)}

    # the posterior stands in the column of the rate until that is known, which clashes with nothing
    table = stash(scan(docs, work, with_fields(docs.select(*rest), "n_tokens long, rate array<double>"), text), "posterior")
    want = np.array([targets[n] for n in names])
    start, steps = fit_rates(table.select("n_tokens", F.col("rate").alias("p")), len(names), want, budget)
    results = [f"p_{n}" for n in names]

    def rates(batches):
        for b in batches:
            if b.num_rows:
                p = _posterior(b, len(names), "rate")
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c) for c in p.T.copy()], pa.array(fold_rates(p, start, steps))],
                                                 [*b.schema.names[:-1], *results, "rate"])

    return table.mapInArrow(rates, with_fields(table.drop("rate"), ", ".join(f"`{c}` double" for c in results) + ", rate double"))

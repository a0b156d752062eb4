"""Secret scans: fixed patterns, and a character convolutional network for what they miss.

Candidates are runs of key-like characters. The network sees each whole candidate, in windows with
its surroundings, and is trained on labelled findings: pattern hits against other candidates.
Its probabilities are calibrated on held-out findings and cut where recall still meets a target.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procspark.llm.bytescan import Chunk, Words, columns, scan, with_fields
from procspark.llm.store import stash

#: The patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "neural")
LEAST = {"assign": 8, "access": 16, "hex": 32}
VALUE_RUN = re.compile("[A-Za-z0-9+/_=-]{8,}")

_B = np.arange(256)
HEX = ((_B >= 48) & (_B <= 57)) | ((_B >= 97) & (_B <= 102))
KEY_LIKE = np.isin(_B, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8))
#: Shortest candidate; window of the network: characters before, inside and after; step between windows of one candidate.
SHORTEST, BEFORE, INSIDE, AFTER, STRIDE = 8, 24, 64, 8, 48
WIDTH = BEFORE + INSIDE + AFTER
#: Bytes convolved at a time.
BLOCK = 1 << 13
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns in code points; hexes: the runs of hex digits that are long enough."""
    out = [(s, e, "hex") for s, e in hexes]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the key-like runs in the values that ``assign`` hits give, as candidates are cut."""
    return [(m.start(2) + r.start(), m.start(2) + r.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
            for r in VALUE_RUN.finditer(m[2])]


class Candidates:
    """Pattern hits by text, and the key-like runs of a chunk that do not lie within one."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])

        def runs(kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w = Words(chunk, kind, False)
            keep = w.end - w.start >= least
            return w.start[keep], w.end[keep], w.doc[keep]

        shift = points[chunk.offsets]
        hex_start, hex_end, hex_doc = runs(HEX, LEAST["hex"])
        hexes: dict[int, list] = {}
        for s, e, d in zip(points[hex_start], points[hex_end], hex_doc):
            hexes.setdefault(int(d), []).append((int(s - shift[d]), int(e - shift[d])))
        self.base = [base_spans(chunk.text(i), hexes.get(i, [])) for i in range(chunk.n)]
        start, end, doc = runs(KEY_LIKE, SHORTEST)
        self.at = np.stack([points[start] - shift[doc], points[end] - shift[doc]], 1) if len(start) else np.zeros((0, 2), int)
        # a run that goes on beyond a hit is a candidate as a whole, but no example of a plain one
        free, apart = np.ones(len(start), bool), np.ones(len(start), bool)
        for i in np.flatnonzero(np.array([bool(b) for b in self.base], bool)[doc]) if len(start) else ():
            s, e = self.at[i]
            free[i] = not any(a <= s and e <= b for a, b, _ in self.base[doc[i]])
            apart[i] = not any(s < b and a < e for a, b, _ in self.base[doc[i]])
        self.free, self.plain = np.flatnonzero(free), np.flatnonzero(apart)
        self.start, self.end, self.doc = start, end, doc
        self._points, self._shift = points, shift

    def findings(self) -> list[tuple[int, int, int]]:
        """Byte ranges and text numbers of what the patterns found, cut as candidates are: of ``assign`` hits the value."""
        where = np.flatnonzero(np.diff(self._points))
        out = []
        for d, spans in enumerate(self.base):
            if spans:
                found = [(a, b) for a, b, k in spans if k != "assign"] + values(self.chunk.text(d))
                out += [(int(where[a + self._shift[d]]), int(where[b - 1 + self._shift[d]]) + 1, d) for a, b in found]
        return out

    def windows(self, start: int, end: int, doc: int) -> np.ndarray:
        """Windows over a candidate: characters (0 outside the text), one row each."""
        lo, hi = self.chunk.offsets[doc], self.chunk.offsets[doc + 1]
        out = []
        for s in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
            e = min(end, s + INSIDE)
            row = np.zeros(WIDTH, np.uint8)
            a = max(lo, s - BEFORE)
            row[BEFORE - (s - a):BEFORE] = self.chunk.data[a:s]
            row[BEFORE:BEFORE + e - s] = self.chunk.data[s:e]
            b = min(hi, e + AFTER)
            row[BEFORE + INSIDE:BEFORE + INSIDE + b - e] = self.chunk.data[e:b]
            out.append(np.minimum(row, 128))
        return np.array(out)

    def scores(self, net: CharNet, which: np.ndarray) -> np.ndarray:
        """The largest logit over the windows of each of the candidates ``which``, as ``net.scores`` of their windows.

        The texts' bytes are convolved once, in blocks, with zeros between texts; windows are ranges of that.
        """
        if not len(which):
            return np.zeros(0)
        gap = BEFORE + AFTER
        sizes = np.diff(self.chunk.offsets)
        data = np.zeros(len(self.chunk.data) + gap * self.chunk.n, np.uint8)
        data[np.arange(len(self.chunk.data)) + np.repeat(gap * np.arange(self.chunk.n) + BEFORE, sizes)] = np.minimum(self.chunk.data, 128)
        moved = gap * self.doc[which] + BEFORE
        start, end = self.start[which] + moved, self.end[which] + moved
        many = np.maximum(1, -(-(end - start - INSIDE + STRIDE) // STRIDE))
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        s = np.repeat(start, many) + STRIDE * (np.arange(many.sum()) - np.repeat(first, many))
        e = np.minimum(np.repeat(end, many), s + INSIDE)
        z, tables = np.zeros(len(s)), net.tables()
        cuts = np.searchsorted(s, np.arange(0, len(data), BLOCK))
        for lo, hi in zip(cuts, [*cuts[1:], len(s)]):
            if lo < hi:
                a, b = int(s[lo]) - BEFORE, int(e[lo:hi].max()) + AFTER
                z[lo:hi] = net.range_logits(data[a:b], s[lo:hi] - a, e[lo:hi] - a, tables)
        return np.maximum.reduceat(z, first)


class CharNet:
    """Embedding, one convolution, maximum and mean over the places before, inside and after; logistic output; numpy.

    The characters of a window stand end to end. Its places are the middles of SPAN characters within it.
    """

    SIZE, FILTERS, SPAN = 8, 16, 5
    HALF = SPAN // 2

    def __init__(self, seed: int = 17):
        r = np.random.default_rng(seed)
        fan = self.SIZE * self.SPAN
        self.p = {"emb": r.normal(0, .3, (129, self.SIZE)), "conv": r.normal(0, fan**-.5, (fan, self.FILTERS)),
                  "bias": np.zeros(self.FILTERS), "out": r.normal(0, .2, 6 * self.FILTERS + 1), "top": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0  # calibration; nothing passes before fit()

    def _joined(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters end to end, and whether a place is before, inside or after: (window, part, place)."""
        n = (x[:, BEFORE:BEFORE + INSIDE] > 0).sum(1, keepdims=True)
        p = np.arange(WIDTH)
        c = np.take_along_axis(x, np.minimum(np.where(p < BEFORE + n, p, p + INSIDE - n), WIDTH - 1), 1)
        c = np.where(p < BEFORE + n + AFTER, c, 0)
        at = p[self.HALF:WIDTH - self.HALF]
        return c, np.stack([np.broadcast_to(at < BEFORE, (len(x), len(at))), (at >= BEFORE) & (at < BEFORE + n),
                            (at >= BEFORE + n) & (at < BEFORE + n + AFTER - self.HALF)], 1)

    def forward(self, x: np.ndarray):
        c, part = self._joined(x)
        view = np.lib.stride_tricks.sliding_window_view(self.p["emb"][c], self.SPAN, 1)  # (n, places, size, span)
        u = view.reshape(len(x), view.shape[1], -1)
        a = u @ self.p["conv"] + self.p["bias"]
        r = np.maximum(a, 0)
        count = np.maximum(part.sum(2), 1)
        held = np.where(part[..., None], r[:, None], -1.0)  # (n, part, place, filter)
        top = held.argmax(2)
        mean = np.einsum("nqp,npf->nqf", part.astype(float), r) / count[..., None]
        size = np.log1p(part[:, 1].sum(1, keepdims=True)) / 4
        h = np.concatenate([np.maximum(held.max(2), 0).reshape(len(x), -1), mean.reshape(len(x), -1), size], 1)
        return h @ self.p["out"] + self.p["top"][0], (c, part, count, u, a, top, h)

    def logits(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + step])[0] for i in range(0, len(x), step)] or [np.zeros(0)])

    def tables(self) -> list[np.ndarray]:
        """What one and two characters add to a place, by their position: two of the first four, then the last."""
        taps = (self.p["emb"] @ self.p["conv"].reshape(self.SIZE, self.SPAN, -1).transpose(1, 0, 2)).astype(np.float32)
        pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(129 * 129, -1) for j in (0, 2)]
        return [pairs[0] + self.p["bias"].astype(np.float32), pairs[1], taps[4]]

    def range_logits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """As ``logits`` for the ranges [start, end) of SHORTEST to INSIDE characters of data, which has all their surroundings.

        Table look-ups make the convolution, doubled steps the maxima over 2, 4, ... places and running sums the means.
        """
        x = data.astype(np.int32)
        two = x[:-1] * 129 + x[1:]
        n = len(x) - self.SPAN + 1
        r = np.take(tables[0], two[:n], 0)
        r += np.take(tables[1], two[2:2 + n], 0)
        r += np.take(tables[2], x[4:], 0)
        np.maximum(r, 0, out=r)
        best = [r]  # best[k][i]: the maximum over 2 ** k places from i on
        for k in range(6):
            best.append(np.maximum(best[k][:-(1 << k)], best[k][1 << k:]) if len(best[k]) > 1 << k else best[k][:0])
        sums = np.zeros((n + 1, self.FILTERS))
        np.cumsum(r, 0, dtype=np.float64, out=sums[1:])
        h = np.zeros((len(start), 6, self.FILTERS))
        bounds = ((start - BEFORE, start - self.HALF), (start - self.HALF, end - self.HALF), (end - self.HALF, end + AFTER - self.SPAN + 1))
        for q, (lo, hi) in enumerate(bounds):
            size = hi - lo
            for k in np.unique(np.log2(size).astype(int)):
                at = np.flatnonzero(size >> k == 1)
                h[at, q] = np.maximum(best[k][lo[at]], best[k][hi[at] - (1 << k)])
            h[:, 3 + q] = (sums[hi] - sums[lo]) / size[:, None]
        out = self.p["out"]
        return h.reshape(len(start), -1) @ out[:-1] + np.log1p(end - start) / 4 * out[-1] + self.p["top"][0]

    def grads(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        z, (c, part, count, u, a, top, h) = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight / len(x)
        f, m = self.FILTERS, len(x)
        dh = (d[:, None] * self.p["out"][:-1]).reshape(m, 6, f)
        dr = np.einsum("nqp,nqf->npf", part / count[..., None], dh[:, 3:])
        n, k = np.meshgrid(np.arange(m), np.arange(f), indexing="ij")
        for q in range(3):
            np.add.at(dr, (n, top[:, q], k), dh[:, q] * part[:, q].any(1)[:, None])
        da = dr * (a > 0)
        du = (da @ self.p["conv"].T).reshape(m, -1, self.SIZE, self.SPAN)
        de = np.zeros((m, WIDTH, self.SIZE))
        for j in range(self.SPAN):
            de[:, j:j + du.shape[1]] += du[..., j]
        demb = np.stack([np.bincount(c.ravel(), de[..., i].ravel(), 129) for i in range(self.SIZE)], 1)
        conv = u.reshape(-1, u.shape[2]).T @ da.reshape(-1, f)
        return {"emb": demb, "conv": conv, "bias": da.sum((0, 1)), "out": h.T @ d, "top": np.array([d.sum()])}

    def top_windows(self, x: list[np.ndarray]) -> np.ndarray:
        """The window with the largest logit of each candidate, which is what scoring goes by."""
        z = self.logits(np.concatenate(x)) if any(len(w) > 1 for w in x) else np.zeros(len(x))
        ends = np.cumsum([len(w) for w in x])
        return np.array([w[z[e - len(w):e].argmax()] for w, e in zip(x, ends)])

    def scores(self, x: list[np.ndarray]) -> np.ndarray:
        """The largest logit over the windows of each candidate."""
        return np.maximum.reduceat(self.logits(np.concatenate(x)), np.concatenate([[0], np.cumsum([len(w) for w in x])[:-1]]))

    def fit(self, x: list[np.ndarray], y: np.ndarray, epochs: int, recall: float, seed: int = 5, of: np.ndarray | None = None) -> CharNet:
        """Train on four of five findings, calibrate and choose the threshold on the fifth; x has the windows of each.

        ``of``: the finding each x was made from, so that all that was made from one is held out together.
        """
        r = np.random.default_rng(seed)
        of = np.arange(len(y)) if of is None else of
        held = np.zeros(len(y), bool)
        for v in (0, 1):
            i = r.permutation(np.unique(of[y == v]))
            held |= (y == v) & np.isin(of, i[: max(1, len(i) // 5)])
        train = np.flatnonzero(~held)
        share = np.array([np.mean(y[train] == 0), np.mean(y[train] == 1)])
        weight = np.where(y == 1, .5 / max(share[1], 1e-9), .5 / max(share[0], 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            for i in np.array_split(r.permutation(train), max(1, len(train) // 64)):
                t += 1
                for k, g in self.grads(self.top_windows([x[j] for j in i]), y[i], weight[i]).items():
                    m[k] = .9 * m[k] + .1 * g
                    s[k] = .999 * s[k] + .001 * g * g
                    self.p[k] = self.p[k] - .01 * (m[k] / (1 - .9**t)) / (np.sqrt(s[k] / (1 - .999**t)) + 1e-8)
        return self.calibrate(self.scores([x[j] for j in np.flatnonzero(held)]), y[held], recall)

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float) -> CharNet:
        """Platt scaling with smoothed targets; of the thresholds with the wanted recall, from an even chance on, the lowest
        of those with the fewest false alarms; the highest with that recall where it lies under an even chance."""
        pos, neg = (y == 1).sum(), (y == 0).sum()
        to = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps on two numbers
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w = p * (1 - p) + 1e-6
            hess = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
            move = np.linalg.solve(hess, np.array([np.sum((to - p) * z) - 1e-3 * (a - 1), np.sum(to - p)]))
            a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
        self.scale, self.shift = float(a), float(b)
        good, plain = np.sort(self.chance(z[y == 1])), self.chance(z[y == 0])
        most = float(good[int(np.floor((1 - recall) * len(good)))])  # beyond it recall is missed
        inside = [min(0.5, most), *np.minimum(plain[(plain >= 0.5) & (plain < most)] + 1e-9, most)]
        self.threshold = min(inside, key=lambda t: (int((plain >= t).sum()), t))
        return self

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))


#: Labelled findings of each kind that the network is trained on at most, and the texts that plain ones are drawn from;
#: below ``FEW`` positives it stays silent.
MAX_FINDINGS, MAX_TEXTS, FEW, EPOCHS, RECALL = 1500, 20_000, 8, 12, 0.95


def may_have_findings(text: Column) -> Column:
    """True where a pattern can match, and elsewhere now and then."""
    low = F.lower(text)
    return reduce(or_, map(low.contains, KEYWORDS), text.contains("AKIA") | text.rlike("[0-9a-f]{%d}" % LEAST["hex"]))


def labelled_findings(docs: DataFrame, most: int = MAX_FINDINGS, texts: int = MAX_TEXTS, text: str = "text") -> list[tuple[int, bytes]]:
    """(label, characters of all windows) of pattern hits and of other candidates, ``most`` of each by smallest hash.

    Hits come from all texts, other candidates from about ``texts`` texts that their hash draws.
    """
    def work(chunk: Chunk) -> dict | None:
        c = Candidates(chunk)
        drawn = columns(chunk)["drawn"].to_numpy(zero_copy_only=False)
        rows = [(1, c.windows(s, e, d)) for s, e, d in c.findings()]
        rows += [(0, c.windows(int(c.start[i]), int(c.end[i]), int(c.doc[i]))) for i in c.plain[drawn[c.doc[c.plain]]]]
        if not rows:
            return None
        raw = [x.tobytes() for _, x in rows]
        order = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "big") for x in raw], np.int64)
        keep = [i for v in (0, 1) for i in sorted((j for j, (y, _) in enumerate(rows) if y == v), key=lambda j: order[j])[:most]]
        return {"y": np.array([rows[i][0] for i in keep], np.int64), "place": order[keep], "x": [raw[i] for i in keep]}

    docs = docs.select(F.col(text).alias("text")).where("text is not null")
    share = min(1.0, texts / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 53)) <= F.lit(int(share * (1 << 53)))
    docs = docs.withColumn("drawn", draw).where(F.col("drawn") | may_have_findings(F.col("text")))
    found = stash(scan(docs, work, "y long, place long, x binary").dropDuplicates(["y", "place"]), "findings")
    out = []
    for v in (1, 0):
        out += [(r.y, bytes(r.x)) for r in found.where(F.col("y") == v).orderBy("place", "x").limit(most).collect()]
    return out


def bare(w: np.ndarray) -> np.ndarray:
    """The windows of a candidate as if it were the whole text."""
    w = w.copy()
    w[0, :BEFORE], w[-1, BEFORE + INSIDE:] = 0, 0
    return w


def train(findings: list[tuple[int, bytes]], epochs: int = EPOCHS, recall: float = RECALL) -> CharNet:
    """The network on labelled findings; plain candidates that a network fitted without them takes for keys are
    unlabelled rather than plain, and left out.

    A finding counts as it stands, with its surroundings taken from a plain candidate, and every other one alone, so
    values are learnt and not only the words before them; every other plain candidate counts alone as well.
    """
    x = [(v, np.frombuffer(b, np.uint8).reshape(-1, WIDTH)) for v, b in findings]
    pos, neg = ([w for v, w in x if v == k] for k in (1, 0))
    if len(pos) < FEW or len(neg) < FEW:
        return CharNet()

    def fit(pos: list[np.ndarray], neg: list[np.ndarray]) -> CharNet:
        r = np.random.default_rng(1)
        moved = [w.copy() for w in pos]
        for w, i in zip(moved, r.integers(0, len(neg), len(pos))):
            w[0, :BEFORE], w[-1, BEFORE + INSIDE:] = neg[i][0, :BEFORE], neg[i][-1, BEFORE + INSIDE:]
        parts = [pos, moved, [bare(w) for w in pos[::2]], neg, [bare(w) for w in neg[::2]]]
        of = np.concatenate([np.arange(len(pos)), np.arange(len(pos)), np.arange(len(pos))[::2], np.arange(len(neg)), np.arange(len(neg))[::2]])
        y = np.repeat([1.0, 1.0, 1.0, 0.0, 0.0], [len(part) for part in parts])
        return CharNet().fit(sum(parts, []), y, epochs, recall, of=of + np.where(y == 1, 0, len(pos)))

    plain = np.ones(len(neg), bool)
    for part in (0, 1):
        out = np.arange(len(neg)) % 2 == part
        net = fit(pos, [neg[i] for i in np.flatnonzero(~out)])
        plain[out] = net.chance(net.scores([neg[i] for i in np.flatnonzero(out)])) < 0.5
    return fit(pos, [neg[i] for i in np.flatnonzero(plain)]) if plain.sum() >= FEW else CharNet()


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = False, **how) -> DataFrame:
    """docs' other columns with RESULT and, with keep_text, the text with all spans masked (``masked``, null for null).

    Spans are code points, end exclusive. Null texts count as empty; an empty text has no spans; repeated rows
    get equal results; with fewer than ``FEW`` labelled findings of a kind the network adds nothing. Columns of docs
    named as the result are replaced, ``masked`` only with keep_text. An empty table gives no rows.
    """
    names = [c.split()[0] for c in RESULT.split(", ")] + ["masked"] * keep_text
    docs = docs.drop(*[c for c in names if c != text])
    net = train(labelled_findings(docs, text=text), **how)
    rest = [c for c in docs.columns if c != text]

    def work(chunk: Chunk) -> dict:
        c = Candidates(chunk)
        added: list[list] = [[] for _ in range(chunk.n)]
        if len(c.free) and net.threshold <= 1:
            for i in c.free[net.chance(c.scores(net, c.free)) >= net.threshold]:
                added[c.doc[i]].append((int(c.at[i][0]), int(c.at[i][1]), "neural"))
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        out = {c_: columns(chunk)[c_] for c_ in rest}
        out |= {f"n_{k}": np.array([sum(x[2] == k for x in b) for b in c.base], np.int64) for k in KINDS[:3]}
        out["base_sha256"] = [hashlib.sha256(line(b).encode()).hexdigest() for b in c.base]
        spans = [sorted(b + a, key=lambda x: (x[0], KINDS.index(x[2]))) for b, a in zip(c.base, added)]
        out["spans"] = [line(x) for x in spans]
        if keep_text:
            null = columns(chunk)[text].is_null().to_numpy(zero_copy_only=False)
            out["masked"] = pa.array([None if null[i] else mask(chunk.text(i), x) if x else chunk.text(i) for i, x in enumerate(spans)], pa.string())
        return out

    return scan(docs, work, with_fields(docs.select(*rest), RESULT + ", masked string" * keep_text), text)


def mask(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with overlapping spans joined and each replaced by the mark."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

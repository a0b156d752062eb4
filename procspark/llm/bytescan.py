"""Words and word-run hashes of whole text columns, by array operations on UTF-8 bytes.

Texts come as Arrow batches and are worked on in chunks of about ``CHUNK`` bytes (one text
at least, however long), so memory follows the longest text and not the batch. Every word
rule used here treats all bytes from 0x80 as word bytes, so bytes and code points agree on
where words start and end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK = 2_000_000
U64 = np.uint64

_BYTES = np.arange(256)
#: Runs of digits, ASCII letters and everything from 0x80.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (
    (_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Runs of anything but space and 0x09-0x0D.
BLANK_SPLIT = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
KEEP_CASE = _BYTES.astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, U64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


@lru_cache(maxsize=4)
def _values(lower: bool) -> np.ndarray:
    return stream(1, 256)[LOWER if lower else KEEP_CASE]


class Chunk:
    """Some texts of a batch as one byte array; text i is ``data[offsets[i]:offsets[i+1]]``."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def words(self, kind: np.ndarray = ALNUM, lower: bool = True) -> Words:
        return Words(self, kind, lower)

    @cached_property
    def edge(self) -> np.ndarray:
        """True at the first byte of every text."""
        at = np.zeros(len(self.data) + 1, bool)
        at[self.offsets] = True
        return at[:-1]


class Words:
    """The words of a chunk: byte ranges, text numbers and 64-bit hashes, in order."""

    def __init__(self, chunk: Chunk, kind: np.ndarray, lower: bool):
        self.chunk, self.lower = chunk, lower
        inside = kind[chunk.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | chunk.edge[1:]
        last[:-1] &= ~inside[1:] | chunk.edge[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, chunk.offsets)  # words of text i: bounds[i]:bounds[i+1]
        self.doc = np.repeat(np.arange(chunk.n), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def hashes(self) -> np.ndarray:
        data = self.chunk.data
        up, down = _Powers.of(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_values(self.lower)[data] * up[:-1], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(U64))

    def word(self, i: int) -> bytes:
        b = self.chunk.data[self.start[i]:self.end[i]]
        return (LOWER[b] if self.lower else b).tobytes()

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; valid where ``whole(k)``."""
        return run_hashes(self.hashes, k)

    def whole(self, k: int) -> np.ndarray:
        """True where the k words from there on belong to one text."""
        if len(self) < k:
            return np.zeros(0, bool)
        return self.doc[: len(self) - k + 1] == self.doc[k - 1:]


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    odd = stream(7, k) | U64(1)
    out = np.full(n, U64(k))
    for j in range(k):
        out = out + h[j:j + n] * odd[j]
    return mix(out)


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, as a chunk of them would give."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    chunk = Chunk(None, data, np.cumsum([0, *map(len, raw)]))
    return Words(chunk, np.ones(256, bool), True).hashes


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[Chunk]:
    """Null texts are empty. Rows of a chunk keep their order; ``rows`` has all columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        _, offsets, data = col.buffers()
        ends = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
            yield Chunk(batch.slice(at, to - at), data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            at = to


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed longs with the same bits."""
    return h.view(np.int64)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df followed by the fields of ddl."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def columns(chunk: Chunk) -> dict:
    """The columns of a chunk by name, to be returned along."""
    return dict(zip(chunk.rows.schema.names, chunk.rows.columns))


def scan(df: DataFrame, work: Callable[[Chunk], dict | None], schema, text: str = "text") -> DataFrame:
    """Apply ``work`` to the chunks of df; it returns columns by name, in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for chunk in chunks(batches, text):
                out = work(chunk)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)

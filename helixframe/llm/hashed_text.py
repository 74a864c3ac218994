"""Hashed presence features of whole texts, shared by the trained operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.licenses import words_of
from helixframe.llm.nested import identifier

BUCKETS = 1 << 20
STEMS = (4, 5)
_CACHED, _LONGEST_CACHED = 200_000, 48


def held_out(ident: Column) -> Column:
    """The fold that training never sees: CRC-32 of the identifier's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bucket(token: bytes) -> int:
    return zlib.crc32(token) & (BUCKETS - 1)


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its stems of a few bytes."""
    return (bucket(word), *(bucket(b"^" + word[:n]) for n in STEMS if len(word) > n))


def shape_buckets(text: str, words: list[bytes]) -> list[int]:
    """Buckets of what a text looks like: its length, repetition, signs, and lines, in coarse steps."""
    n, size = len(words), max(len(text), 1)
    signs = sum(text.count(c) for c in "#*$%&|<>{}=_@")
    shapes = {
        "words": min(int(np.log2(n + 1)), 20),
        "distinct": int(10 * len(set(words)) / max(n, 1)),
        "signs": min(int(np.log2(1 + 1000 * signs / size)), 10),
        "digits": min(int(np.log2(1 + 1000 * sum(text.count(c) for c in "0123456789") / size)), 10),
        "length": min(int(size / max(n, 1)), 20),
        "lines": min(int(np.log2(1 + 1000 * text.count("\n") / size)), 10),
    }
    return [bucket(f"={k}:{v}".encode()) for k, v in shapes.items()]


class Cache(dict):
    """word -> its buckets among ``chosen`` (all if none given); bounded in entries."""

    def __init__(self, chosen: frozenset[int] | None = None) -> None:
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = word_buckets(word)
        if self.chosen is not None:
            found = tuple(b for b in found if b in self.chosen)
        if len(word) <= _LONGEST_CACHED:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = found
        return found


def present(text: str, cache: Cache, shape: bool) -> set[int]:
    words = words_of(text.encode())
    out: set[int] = set()
    for found in map(cache.__getitem__, set(words)):
        if found:
            out.update(found)
    if shape:
        out.update(b for b in shape_buckets(text, words) if cache.chosen is None or b in cache.chosen)
    return out


def feature_rows(rows: DataFrame, text: str, keep: list[str], shape: bool) -> DataFrame:
    """``keep`` and ``features`` (sorted buckets) of a bounded training sample."""
    kinds = {k: identifier(rows, k) for k in keep}
    schema = pa.schema([*((k, kinds[k][1]) for k in keep), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache()
        for batch in batches:
            found = [sorted(present(t.as_py() or "", cache, shape)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return rows.select(*keep, text).mapInArrow(run, ", ".join(f"{k} {kinds[k][0]}" for k in keep) + ", features array<int>")


def gathered(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and features of a training sample (identifier, label, features), in the order of both; taken as Arrow buffers."""
    table = rows.toArrow()
    ids, labels = (table.column(i).to_numpy() for i in (0, 1))
    features: list[np.ndarray] = []
    for chunk in table.column(2).chunks:
        if len(chunk):
            cuts = chunk.offsets.to_numpy()
            features += np.split(chunk.flatten().to_numpy(), cuts[1:-1] - cuts[0])
    order = sorted(range(len(ids)), key=lambda i: (ids[i], features[i].tobytes()))
    return labels[order], [features[i] for i in order]


class Matrix:
    """Rows of present features, renumbered to the ``chosen`` buckets."""

    def __init__(self, rows: Iterable[Iterable[int]], chosen: np.ndarray) -> None:
        lists = [np.asarray(r, np.int64) for r in rows]
        sizes = np.array([len(r) for r in lists], np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        at = np.searchsorted(chosen, flat)
        fits = (at < len(chosen)) & (chosen[np.minimum(at, max(len(chosen) - 1, 0))] == flat) if len(chosen) else np.zeros(len(flat), bool)
        self.rows = np.repeat(np.arange(len(lists)), sizes)[fits]
        self.columns, self.n, self.width = at[fits], len(lists), len(chosen)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, g[self.rows], self.width)


def choose(groups: list[list[np.ndarray]], most: int, least_z: float, least_lift: float = 1.0) -> np.ndarray:
    """Buckets whose presence differs most between a group and the others, by z score.

    ``least_lift``: the presence rates must differ by this factor at least. A bucket counts
    for the group in which it is more frequent, if 1 % of its rows and two rows hold it.
    """
    counts = [np.bincount(np.concatenate(g) if g else np.zeros(0, np.int64), minlength=BUCKETS).astype(float) for g in groups]
    sizes = [max(len(g), 1) for g in groups]
    best = np.zeros(BUCKETS)
    for i in range(len(groups)):
        rest, m = sum(counts[:i] + counts[i + 1 :]), sum(sizes[:i] + sizes[i + 1 :])
        p = (counts[i] + rest + 1) / (sizes[i] + m + 2)
        z = np.abs(counts[i] / sizes[i] - rest / m) / np.sqrt(p * (1 - p) * (1 / sizes[i] + 1 / m))
        own, other = (counts[i] + 0.5) / (sizes[i] + 1), (rest + 0.5) / (m + 1)
        fine = (own > other) & (counts[i] >= max(2, 0.01 * sizes[i])) & (np.maximum(own / other, other / own) >= least_lift)
        best = np.maximum(best, np.where(fine, z, 0))
    order = np.argsort(-best, kind="stable")[:most]
    return np.sort(order[best[order] >= least_z])


def adam(width: int, gradient, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam from zero; ``gradient(w)`` of a vector of ``width``."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w

"""Counting on packed k-mers: reads become blocks of sorted numbers, and blocks that meet in a bucket become graph rows.

A k-mer of 2k bits is multiplied by an odd number (one to one); its upper bits are its bucket. A record is the rest of it
and a code: what an occurrence adds to coverage and edges. A block holds the records of one bucket as differences of
sorted numbers with their counts, some five bytes each, so the one shuffle is small and no bucket is hot. Whole
buckets are summed, few at a time, so memory follows a bucket (a 4096th of the k-mers), never a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES, LARGEST

#: bits of a bucket and of a code; records sorted at once; windows cut at once; records from which buckets are summed; rows of a batch
PREFIX, CODE, FLUSH, CUT, TOGETHER, ROWS = 12, 6, 1 << 22, 1 << 20, 1 << 18, 1 << 15
BLOCKS = "bucket int, first long, n int, steps binary, counts binary"
COUNTED = ["cov", *[f"fw{i}" for i in range(4)], *[f"bw{i}" for i in range(4)]]
GRAPH = "key string, " + ", ".join(f"{c} long" for c in COUNTED)
ODD, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
NUMBER = np.full(256, 4, np.uint8)
NUMBER[[ord(b) for b in BASES + BASES.lower()]] = [0, 1, 2, 3] * 2
TURNED = np.array([3, 2, 1, 0, 4], np.uint8)
#: codes 0 to 24: an occurrence with forward base code // 5 and backward base code % 5 (4: none); 25 to 32: that edge alone
FORWARD_OF = np.array([c // 5 if c < 25 else c - 25 if c < 29 else 4 for c in range(33)], np.uint8)
BACKWARD_OF = np.array([c % 5 if c < 25 else c - 29 if c >= 29 else 4 for c in range(33)], np.uint8)
LETTERS = np.frombuffer(BASES.encode(), np.uint8)
TUPLE = 6
TUPLES = LETTERS[(np.arange(4**TUPLE)[:, None] >> (2 * np.arange(TUPLE)[::-1])) & 3]


def _u(x: int) -> np.uint64:
    return np.uint64(x & ALL)


def mixed(keys: np.ndarray, k: int) -> np.ndarray:
    return (keys * _u(ODD)) & _u((1 << 2 * k) - 1)


def unmixed(keys: np.ndarray, k: int) -> np.ndarray:
    return (keys * _u(pow(ODD, -1, 1 << 64))) & _u((1 << 2 * k) - 1)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column without nulls, and where its values begin and end."""
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def numbers(column: pa.Array, k: int) -> np.ndarray:
    """K-mers of A, C, G, T as numbers."""
    own = NUMBER[_strings(column)[0].reshape(-1, k)]
    out = np.zeros(len(own), np.uint64)
    for i in range(k):
        out = (out << _u(2)) | own[:, i]
    return out


def turned(keys: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(keys)
    for i in range(k):
        out = (out << _u(2)) | (((keys >> _u(2 * i)) & _u(3)) ^ _u(3))
    return out


def texts(keys: np.ndarray, k: int) -> pa.Array:
    out = np.empty((len(keys), k), np.uint8)
    for first in range(0, k, TUPLE):
        size = min(TUPLE, k - first)
        out[:, first : first + size] = TUPLES[(keys >> _u(2 * (k - first - size))) & _u(4**size - 1), TUPLE - size :]
    at = np.arange(0, len(keys) * k + 1, k, dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(out)])


def _strands(own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of base numbers, and its reverse complement: windows of doubled lengths, joined by the bits of k."""
    f = (own & 3).astype(np.uint64)
    r, m, out, length = f ^ _u(3), 1, None, 0
    while True:
        if k & 1:
            if out is None:
                out = f, r
            else:
                n = len(out[0]) - m
                out = (out[0][:n] << _u(2 * m)) | f[length : length + n], (r[length : length + n] << _u(2 * length)) | out[1][:n]
            length += m
        k >>= 1
        if not k:
            return out
        n = len(f) - m
        f, r = (f[:n] << _u(2 * m)) | f[m : m + n], (r[m : m + n] << _u(2 * m)) | r[:n]
        m *= 2


def occurrences(data: np.ndarray, k: int, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(mixed canonical k-mers, codes) of sequences that each end in a byte which is no base."""
    whole = np.concatenate([np.array([4], np.uint8), NUMBER[data]])
    for a in range(1, len(whole), CUT):
        piece = whole[a - 1 : a + CUT + k]
        inner = piece[1:-1]
        if len(inner) < k:
            continue
        breaks = np.zeros(len(inner) + 1, np.int32)
        np.cumsum(inner > 3, out=breaks[1:])
        at = np.flatnonzero(breaks[k:] == breaks[:-k])
        f, r = _strands(inner, k)
        f, r = f[at], r[at]
        if keep is not None:
            kept = keep(f, np.minimum(f, r))
            at, f, r = at[kept], f[kept], r[kept]
        left, right, straight = piece[at], piece[at + k + 1], f <= r
        code = np.where(straight, right, TURNED[left]) * np.uint8(5) + np.where(straight, left, TURNED[right])
        yield mixed(np.minimum(f, r), k), code


def _width(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)


def blocks(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray | None, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of records; without ``counts`` each counts one."""
    if not len(keys):
        return
    low = 2 * k - min(PREFIX, 2 * k)
    if 2 * k + CODE <= 64:
        v = (keys << _u(CODE)) | codes
        if counts is None:
            v.sort()
        else:
            order = np.argsort(v)
            v, counts = v[order], counts[order]
        bucket, v = v >> _u(low + CODE), v & _u((1 << low + CODE) - 1)
    else:
        bucket, v = keys >> _u(low), ((keys & _u((1 << low) - 1)) << _u(CODE)) | codes
        order = np.lexsort((v, bucket))
        bucket, v, counts = bucket[order], v[order], None if counts is None else counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (bucket[1:] != bucket[:-1])]))
    counts = np.diff(np.append(starts, len(v))) if counts is None else np.add.reduceat(counts, starts)
    counts, v, bucket = counts.astype(np.uint64), v[starts], bucket[starts]
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    steps = np.concatenate([[_u(0)], v[1:] - v[:-1]])
    steps[begins] = 0
    ends, found = np.append(begins[1:], len(v)), []
    widths = [(_width(s), _width(c)) for s, c in zip(np.maximum.reduceat(steps, begins), np.maximum.reduceat(counts, begins), strict=True)]
    s, c = steps.view(np.uint8).reshape(-1, 8), counts.view(np.uint8).reshape(-1, 8)
    for a, b, (ws, wc) in zip(begins.tolist(), ends.tolist(), widths, strict=True):
        found.append((s[a:b, :ws].T.tobytes(), c[a:b, :wc].T.tobytes()))
    own = [pa.array(bucket[begins].astype(np.int32)), pa.array(v[begins].astype(np.int64)), pa.array((ends - begins).astype(np.int32)), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())]
    batch = pa.RecordBatch.from_arrays(own, names=["bucket", "first", "n", "steps", "counts"])
    for i in range(0, len(batch), 512):
        yield batch.slice(i, 512)


def _plane(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view(np.uint64).ravel()


def _records(bucket: int, first: int, n: int, steps: bytes, counts: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mers, codes and counts of a block."""
    v = np.cumsum(_plane(steps, n)) + _u(first)
    rest = _u(bucket << (2 * k - min(PREFIX, 2 * k))) | (v >> _u(CODE))
    return unmixed(rest, k), (v & _u((1 << CODE) - 1)).astype(np.uint8), _plane(counts, n).astype(np.int64)


def rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Graph rows of whole buckets, in the order of their keys."""
    key, code, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    key, code, c = key[order], code[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, forward, backward = key[starts], FORWARD_OF[code], BACKWARD_OF[code]
    sums = [np.add.reduceat(c * (code < 25), starts)]
    sums += [np.add.reduceat(c * (own == i), starts) for own in (forward, backward) for i in range(4)]
    sums = [np.minimum(x, LARGEST) for x in sums]
    for i in range(0, len(key), ROWS):
        yield pa.RecordBatch.from_arrays([texts(key[i : i + ROWS], k), *[pa.array(x[i : i + ROWS]) for x in sums]], names=["key", *COUNTED])


class Only:
    """Keeps the k-mers of a sorted list: a table of hashes first, then the list itself."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.near = Infixes([(keys, 32)])

    def __call__(self, _: np.ndarray, key: np.ndarray) -> np.ndarray:
        kept = self.near.has(key, 32)
        at = np.flatnonzero(kept)
        if len(at):
            spot = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            kept[at] = self.keys[spot] == key[at]
        return kept


class Infixes:
    """Bits of hashed (length, bases): what was put in is found, and little else."""

    def __init__(self, sets: list[tuple[np.ndarray, int]]) -> None:
        n = sum(len(x) for x, _ in sets)
        self.bits = max(10, (8 * n).bit_length(), min((256 * n).bit_length(), 26))  # 8 MB, or more where 8 bits an entry need it
        flags = np.zeros(1 << self.bits, bool)
        for values, j in sets:
            flags[self._spot(values, j)] = True
        self.table = np.packbits(flags, bitorder="little")

    def _spot(self, values: np.ndarray, j) -> np.ndarray:
        own = (values + np.asarray(j, np.uint64) * _u(0xC2B2AE3D27D4EB4F)) * _u(ODD)
        own ^= own >> _u(32)
        return (own * _u(0xD6E8FEB86659FD93)) >> _u(64 - self.bits)

    def has(self, values: np.ndarray, j) -> np.ndarray:
        spot = self._spot(values, j)
        return ((self.table[spot >> _u(3)] >> (spot & _u(7)).astype(np.uint8)) & 1).astype(bool)


class Walked:
    """Keeps every k-mer on a walk of at most ``steps`` steps between k-mers of the assembly.

    ``i`` steps after one such k-mer it begins with that one's last k - i bases, and ``steps`` - i before another it ends
    with the other's first: together its longest beginning and its longest end within the assembly have 2k - ``steps``
    bases. Some others pass too.
    """

    def __init__(self, known: Infixes, k: int, steps: int) -> None:
        self.known, self.k, self.need = known, k, 2 * k - steps

    def _longest(self, kmers: np.ndarray, begins: bool) -> np.ndarray:
        lo, hi = np.zeros(len(kmers), np.uint64), np.full(len(kmers), self.k, np.uint64)
        for _ in range(self.k.bit_length()):
            open_, mid = lo < hi, np.maximum((lo + hi + _u(1)) >> _u(1), _u(1))
            part = kmers >> (_u(2) * (_u(self.k) - mid)) if begins else kmers & (_u(ALL) >> (_u(64) - _u(2) * mid))
            there = self.known.has(part, mid)
            lo, hi = np.where(open_ & there, mid, lo), np.where(open_ & ~there, mid - _u(1), hi)
        return lo

    def __call__(self, kmers: np.ndarray, _: np.ndarray) -> np.ndarray:
        half = -(-self.need // 2)
        kept = self.known.has(kmers >> _u(2 * (self.k - half)), half) | self.known.has(kmers & _u((1 << 2 * half) - 1), half)
        at = np.flatnonzero(kept)
        kept[at] = self._longest(kmers[at], True) + self._longest(kmers[at], False) >= self.need
        return kept


class Reached:
    """Keeps every k-mer at most ``steps`` steps along either strand from one of the assembly: it begins or ends with k - ``steps`` of its bases."""

    def __init__(self, known: Infixes, k: int, steps: int) -> None:
        self.known, self.k, self.steps = known, k, steps

    def __call__(self, kmers: np.ndarray, _: np.ndarray) -> np.ndarray:
        size = self.k - self.steps
        return self.known.has(kmers >> _u(2 * self.steps), size) | self.known.has(kmers & _u((1 << 2 * size) - 1), size)


class Within:
    """Keeps every k-mer at most ``steps`` steps, in either direction, from one of the assembly: both share k - ``steps`` bases."""

    def __init__(self, known: Infixes, k: int, steps: int) -> None:
        self.known, self.k, self.steps = known, k, steps

    def __call__(self, kmers: np.ndarray, _: np.ndarray) -> np.ndarray:
        size = self.k - self.steps
        kept = np.zeros(len(kmers), bool)
        for shift in range(self.steps + 1):
            kept |= self.known.has((kmers >> _u(2 * shift)) & _u((1 << 2 * size) - 1), size)
        return kept


def collected(keys: DataFrame, k: int) -> np.ndarray:
    """The k-mers of A, C, G, T in a bounded table, as numbers."""
    found = keys.select("key").where(F.col("key").rlike(f"^[ACGT]{{{k}}}$")).toArrow().column("key").combine_chunks()
    return numbers(found, k) if len(found) else np.zeros(0, np.uint64)


def around(keys: DataFrame, k: int, *, walk: int | None = None, reach: int | None = None, within: int | None = None) -> Walked | Reached | Within | None:
    """Keeps what lies near the bounded table ``keys``; None where that could be any k-mer."""
    steps = next(x for x in (walk, reach, within) if x is not None)
    if steps >= (k if walk is None else 2 * k):
        return None
    own = collected(keys, k)
    own = np.unique(np.concatenate([own, turned(own, k)]))
    sizes = range(1, k + 1) if walk is not None else [k - steps]
    known = Infixes([(np.unique(own >> _u(2 * (k - j))), j) for j in sizes] + ([(np.unique(own & _u((1 << 2 * j) - 1)), j) for j in sizes]))
    return (Walked if walk is not None else Reached if reach is not None else Within)(known, k, steps)


def partial(reads: DataFrame, k: int, sequence: str = "sequence", keep=None) -> DataFrame:
    """Blocks of the k-mers of ``reads``, each task's counted as far as it holds them at once."""
    held = reads.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches):
        keys, codes, n = [], [], 0
        for batch in batches:
            for key, code in occurrences(_strings(batch.column(0))[0], k, held.value if held else None):
                keys.append(key)
                codes.append(code)
                n += len(key)
                if n >= FLUSH:
                    yield from blocks(np.concatenate(keys), np.concatenate(codes), None, k)
                    keys, codes, n = [], [], 0
        if n:
            yield from blocks(np.concatenate(keys), np.concatenate(codes), None, k)

    return reads.select(F.concat(F.coalesce(F.col(sequence), F.lit("")), F.lit("N")).alias("s")).mapInArrow(run, BLOCKS)


def of_graph(dbg: DataFrame, k: int) -> DataFrame:
    """Blocks of a graph: its coverage, and each of its edges, with their counts."""

    def run(batches):
        for batch in batches:
            key, counts = mixed(numbers(batch.column(0), k), k), [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(9)]
            at = [(np.flatnonzero(c), code) for c, code in zip(counts, [24, *range(25, 33)], strict=True)]
            codes = np.concatenate([np.full(len(a), code, np.uint8) for a, code in at])
            yield from blocks(key[np.concatenate([a for a, _ in at])], codes, np.concatenate([c[a] for c, (a, _) in zip(counts, at, strict=True)]), k)

    return dbg.select("key", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in COUNTED]).mapInArrow(run, BLOCKS)


def total(parts: DataFrame, k: int) -> DataFrame:
    """The graph of all blocks: one shuffle, then whole buckets; counts saturate."""

    def run(batches):
        now, held, n = None, [], 0
        for batch in batches:
            for bucket, *block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and n >= TOGETHER:
                    yield from rows(held, k)
                    held, n = [], 0
                now, n = bucket, n + block[1]
                held.append(_records(bucket, *block, k))
        if held:
            yield from rows(held, k)

    return parts.select("bucket", "first", "n", "steps", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, GRAPH)

"""Sequence packing by non-negative least squares over length combinations.

Documents become ids and are cut at whole windows; each leaves at most one remainder. The
histogram of remainder lengths has fewer bins than a window has tokens, so the driver plans on
it alone: it enumerates pairs and triples of lengths that fill a window exactly, solves the repeat
counts by non-negative least squares against the histogram, rounds them down, and packs
what is left greedily, largest first. A gap of ``grid`` tokens or more is filled by cutting the
largest remainder at a multiple of ``grid``, so every window but the last is padded by less
than ``grid`` tokens. The plan names rank ranges of each length; remainders get
gapless ranks in their length and are placed by a join with the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.nested import identifier
from helixframe.llm.ranks import spread_rank
from helixframe.llm.store import materialise
from helixframe.llm.tokens import shared_encoder

WINDOW, GRID, END_ID = 2048, 16, 1
#: candidates of the least squares: all pairs, and the triples of the largest possible repeats. Fewer cost padding at most: what
#: no candidate takes is packed by the greedy rest
COMBINATIONS, SWEEPS = 20_000, 12
PLAN_COLUMNS = "p_length long, p_low long, p_high long, p_start long, p_take long, p_sequence long, p_each long, p_offset long"


def document_pieces(packed: bytes, window: int, grid: int) -> list[tuple[int, int, int, bytes]]:
    """(start, length, crc32, prefix crc32s at multiples of ``grid``) of a document's window-sized pieces."""
    out, view, total = [], memoryview(packed), len(packed) // 4
    for start in range(0, total, window):
        own = view[4 * start : 4 * min(total, start + window)]
        length = len(own) // 4
        if length == window:
            out.append((start, length, zlib.crc32(own), b""))
            continue
        crc, sums = 0, []
        for at in range(0, 4 * length, 4 * grid):
            sums.append(crc)
            crc = zlib.crc32(own[at : at + 4 * grid], crc)
        out.append((start, length, crc, np.array(sums, "<u4").tobytes()))
    return out


def tokenised(docs: DataFrame, text: str, ident: str, window: int, grid: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, crc, sums, doc_tokens, text_hash): the window-sized pieces of every document's ids."""
    kind, arrow_kind = identifier(docs, ident)
    schema = f"doc_id {kind}, start long, length long, crc long, sums binary, doc_tokens long, text_hash long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, arrow_kind if n == "doc_id" else pa.binary() if n in ("sums", "ids") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, owner = [], []
            for at, (text_, hash_) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                packed = encoder.packed(text_.as_py() or "") + end
                for start, length, crc, sums in document_pieces(packed, window, grid):
                    owner.append(at)
                    rows.append((start, length, crc, sums, len(packed) // 4, hash_) + ((packed[4 * start : 4 * (start + length)],) if with_ids else ()))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *arrays], schema=arrow)

    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), hashed.alias("text_hash")).mapInArrow(run, schema)


def combinations(counts: np.ndarray, window: int, most: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that sum to ``window``; of the triples the ``most`` with the largest least count."""
    have = np.flatnonzero(counts)
    out = [(int(a), int(window - a)) for a in have if a <= window - a and counts[window - a]]
    a, b = np.meshgrid(have, have, indexing="ij")
    c = window - a - b
    fine = (a <= b) & (b <= c)
    a, b, c = a[fine], b[fine], c[fine]
    value = np.minimum(np.minimum(counts[a], counts[b]), counts[c])
    best = np.argsort(-value, kind="stable")[:most]
    best = best[value[best] > 0]
    return out + list(zip(a[best].tolist(), b[best].tolist(), c[best].tolist(), strict=True))


def solve_repeats(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int) -> list[float]:
    """Minimise |A x - counts| over x >= 0 by coordinate descent; A has a column a combination."""
    rest = counts.astype(float).tolist()
    x = [0.0] * len(combos)
    norms = [sum(combo.count(v) for v in combo) for combo in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, combo in enumerate(combos):
            step = sum(rest[v] for v in combo) / norms[j]
            step = max(step, -x[j])
            if step > 1e-9 or step < -1e-9:
                x[j] += step
                moved += abs(step)
                for v in combo:
                    rest[v] -= step
        if moved < 0.5:
            break
    return x


class _Stock:
    """What is left to pack: by length, queues of (origin length, start, low rank, high rank)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.queues = {int(v): deque([(int(v), 0, 0, int(counts[v]))]) for v in np.flatnonzero(counts)}
        self.lengths = sorted(self.queues)

    def head(self, length: int) -> int:
        queue = self.queues.get(length)
        return queue[0][3] - queue[0][2] if queue else 0

    def take(self, length: int, n: int) -> tuple[int, int, int]:
        """(origin length, start, low rank) of ``n`` remainders from the first range."""
        origin, start, low, high = self.queues[length].popleft()
        if low + n < high:
            self.queues[length].appendleft((origin, start, low + n, high))
        elif not self.queues[length]:
            del self.queues[length]
            self.lengths.remove(length)
        return origin, start, low

    def put(self, length: int, item: tuple[int, int, int, int]) -> None:
        if length not in self.queues:
            self.queues[length] = deque()
            self.lengths = sorted([*self.lengths, length])
        self.queues[length].append(item)

    def largest(self, most: int) -> int:
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0


def packing_plan(counts: np.ndarray, window: int = WINDOW, grid: int = GRID, combos: int = COMBINATIONS, sweeps: int = SWEEPS) -> list[tuple[int, ...]]:
    """Rows of PLAN_COLUMNS for a histogram of lengths 0..window."""
    stock, plan, sequence = _Stock(counts), [], 0
    inner = counts.copy()
    inner[window:] = 0
    if n := int(counts[window]):
        stock.take(window, n)
        plan.append((window, 0, n, 0, window, sequence, 1, 0))
        sequence += n
    found = combinations(inner, window, combos)
    repeats = solve_repeats(inner, found, sweeps)
    for j in sorted(range(len(found)), key=lambda j: -repeats[j]):
        need = {v: found[j].count(v) for v in found[j]}
        times = min([int(repeats[j] + 1e-6), *(stock.head(v) // k for v, k in need.items())])
        if times < 1:
            continue
        offset = 0
        for v, k in need.items():
            origin, start, low = stock.take(v, k * times)
            plan.append((origin, low, low + k * times, start, v, sequence, k, offset))
            offset += k * v
        sequence += times
    while stock.lengths:
        # one window at first, then as often as the ranges in use allow
        gap, parts, used = window, [], {}
        v = stock.largest(gap)
        while v:
            if k := min(gap // v, stock.head(v) - used.get(v, 0)):
                parts.append((v, k))
                used[v] = used.get(v, 0) + k
                gap -= k * v
            v = stock.largest(min(gap, v - 1))
        cut = gap // grid * grid
        big = next((v for v in reversed(stock.lengths) if v > cut and stock.head(v) > used.get(v, 0)), 0) if cut else 0
        if big:
            used[big] = used.get(big, 0) + 1
        times = min(stock.head(v) // k for v, k in used.items())
        offset = 0
        for v, k in parts:
            origin, start, low = stock.take(v, k * times)
            plan.append((origin, low, low + k * times, start, v, sequence, k, offset))
            offset += k * v
        if big:
            origin, start, low = stock.take(big, times)
            plan.append((origin, low, low + times, start, cut, sequence, 1, offset))
            stock.put(big - cut, (origin, start + cut, low, low + times))
        sequence += times
    return plan


def shift_table(window: int) -> np.ndarray:
    """Row n: what CRC-32 makes of each bit of a sum when n ids of zero bits follow."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table[i] = c
    table = np.array(table, np.uint32)
    rows = np.empty((window + 1, 32), np.uint32)
    rows[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(1, window + 1):
        c = rows[n - 1]
        for _ in range(4):
            c = c >> np.uint32(8) ^ table[c & np.uint32(255)]
        rows[n] = c
    return rows


def cut_crc(head: np.ndarray, whole: np.ndarray, take: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of the last ``take`` ids of a prefix with sum ``whole``, whose part before has sum ``head``."""
    out, moved = whole.copy(), table[take]
    for bit in range(32):
        out ^= moved[:, bit] * (head >> np.uint32(bit) & np.uint32(1))
    return out


def pack(
    docs: DataFrame, *, text: str = "text", ident: str = "doc_id", window: int = WINDOW, grid: int = GRID, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    Null texts are empty; every document ends with id 1, so an empty one is a piece of one
    id. Identifiers keep their type, nulls too. Repeated rows are packed each on their own, and rows of one
    identifier with different texts too. An empty table gives no pieces. Further columns are not carried. ``vocabulary``: a tiktoken rank file of
    the byte-level BPE. ``with_ids`` adds the packed ids of each piece as ``ids``.
    """
    if window % grid:
        raise ValueError("window must be a multiple of grid")
    spark = docs.sparkSession
    pieces = materialise(tokenised(docs, text, ident, window, grid, vocabulary, with_ids), "pack-pieces")
    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    plan = spark.createDataFrame(packing_plan(counts, window, grid), PLAN_COLUMNS)
    # pieces that agree in all of these are copies of one row: which of them takes which place doesn't matter
    ranked = spread_rank(pieces, "length", ["doc_id", "start", "text_hash", "crc", "doc_tokens"], "rank")
    placed = ranked.join(
        F.broadcast(plan),  # rows: a few times `window`, whatever the input
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_low")) & (F.col("rank") < F.col("p_high")),
    )
    nth = F.col("rank") - F.col("p_low")
    placed = placed.select(
        "doc_id",
        "start",
        "length",
        "crc",
        "sums",
        "doc_tokens",
        *(["ids"] if with_ids else []),
        "p_start",
        "p_take",
        (F.col("p_sequence") + F.floor(nth / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + nth % F.col("p_each") * F.col("p_take")).cast("long").alias("offset"),
    )
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind, arrow_kind = identifier(docs, ident)
    arrow = pa.schema([("doc_id", arrow_kind), *((n, pa.int64()) for n in names)] + ([("ids", pa.binary())] if with_ids else []))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shift_table(window)
        for batch in batches:
            get = {n: batch.column(n) for n in batch.schema.names}
            first, take, length = (get[n].to_numpy() for n in ("p_start", "p_take", "length"))
            crc = get["crc"].to_numpy().astype(np.uint32)
            cut = np.flatnonzero(take < length)
            if len(cut):
                sums = [np.frombuffer(get["sums"][int(i)].as_py(), "<u4") for i in cut]
                last = (first + take)[cut]
                head = np.array([s[a // grid] for s, a in zip(sums, first[cut], strict=True)], np.uint32)
                tail = np.array([s[b // grid] if b < n else w for s, b, n, w in zip(sums, last, length[cut], crc[cut], strict=True)], np.uint32)
                crc[cut] = cut_crc(head, tail, take[cut], table)
            columns = [get["doc_id"], pa.array(get["start"].to_numpy() + first), pa.array(take), pa.array(crc.astype(np.int64)), get["doc_tokens"], get["sequence_id"], get["offset"]]
            if with_ids:
                columns.append(pa.array([x.as_py()[4 * a : 4 * (a + n)] for x, a, n in zip(get["ids"], first.tolist(), take.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return placed.mapInArrow(finish, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + (", ids binary" if with_ids else ""))

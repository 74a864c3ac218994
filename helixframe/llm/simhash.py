"""SimHash near-duplicates through vantage-point trees of the fingerprints.

Equal fingerprints are one point. A vantage-point tree splits points by their Hamming distance from one of
them: by the triangle inequality the distances of a linked pair differ by at most the radius, so the
inner branch takes the points up to a boundary and the outer branch those above the boundary less the
radius. Both hold the points between, so every linked pair lies in one branch at least.

*Shards.* In 64-bit space most distances from any vantage point lie within 32 +- 4, so a split leaves about 0.65 of
the points in each branch and repeats 0.3 of them: a tree of n points down to leaves of m costs about
n (n / m) ** 0.55 rows. So that this never acts on all n points, a pre-filter first cuts the space into cells: two
fingerprints within ``radius`` bits agree on one of ``radius + 1`` blocks of bits (or on several of more blocks), and a
cell holds the points that agree on the leading bits of a choice of blocks. It uses as few bits as leave about ``CELL``
points a cell; few points have one cell, the whole space. The filter loses no pair.

*Large cells.* A cell above ``leaf`` points is split by vantage points as distributed joins until its branches fit. Points so
close together that no vantage point parts them meet at flipped copies instead (``_meetings``), in rows proportional to the points.

*Tree.* Inside a shard one task builds the tree down to ``SMALL`` points and returns a spanning forest of the exact
links, so a group of n copies gives at most n - 1 links a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.components import connected_components
from helixframe.llm.nested import ROW, identifier, nested, own, unnested
from helixframe.llm.store import materialise

SEED, WORDS, RADIUS = 42, 3, 3
LEAF, CELL, SMALL = 20_000, 512, 32
SHRUNK = 0.9


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the ``words``-word shingles of UTF-8 ``text``."""
    import xxhash

    found = text.lower().split()
    n = len(found)
    if n < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED) if n else 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, n) - 1)[: n - words + 1].tolist()
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 16
    stops = (ends[words - 1 :] - 1).tolist()
    for at in range(0, len(starts), step):  # bounded memory on very long texts
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + step], stops[at : at + step], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed long; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), _text_hash(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {identifier(docs, ident)[0]}, text_hash long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class _Forest:
    """Union-find over point numbers; a root is the smallest of its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def _close_pairs(points: np.ndarray, index: np.ndarray, forest: _Forest, radius: int) -> None:
    """Join all pairs of ``index`` within ``radius``, in square pieces of bounded size."""
    own, step = points[index], 256
    for i in range(0, len(index), step):
        for j in range(i, len(index), step):
            a, b = np.nonzero(np.bitwise_count(own[i : i + step, None] ^ own[None, j : j + step]) <= radius)
            apart = a + i < b + j
            for x, y in zip(index[a[apart] + i].tolist(), index[b[apart] + j].tolist(), strict=True):
                forest.join(x, y)


def link_shard(points: np.ndarray, radius: int, leaf: int = SMALL, visited: list[int] | None = None) -> np.ndarray:
    """Labels of the components of ``points`` under exact links within ``radius``, by a vantage-point tree.

    A branch that no vantage point makes smaller is compared pair by pair, in bounded memory.
    ``visited`` takes the sizes of the leaves.
    """
    forest = _Forest(len(points))
    stack = [np.arange(len(points))]
    while stack:
        index = stack.pop()
        if len(index) < 2:
            continue
        inner = outer = index
        if len(index) > leaf:
            distance = np.bitwise_count(points[index] ^ points[index[len(index) // 2]]).astype(np.int64)
            boundary = int(np.median(distance)) + radius // 2
            inner, outer = index[distance <= boundary], index[distance > boundary - radius]
        if max(len(inner), len(outer)) > SHRUNK * len(index):
            if visited is not None:
                visited.append(len(index))
            _close_pairs(points, index, forest, radius)
        else:
            stack += [inner, outer]
    return forest.labels()


def cell_masks(points: int, radius: int, cell: int = CELL) -> list[int]:
    """Masks of which any pair within ``radius`` bits agrees on one at least.

    Each mask has about log2(points / cell) bits: the leading bits of the blocks on which a pair is to agree.
    Of ``radius + j`` blocks a pair agrees on j; the smallest j whose blocks have the bits is taken.
    """
    need = max(0, int(np.log2(max(points / cell, 1))))
    if not need:
        return [0]
    agreed = next(j for j in range(1, 65 - radius) if j * (64 // (radius + j)) >= need or j == 64 - radius)
    blocks = radius + agreed
    edges = [64 * i // blocks for i in range(blocks + 1)]
    taken = [need // agreed + (i < need % agreed) for i in range(agreed)]
    masks = []
    for chosen in combinations(range(blocks), agreed):
        mask = 0
        for block, bits in zip(chosen, taken, strict=True):
            bits = min(bits, edges[block + 1] - edges[block])
            mask |= ((1 << bits) - 1) << (edges[block + 1] - bits)
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _shards(points: DataFrame, radius: int, count: int, leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """(shard, fp) with at most ``leaf`` points a shard, and (shard, fp) of the shards that no vantage point parts.

    Each round gives every large shard a member as vantage point and the boundary that leaves the smaller larger branch;
    a shard whose larger branch keeps more than ``SHRUNK`` of its points goes no further.
    """
    masks = cell_masks(count, radius)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])
    open_ = points.select("fp", F.explode(cells).alias("b")).select(F.xxhash64("b.k", "b.v").alias("shard"), "fp")
    done, stuck, level = [], [], 0
    while True:
        sizes = open_.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64(F.lit(level), "fp")).alias("vantage"))
        large = materialise(sizes.where(F.col("n") > leaf).withColumnRenamed("shard", "l_shard"), "sim-large")
        if large.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(large, F.col("shard") == F.col("l_shard"), "left_anti"))
        near = open_.join(large, F.col("shard") == F.col("l_shard")).select("shard", "fp", "n", _distance("fp", "vantage").alias("d"))
        near = materialise(near, "sim-distances")
        bounds = materialise(_boundaries(near, radius), "sim-bounds")
        kept = near.join(bounds, F.col("shard") == F.col("b_shard"))
        stuck.append(kept.where(F.col("worst") > SHRUNK * F.col("n")).select("shard", "fp"))
        sides = F.array_compact(F.array(F.when(F.col("d") <= F.col("boundary"), F.lit(0)), F.when(F.col("d") > F.col("boundary") - radius, F.lit(1))))
        split = kept.where(F.col("worst") <= SHRUNK * F.col("n")).select("shard", "fp", F.explode(sides).alias("side"))
        open_ = materialise(split.select(F.xxhash64("shard", "side").alias("shard"), "fp"), "sim-branches")
        level += 1
    whole = [reduce(DataFrame.unionByName, x) if x else None for x in (done, stuck)]
    return whole[0], whole[1]


def _boundaries(near: DataFrame, radius: int) -> DataFrame:
    """(b_shard, boundary, worst): the boundary whose larger branch is smallest, and that branch's points; 65 counts a shard at most."""
    counts = near.groupBy("shard", "d").agg(F.count("*").alias("c"))
    up = Window.partitionBy("shard").orderBy("d")
    total = F.sum("c").over(Window.partitionBy("shard"))
    inner = F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.sum("c").over(up.rangeBetween(Window.unboundedPreceding, -radius)), F.lit(0))
    tried = counts.select("shard", "d", F.greatest(inner, total - below).alias("worst"))
    best = tried.groupBy(F.col("shard").alias("b_shard")).agg(F.min(F.struct("worst", "d")).alias("m"))
    return best.select("b_shard", F.col("m.d").alias("boundary"), F.col("m.worst").alias("worst"))


def _flipped(points: DataFrame, most: int) -> DataFrame:
    """(fp, z): every point with each choice of at most ``most`` of its bits flipped."""
    rows = points.select("fp", F.col("fp").alias("z"), F.lit(-1).alias("last"))
    for _ in range(most):  # bits in rising order; 64 stands for none
        rows = rows.select("fp", "z", F.explode(F.sequence(F.least(F.col("last") + 1, F.lit(64)), F.lit(64))).alias("last"))
        rows = rows.withColumn("z", F.when(F.col("last") < 64, F.col("z").bitwiseXOR(F.expr("shiftleft(1L, last)"))).otherwise(F.col("z")))
    return rows.select("fp", "z")


def _meetings(points: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join all of ``points`` within ``radius`` of each other, without comparing pairs.

    Two points within the radius meet at a word that is at most half the radius, rounded down, from one and at most
    the rest from the other; all that meet there are one component, so each is linked with the first of the near ones.
    Rows: the points times the words around them, 2,146 for three bits.
    """
    hubs = _flipped(points, radius // 2).groupBy("z").agg(F.min("fp").alias("a")).withColumnRenamed("z", "hub")
    met = _flipped(points, radius - radius // 2).join(hubs, F.col("z") == F.col("hub"))
    return met.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_links(points: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all links within ``radius``."""
    shards, stuck = _shards(points, radius, points.count(), leaf)
    shards = shards.repartition("shard").sortWithinPartitions("shard", "fp")

    def links(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = fp.view(np.uint64)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        a, b = [], []
        for at, end in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(shard)]]).tolist(), strict=True):
            labels = link_shard(bits[at:end], radius)
            moved = np.flatnonzero(labels != np.arange(end - at))
            a.append(fp[at + moved])
            b.append(fp[at + labels[moved]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b = links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.searchsorted(shard, shard[-1]))
            if held and held[-1][0][-1] != shard[0]:
                yield out()
            if last:  # all shards before the last one are complete
                held.append((shard[:last], fp[:last]))
                yield out()
            held.append((shard[last:], fp[last:]))
        if held:
            yield out()

    found = shards.mapInArrow(run, "a long, b long")
    return found if stuck is None else found.unionByName(_meetings(stuck.select("fp").distinct(), radius))


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row: linked fingerprints share a component.

    The component is named by its smallest identifier. Null texts are empty; texts without a word
    have fingerprint zero and are linked like others. Rows with null identifier take part and
    count last when a component is named. Repeated rows appear as often as they come. Identifiers keep
    their type; further columns are not carried. Empty tables give empty results.
    """
    marked = materialise(fingerprints(docs, text, ident, words), "sim-docs")
    points = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "sim-points")
    labels = connected_components(materialise(near_links(points.select("fp"), radius), "sim-links"))
    named = labels.join(points, labels.node == points.fp)
    roots = named.groupBy(F.col("label").alias("root")).agg(F.min("first").alias("lowest"))
    found = materialise(named.join(roots, F.col("label") == F.col("root")).select(F.col("node").alias("l_fp"), "label", "lowest"), "sim-classes")
    classes = points.join(found, points.fp == F.col("l_fp"), "left").select(
        F.col("fp").alias("c_fp"), F.coalesce("label", "fp").alias("component"), F.coalesce("lowest", "first").alias("component_id")
    )
    return marked.join(classes, marked.fp == F.col("c_fp")).select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of every component, whole: the smallest identifier, then the smallest text hash.

    A row without identifier stays only where its component has no other. Of repeated rows one stays; of
    rows that differ in other columns alone, the first by all columns. Columns may have any names.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    best = near_duplicates(docs, text, ident, words, radius).groupBy("component").agg(F.min(order).alias("m"))
    best = materialise(best.select(F.col("m.doc_id").alias("best_id"), F.col("m.text_hash").alias("best_hash")), "sim-kept").hint("merge")
    hashed = nested(docs).withColumn("hash", _text_hash(own(text))).withColumn("id", own(ident))
    kept = hashed.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("hash") == F.col("best_hash")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64(ROW)))
    return unnested(kept.withColumn("nth", nth).where("nth = 1"), docs.columns)


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row; awkward rows as in ``near_duplicates``."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

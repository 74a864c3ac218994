"""Balanced shards by k-d tree partitioning of document metadata.

The tree splits every node at the weighted median of its widest dimension until the leaves
hold the target bytes. A row carries the leaves of its node (the first one and how many), so
a level is one join with the table of that level's cuts, however many nodes there are.

Medians are exact and distributed: a row's key along a dimension is its coordinate, then a hash of its
text, then a hash of its identifier, and each pass sums bytes by the next digit of the keys that share the
prefix found so far. All nodes of a level share a pass; sums, running sums and cuts stay tables on the
executors, of at most ``2 ** 14`` sums a node. The driver sees one row of totals, and whether cuts are open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.ranks import spread_rank
from helixframe.llm.store import materialise, release

COORDINATE, GROUP, OWN = 20, 22, 20
#: bits of a key that each pass looks at: two passes end at the groups of equal texts, two more inside them
DIGITS = (14, 14, 14, 10, 10)
BITS = COORDINATE + GROUP + OWN
TOLERANCE, GROUP_TOLERANCE = 0.001, 0.004
TARGET = 1 << 30
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "timestamp")


def _is_numeric(kind: str) -> bool:
    return kind.startswith(_NUMERIC) and not kind.startswith("interval")


def _number(column: Column) -> Column:
    """As a double, null where it is no number."""
    wide = column.cast("double")
    return F.when(~F.isnan(wide), wide)


def _coordinate(column: Column, numeric: bool, low: float, high: float) -> Column:
    top = (1 << COORDINATE) - 1
    if not numeric:
        return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit(top + 1))).cast("long")
    scaled = (F.coalesce(column, F.lit(low)) - F.lit(low)) / F.lit((high - low) or 1.0)
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * top).cast("long")


def _key(dim: Column) -> Column:
    return F.shiftleft(F.element_at("at", dim + 1), GROUP + OWN) + F.col("tail")


def level_cuts(rows: DataFrame, dims: int, tolerance: float, group_tolerance: float) -> DataFrame:
    """(n_first, n_leaves, dim, want, cut) of every node of ``rows`` that has two leaves or more.

    ``rows``: (first, leaves, at, tail, size). Rows whose key along ``dim`` is at least ``cut`` go right: the cut at which the
    bytes below come nearest to ``want``, or within the tolerance of it, at the fewest digits.
    """
    open_ = rows.where("leaves > 1")
    widths = F.array(*[F.max(F.element_at("at", i + 1)) - F.min(F.element_at("at", i + 1)) for i in range(dims)])
    spans = open_.groupBy(F.col("first").alias("n_first"), F.col("leaves").alias("n_leaves")).agg(F.sum("size").alias("bytes"), widths.alias("widths"))
    dim = (F.array_position("widths", F.array_max("widths")) - 1).cast("int")
    want = F.col("bytes") * F.ceil(F.col("n_leaves") / 2) / F.col("n_leaves")
    nodes = spans.select("n_first", "n_leaves", dim.alias("dim"), want.alias("want"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"))
    nodes = materialise(nodes, "kd-nodes")
    shift = BITS
    for bits in DIGITS:
        shift -= bits
        key = _key(F.col("dim"))
        mine = open_.join(nodes.where("cut is null").select("n_first", "dim", "prefix"), F.col("first") == F.col("n_first"))
        mine = mine.where(F.shiftright(key, shift + bits) == F.col("prefix"))
        digit = F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1))
        sums = mine.groupBy(F.col("n_first").alias("d_first"), digit.alias("digit")).agg(F.sum("size").alias("own"))
        up = Window.partitionBy("d_first").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("own").over(up)).join(nodes.select("n_first", "want", F.col("below").alias("base")), F.col("d_first") == F.col("n_first"))
        here = F.struct("digit", (F.col("base") + F.col("upto") - F.col("own")).alias("before"), (F.col("base") + F.col("upto")).alias("upto"))
        reached = F.min(F.when(F.col("base") + F.col("upto") >= F.col("want"), here))
        picked = run.groupBy(F.col("d_first").alias("p_first")).agg(F.coalesce(reached, F.max(here)).alias("p"))
        moved = nodes.join(picked, F.col("n_first") == F.col("p_first"), "left")
        left, right = F.abs(F.col("want") - F.col("p.before")), F.abs(F.col("p.upto") - F.col("want"))
        start = F.shiftleft("prefix", bits).bitwiseOR(F.col("p.digit"))
        good = F.lit(shift == 0) | (F.least(left, right) <= F.lit(group_tolerance if shift == OWN else tolerance))
        cut = F.when(good, F.shiftleft(start + F.when(left <= right, 0).otherwise(1), shift))
        fresh = F.col("cut").isNull() & F.col("p").isNotNull()
        moved = moved.select(
            "n_first",
            "n_leaves",
            "dim",
            "want",
            F.when(fresh, start).otherwise(F.col("prefix")).alias("prefix"),
            F.when(fresh, F.col("p.before")).otherwise(F.col("below")).alias("below"),
            F.when(fresh, cut).otherwise(F.col("cut")).alias("cut"),
        )
        moved = materialise(moved, "kd-nodes")
        release(nodes)
        nodes = moved
        if nodes.where("cut is null").isEmpty():
            break
    return nodes


def kd_shards(
    docs: DataFrame, size: Column, dims: list[str], *, text: str = "text", ident: str = "doc_id", target: int = TARGET, leaves: int | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, size, shard, slot and ``carry``): leaves are as many as it takes to keep each near ``target`` bytes.

    ``leaves`` fixes their number instead. Shards count from 0 in the order of the tree; slots are gapless from 0 in
    each. Rows of equal text and coordinates stay together unless a cut between such groups would miss the median by more than 0.4 % of a
    leaf; then the cut goes through the group by identifier. Numbers are coordinates by value, other types by
    hash; nulls and NaN are the lowest. Repeated rows agree in every key and go to one side, so one text
    above a leaf's bytes leaves uneven or empty shards. Null texts are empty. Identifiers keep their type.
    An empty table gives no rows. ``dims`` and ``carry`` are columns of ``docs``; ``carry`` may not hold the names above.
    """
    kinds = dict(docs.dtypes)
    numeric = [_is_numeric(kinds[d]) for d in dims]
    # the two hashes that break ties: texts first, so that copies stay together
    tail = F.shiftleft(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << GROUP)), OWN) + F.pmod(F.xxhash64(F.lit("own"), F.col(ident)), F.lit(1 << OWN))
    raw = [(_number(F.col(d)) if n else F.col(d)).alias(f"raw{i}") for i, (d, n) in enumerate(zip(dims, numeric, strict=True))]
    slim = docs.select(F.col(ident).alias("doc_id"), size.cast("long").alias("size"), tail.alias("tail"), *raw, F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    slim = materialise(slim, "kd-rows")
    ends = [f(f"raw{i}").alias(f"{name}{i}") for i, n in enumerate(numeric) if n for name, f in (("low", F.min), ("high", F.max))]
    ends = slim.agg(F.sum("size").alias("total"), *ends).first()
    total = ends["total"] or 0
    count = leaves or max(1, math.ceil(total / target))
    limits = [(ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0) if n else (0.0, 0.0) for i, n in enumerate(numeric)]
    at = F.array(*[_coordinate(F.col(f"raw{i}"), n, *limits[i]) for i, n in enumerate(numeric)])
    rows = slim.select("doc_id", "size", "tail", "carried", at.alias("at"), F.lit(0).cast("long").alias("first"), F.lit(count).cast("long").alias("leaves"))
    held = [slim]
    leaf = max(total / count, 1)
    for _ in range((count - 1).bit_length()):
        cuts = level_cuts(rows, len(dims), TOLERANCE * leaf, GROUP_TOLERANCE * leaf)
        joined = rows.join(cuts.select("n_first", "n_leaves", "dim", "cut"), (F.col("first") == F.col("n_first")) & (F.col("leaves") == F.col("n_leaves")), "left")
        half = F.ceil(F.col("leaves") / 2)
        goes_right = _key(F.col("dim")) >= F.col("cut")
        first = F.when(goes_right, F.col("first") + half).otherwise(F.col("first"))
        left = F.when(F.col("leaves") == 1, F.lit(1)).when(goes_right, F.col("leaves") - half).otherwise(half)
        below = materialise(joined.select("doc_id", "size", "tail", "carried", "at", first.alias("first"), left.cast("long").alias("leaves")), "kd-rows")
        release(cuts, *held)
        rows, held = below, [below]
    placed = rows.select("doc_id", "size", "tail", "carried", F.col("first").cast("int").alias("shard"))
    ranked = spread_rank(placed, "shard", ["doc_id", "tail", "size"], "slot")
    return ranked.select("doc_id", "size", "shard", "slot", *[F.col(f"carried.{c}").alias(c) for c in carry])


def shard_report(docs: DataFrame, leaves: int = 8) -> DataFrame:
    """Shards of equal bytes by text size, language and bytes a character, which copies of a text share.

    Null texts are empty and count one byte; null languages are one coordinate; repeated rows are each placed; an empty table gives none.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(body).cast("long") + 1
    density = size.cast("double") / (F.length(body) + 1)
    marked = docs.select("doc_id", "text", "lang", F.log2(size).alias("log_size"), density.alias("density"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = kd_shards(marked, size, ["log_size", "lang", "density"], leaves=leaves, carry=("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Connected components by contraction: rounds are logarithmic in the nodes, and each is smaller than the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.scratch import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge to another; ``label`` is the smallest node reachable.

    ``edges`` has (a, b) of any orderable type. In each round every node moves to the node that comes first, in a
    pseudo-random order, among itself and its neighbours; edges are renamed and loops dropped. About
    half of the nodes of a chain are left after a round, and a star is gone after two rounds of one order,
    so an order serves two rounds. The rounds end when no edge is left, however long a chain is. Then the
    moves are followed backwards from the last round, whose tables are the smallest. All rounds are written
    tables; nothing gathers on the driver, and superseded tables are deleted.
    """
    left = materialise(_slim(edges.select("a", "b")), "cc-edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        moves.append(materialise(_moves(left, len(moves) // 2), "cc-moves"))
        ends = [moves[-1].select(F.col("node").alias(f"n{c}"), F.col("to").alias(f"t{c}")) for c in "ab"]
        moved = left.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb"))
        after = materialise(_slim(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "cc-edges")
        release(left)
        left = after
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    release(left)
    found = moves.pop()
    while moves:
        early = moves.pop()
        late = found.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        whole = early.join(late, F.col("to") == F.col("n2"), "left").select("node", F.coalesce("t2", "to").alias("to"))
        joined = materialise(whole, "cc-moves")
        release(early, found)
        found = joined
    lowest = found.groupBy(F.col("to").alias("root")).agg(F.min("node").alias("label"))
    return found.join(lowest, F.col("to") == F.col("root")).select("node", "label")


def _slim(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moves(edges: DataFrame, order: int) -> DataFrame:
    """(node, to): the first of a node and its neighbours in the order of a seeded hash."""
    def place(node: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(order), node).alias("h"), node.alias("n"))

    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    first = both.select("e.x", "e.y").groupBy(F.col("x").alias("node")).agg(F.min(place(F.col("y"))).alias("m"))
    return first.select("node", F.least(place(F.col("node")), F.col("m"))["n"].alias("to"))

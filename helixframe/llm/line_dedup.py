"""Line dedup on levelled sorted runs of line hashes, in DataFrame functions only.

Documents come in batches. A batch's line keys (two 64-bit hashes each) are counted by document and
merge-anti-joined with all runs: keys that no run holds become a new run on level 0, and the
counts of known keys become a run of additions. When a level holds ``fanout`` runs they are compacted, with the
additions so far, into one run of the next level. Runs are bucketed by the key and sorted in their buckets, so
a batch meets every run in place, without a shuffle; only compactions shuffle, partial sums of a key's counts.
A key counts once a document, and batches hold different documents, so its counts add up exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.nested import nested, own, unnested
from helixframe.llm.store import bucketed, materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
HASH = ("h1", "h2")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int) -> Column:
    """Per line the struct (h1, h2) of its key, null where the key is too short."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANK))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))

    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), one)


class LineRuns:
    """Levels of runs (h1, h2, docs): a key's documents are the sum over all runs and additions."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = 3) -> None:
        self.limit, self.fanout = limit, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.additions: list[DataFrame] = []

    def _written(self, run: DataFrame) -> DataFrame:
        return bucketed(run, "line_run", HASH, self.buckets)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose line is in no run: first occurrences across batches."""
        for run in self.runs():
            keys = keys.join(run.select(*HASH).hint("merge"), list(HASH), "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """``keys``: (h1, h2, doc), one row or more a line key and document of this batch."""
        counts = keys.groupBy(*HASH, "doc").agg(F.lit(1).alias("one")).groupBy(*HASH).agg(F.count("*").alias("docs"))
        if not self.levels:
            self._place(self._written(counts), 0)
            return
        batch = self._written(counts)
        fresh = self._written(self.unseen(batch))
        self.additions.append(self._written(batch.join(fresh.select(*HASH).hint("merge"), list(HASH), "left_anti")))
        release(batch)
        self._place(fresh, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old = [*self.levels[level], *self.additions]
            merged = self._written(self._summed(old))
            release(*old)
            self.levels[level], self.additions = [], []
            self._place(merged, level + 1)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        # Spark takes a union of bucketed scans for partitioned by their keys but reads the buckets one after
        # another, so equal keys would stay apart; a computed key makes it shuffle the partial sums
        plain = [r.select(*[F.col(h).bitwiseXOR(F.lit(0)).alias(h) for h in HASH], "docs") for r in runs]
        return reduce(DataFrame.unionByName, plain).groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """All keys found in at least ``limit`` documents; the runs are given up."""
        old = [*self.runs(), *self.additions]
        found = materialise(self._summed(old).where(F.col("docs") >= self.limit).select(*HASH), "line-frequent")
        release(*old)
        self.levels, self.additions = [], []
        return found


def dropped_lines(docs: DataFrame, text: str, ident: str, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(doc, hash, drop): line numbers to drop, from 0 and ascending, of every affected text."""
    whole = F.coalesce(own(text), F.lit(""))
    slim = nested(docs).select(
        own(ident).alias("doc"), F.xxhash64(whole).alias("hash"), line_hashes(whole, min_chars).alias("lines"), F.pmod(F.xxhash64(own(ident)), F.lit(batches)).cast("int").alias("batch")
    )
    slim = materialise(slim, "line-keys", ("batch",))
    runs = LineRuns(docs.sparkSession, min_docs)
    for batch in range(batches):
        mine = slim.where(F.col("batch") == batch).select("doc", F.explode(F.array_distinct("lines")).alias("l")).where("l is not null")
        runs.add(mine.select("l.h1", "l.h2", "doc"))
    placed = slim.select("doc", "hash", F.posexplode("lines").alias("pos", "l")).where("l is not null").select("doc", "hash", "pos", "l.h1", "l.h2")
    hit = placed.join(runs.frequent(), list(HASH), "left_semi")
    return hit.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def spliced(text: Column, lines: Column, drop: Column) -> Column:
    """``text`` without the lines numbered in ``drop`` (ascending; null: none)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda x: x + 1))
    ends = F.concat(drop, F.array(F.size(lines)))
    spans = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(drop.isNull(), text).otherwise(F.array_join(F.flatten(spans), "\n"))


def drop_frequent_lines(
    docs: DataFrame, *, text: str = "text", ident: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4, report: bool = False
) -> DataFrame:
    """Documents without the lines whose key occurs in ``min_docs`` documents or more.

    The key is the line without blanks at its ends, A-Z in lower case. Null or empty texts are
    one empty line and stay; a null text without dropped lines stays null. Rows with equal
    identifier are one document when lines are counted (null identifiers too), and each keeps its
    own row. Identifiers may have any type and columns any name. Empty tables give empty results; further
    columns stay. With ``report``: also ``n_lines`` and ``n_dropped``, which ``docs`` may then not have.
    """
    drop = dropped_lines(docs, text, ident, min_docs, min_chars, batches)
    # the same sort-merge join at every size: texts are shuffled once, never gathered
    drop = materialise(drop, "line-drops").select(F.col("doc").alias("d_doc"), F.col("hash").alias("d_hash"), "drop").hint("merge")
    keyed = nested(docs).withColumn("doc", own(ident)).withColumn("hash", F.xxhash64(F.coalesce(own(text), F.lit(""))))
    out = keyed.join(drop, F.col("doc").eqNullSafe(F.col("d_doc")) & (F.col("hash") == F.col("d_hash")), "left").withColumn("all", lines_of(own(text)))
    counts = [F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return unnested(out, docs.columns, {text: spliced(own(text), F.col("all"), F.col("drop"))}, counts if report else ())


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.k IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; awkward rows as in ``drop_frequent_lines`` (a null text hashes as an empty one)."""
    out = drop_frequent_lines(docs.select("doc_id", "text"), min_docs=min_docs, min_chars=min_chars, report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

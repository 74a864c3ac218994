"""Assembly summaries: lengths, N50, auN and base composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_summary(lengths: DataFrame, column: str = "length") -> DataFrame:
    """One row: n, total, average, n50, l50, aun, largest, smallest. Equal lengths are summed before the running total."""
    rows = lengths.groupBy(F.col(column).cast("long").alias("len")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("total", F.sum(F.col("len") * F.col("n")).over(every)).withColumn("before", F.coalesce(F.sum(F.col("len") * F.col("n")).over(down), F.lit(0))).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
    half = F.col("total") / 2
    here = (F.col("before") < half) & (F.col("before") + F.col("len") * F.col("n") >= half)
    at = F.max(F.when(here, F.struct("len", (F.col("above") + F.ceil((half - F.col("before")) / F.col("len"))).alias("l50"))))
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), at.alias("at"), F.sum(F.col("len") * F.col("len") * F.col("n")).alias("squares"), F.max("len").alias("largest"), F.min("len").alias("smallest"))
    return out.select(
        "n",
        "total",
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("average"),
        F.coalesce("at.len", F.lit(0)).alias("n50"),
        F.coalesce("at.l50", F.lit(0)).cast("long").alias("l50"),
        F.when(F.col("total") > 0, F.col("squares") / F.col("total")).otherwise(0.0).alias("aun"),
        F.coalesce("largest", F.lit(0)).alias("largest"),
        F.coalesce("smallest", F.lit(0)).alias("smallest"),
    )


def composition(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of A, C, G and T, soft-masked (lower-case) bases, and GC percent."""
    def count(b: str):
        return F.coalesce(F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))), F.lit(0)).cast("long")

    masked = F.coalesce(F.sum(F.length("raw") - F.length(F.regexp_replace("raw", "[a-z]", ""))), F.lit(0)).cast("long")
    out = parts.groupBy(*by).agg(*[count(b).alias(b.lower()) for b in "ACGT"], masked.alias("soft_masked"))
    whole = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return out.withColumn("gc_percent", F.when(whole > 0, 100.0 * (F.col("c") + F.col("g")) / whole))


def assembly_summary(parts: DataFrame, components: DataFrame) -> DataFrame:
    """Length summaries of scaffolds, contigs and gaps, a row each."""
    scaffolds = components.groupBy("path").agg(F.sum("length").alias("length"))
    rows = [(length_summary(scaffolds), "scaffolds"), (length_summary(parts), "contigs"), (length_summary(components.where("kind = 'GAP'")), "gaps")]
    out = [r.select(F.lit(kind).alias("kind"), *r.columns) for r, kind in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])

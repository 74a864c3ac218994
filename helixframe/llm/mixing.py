"""Source mixing by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a token target. Whole epochs of the source come first; the rest of
the target is filled with the documents of smallest exponential key
``-ln(u) / weight``, summed in key order until the budget is met.

A source may hold any share of the rows: keys fall into buckets of equal width in ``ln(key)``, which any
weights only shift, bucket totals are prefix-summed, and rows are ordered only inside the one bucket of each
source in which the budget runs out: under 0.04 % of the source for weights alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.nested import ROW, nested, own, unnested
from helixframe.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
MARKS = "#*$%&|<>{}[]\\^~=_@"
#: buckets a unit of ln(key)
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight in [0.05, 1.05]: the squared share of characters that are no markup signs."""
    whole = F.coalesce(text, F.lit(""))
    share = F.length(F.translate(whole, MARKS, "")).cast("double") / F.greatest(F.length(whole), F.lit(1)).cast("double")
    return F.lit(0.05) + share * share


def exponential_key(ident: Column, text: Column, weight: Column, salt: str = "mix") -> Column:
    """-ln(u)/weight with u in (0, 1) from an MD5 of the identifier (null: of the text), so reruns agree."""
    name = F.coalesce(ident.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(salt + ":"), name).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """``sizes`` (src, total), one row a source, gains ``target``.

    Targets are weight shares of ``share`` times all tokens, held at ``epochs`` times the
    source, the excess reshared by weight until none is above: sources in order of
    ``epochs * total / weight`` are full up to the first whose level stays below its cap.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_level = Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(cycle, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("total") * F.lit(float(epochs))).withColumn("level", F.col("cap") / F.col("w"))
    ranked = (
        ranked.withColumn("want", F.sum("total").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("try", F.greatest(F.col("want") - F.col("full"), F.lit(0.0)) / F.col("open"))
    )
    level = F.min(F.when(F.col("try") < F.col("level"), F.struct("level", "rank", "try"))).over(every)["try"]
    return ranked.withColumn("cut", level).select(
        "src", "total", F.when(F.col("cut").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("cut") * F.col("w"))).alias("target")
    )


def _keyed(docs: DataFrame, text: str, ident: str, source: str, weight: Column | None) -> DataFrame:
    """The caller's rows with src, id, size, key and bucket; ``weight`` is an expression over the caller's columns."""
    rows = nested(docs) if weight is None else docs.select(F.struct("*").alias(ROW), weight.cast("double").alias("given"))
    w = quality_weight(own(text)) if weight is None else F.greatest(F.coalesce(F.nanvl("given", F.lit(0.0)), F.lit(0.0)), F.lit(1e-6))
    return (
        rows.withColumn("src", own(source).cast("string"))
        .withColumn("id", own(ident).cast("string"))
        .withColumn("size", word_count(own(text)))
        .withColumn("key", exponential_key(own(ident), own(text), w))
        .withColumn("bucket", F.floor(F.log("key") * BUCKETS).cast("int"))
    )


def _decided(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    at = F.struct("key", "id", "size")
    within = (F.col("bucket") < F.col("stop")) | ((F.col("bucket") == F.col("stop")) & F.coalesce(at <= F.col("last"), F.lit(False)))
    joined = keyed.join(plan.withColumnRenamed("src", "plan_src"), F.col("src").eqNullSafe(F.col("plan_src")), "left").drop("plan_src")
    copies = F.coalesce(F.col("epochs"), F.lit(0)) + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int"))


def mixing_plan(slim: DataFrame, share: float, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """One row a source: total, target, whole epochs, and where the fractional epoch stops."""
    sizes = slim.groupBy("src").agg(F.sum("size").alias("total"))
    budget = F.col("target") - F.col("epochs") * F.col("total")
    targets = source_targets(sizes, share, weights, epochs).withColumn(
        "epochs", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("int")
    )
    targets = materialise(targets.withColumn("budget", budget), "mix-targets")
    before = Window.partitionBy("b_src").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        slim.groupBy(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"))
        .agg(F.sum("size").alias("b_size"))
        .withColumn("before", F.coalesce(F.sum("b_size").over(before), F.lit(0)))
    )
    stops = (
        targets.join(buckets, F.col("src").eqNullSafe(F.col("b_src")))
        .where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("b_size")))
        .select("b_src", F.col("b_bucket").alias("stop"), "before", "budget")
    )
    stops = materialise(stops, "mix-stops")
    up_to = Window.partitionBy("src").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = slim.join(stops, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("bucket") == F.col("stop")))
    edge = edge.withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(up_to), F.lit(0)) + F.col("size") / F.lit(2.0))
    last = (
        edge.where(F.col("run") <= F.col("budget"))
        .groupBy(F.col("src").alias("l_src"))
        .agg(F.max(F.struct("key", "id", "size")).alias("last"))
    )
    plan = targets.join(stops.select("b_src", "stop"), F.col("src").eqNullSafe(F.col("b_src")), "left")
    plan = plan.join(last, F.col("src").eqNullSafe(F.col("l_src")), "left")
    return materialise(plan.select("src", "total", "target", "epochs", "stop", "last"), "mix-plan")


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
    weight: Column | None = None,
    share: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    epochs: int = 2,
    repeat: bool = True,
) -> DataFrame:
    """The documents of the mix, each as often as it is taken (once with its count in
    ``copies`` if ``repeat`` is false).

    Null texts have size 0; null sources are one source, last in order. Null identifiers draw by their
    text. Rows that agree in identifier and size count as ties of one key and are taken together at the
    boundary. Null, NaN or negative weights count as 1e-6. An empty table gives an empty mix. Further columns
    stay as they are and may have any names (but ``copies`` with ``repeat`` false). No text is
    shuffled: the written per-source plan is small enough to be broadcast by its file size.
    """
    keyed = _keyed(docs, text, ident, source, weight)
    slim = materialise(keyed.select("src", "id", "size", "key", "bucket"), "mix-slim")
    out = _decided(keyed, mixing_plan(slim, share, weights, epochs))
    if repeat:
        out = out.where("copies > 0").withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        return unnested(out, docs.columns)
    return unnested(out, docs.columns, more=[F.col("copies")])


def mix_report(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), epochs: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and words taken; awkward rows as in ``mix``."""
    keyed = _keyed(docs, "text", "doc_id", "source", None).withColumn("doc_id", own("doc_id"))
    slim = materialise(keyed.select("doc_id", "src", "id", "size", "key", "bucket"), "mix-slim")
    out = _decided(slim, mixing_plan(slim, share, weights, epochs))
    return out.select(
        "doc_id", F.col("size").alias("size"), F.col("total").alias("source_size"), F.col("target").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.05 + pow(length(translate(coalesce(text, ''), '#*$%&|<>{}[]\^~=_@', ''))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE, 2)) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, total * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS lev, (sum(total) OVER ()) * 1.5::DOUBLE AS want,
    coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS filled,
    (sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS open_w
  FROM weighed),
cut AS (
  SELECT (SELECT greatest(want - filled, 0.0) / open_w FROM levels WHERE greatest(want - filled, 0.0) / open_w < lev ORDER BY lev, rnk LIMIT 1) AS c),
targets AS (SELECT source, total, CASE WHEN c IS NULL THEN cap ELSE least(cap, c * w) END AS target FROM levels, cut),
budgets AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS ep FROM targets),
runs AS (
  SELECT s.doc_id, s.size, b.total, b.target, b.ep, b.target - b.ep * b.total AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id::VARCHAR, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, total AS source_size, target,
  (size * (ep + CASE WHEN before + size / 2.0::DOUBLE <= budget AND budget < total THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""

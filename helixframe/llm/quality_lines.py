"""Quality rules: line frequency across the documents of a host, and base counts of a text.

Normalised lines are hashed with their host. A line's frequency is the number of distinct documents of
the host that hold it. Lines above the host's limit are boilerplate and are removed; a document that
loses more than ``max_loss`` of its words with them is depleted and rejected.

Documents are distinct by their text, or with ``copies`` by their identifier. By identifier every line of a text that
has more exact copies than the limit is boilerplate, so no copy of it would be kept; copies are another operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.line_dedup import lines_of, spliced
from helixframe.llm.nested import identifier, nested, own, unnested
from helixframe.llm.store import materialise

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
MIN_LIMIT, LIMIT_SHARE, MAX_LOSS = 20, 1e-4, 0.7
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64) + np.uint64(1)
    sums = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        sums += ids[j : j + n] * _FACTORS[j]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    if not same.any():
        return 0
    # equal sums are only candidates; windows are compared word by word
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.reshape(-1)] > 1]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def signed_hash(raw: bytes) -> int:
    """What Spark's xxhash64 makes of the string."""
    import xxhash

    h = xxhash.xxh64_intdigest(raw, 42)
    return h - (1 << 64) if h >> 63 else h


def measure(text: str, host: str | None) -> tuple[int, int, int, int, int, int, list[tuple[int, int, int]]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text hash, [(line hash, words, line number)])."""
    import xxhash

    raw = text.encode()
    words = raw.split()
    lines: list[tuple[int, int, int]] = []
    seen: set[bytes] = set()
    repeats = 0
    seed = xxhash.xxh64_intdigest(b"" if host is None else b"=" + host.encode())
    for number, line in enumerate(raw.split(b"\n")):
        own = line.split()
        if not own:
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        lines.append((xxhash.xxh64_intdigest(line.strip().lower(), seed) - (1 << 63), len(own), number))
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), repeats, repeated_words(words), signed_hash(raw), lines


def measured(docs: DataFrame, text: str, ident: str, host: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]
    item = pa.struct([("key", pa.int64()), ("words", pa.int64()), ("at", pa.int32())])
    kind, arrow = identifier(docs, ident)
    schema = pa.schema([("doc_id", arrow), ("host", pa.string()), *((c, pa.int64()) for c in counts), ("lines", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in counts]
            items, ends = [], [0]
            for t, h in zip(batch.column(2), batch.column(1), strict=True):
                *values, lines = measure(t.as_py() or "", h.as_py())
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
                items += lines
                ends.append(len(items))
            fields = list(zip(*items, strict=True)) or [()] * len(item)
            structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, item, strict=True)], fields=list(item))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], schema=schema)

    out = f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in counts) + ", lines array<struct<key:long,words:long,at:int>>"
    return docs.select(F.col(ident).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).mapInArrow(run, out)


def line_quality(
    docs: DataFrame,
    *,
    text: str = "text",
    ident: str = "doc_id",
    host: str = "source",
    min_limit: int = MIN_LIMIT,
    limit_share: float = LIMIT_SHARE,
    max_loss: float = MAX_LOSS,
    copies: bool = False,
) -> DataFrame:
    """Per document: base counts, ``base_failed``, ``n_boilerplate_words``, ``kept``, ``boilerplate``
    (numbers of the lines above the limit, from 0 and ascending; null: none) and ``text_hash``.

    The limit of a host is ``limit_share`` of its documents, at least ``min_limit``. Null and
    empty texts have no words and fail the base rule; null hosts are one host. Rows of equal
    identifier and text get equal results, each row its own; with ``copies`` null identifiers are one document.
    Identifiers keep their type. An empty table gives none.
    """
    base = materialise(measured(docs, text, ident, host), "line-quality")
    hosts = base.groupBy("host").agg(F.greatest(F.lit(float(min_limit)), F.count("*") * F.lit(float(limit_share))).alias("limit"))
    lines = base.select("doc_id", "host", "text_hash", F.explode("lines").alias("line")).select("doc_id", "host", "text_hash", "line.key", "line.words", "line.at")
    holders = lines.groupBy("key", "doc_id" if copies else "text_hash").agg(F.min("host").alias("host"))
    found = holders.groupBy("key").agg(F.count("*").alias("holders"), F.min("host").alias("host"))
    # a line of no more documents than the least limit is below every host's
    found = materialise(found.where(F.col("holders") > min_limit), "line-found")
    limits = materialise(hosts, "line-limits").withColumnRenamed("host", "l_host")
    frequent = found.join(limits, F.col("host").eqNullSafe(F.col("l_host"))).where(F.col("holders") > F.col("limit")).select(F.col("key").alias("f_key"))
    frequent = materialise(frequent, "line-above")
    lost = lines.join(frequent, F.col("key") == F.col("f_key"), "left_semi").groupBy("doc_id", "text_hash", "host")
    # repeated rows add the same places: a set holds each once
    lost = lost.agg(F.collect_set(F.struct("at", "words")).alias("places"))
    n_lost = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    lost = lost.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("host").alias("s"), n_lost.alias("n_boilerplate_words"), F.array_sort(F.transform("places", lambda p: p["at"])).alias("boilerplate")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & F.col("host").eqNullSafe(F.col("s"))
    out = base.drop("lines").join(lost, same, "left")
    gone = F.coalesce("n_boilerplate_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        *counts, gone.alias("n_boilerplate_words"), failed.alias("base_failed"), (~failed & (gone <= F.col("n_words") * F.lit(float(max_loss)))).alias("kept"), "boilerplate", "text_hash", "host"
    )


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, without their lines above the limit; further columns stay and may have any names."""
    ident, text, host = options.get("ident", "doc_id"), options.get("text", "text"), options.get("host", "source")
    found = line_quality(docs, **options).where("not kept or boilerplate is not null").dropDuplicates(["doc_id", "text_hash", "host"])
    found = materialise(found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("host").alias("s"), "kept", "boilerplate"), "line-decided").hint("merge")
    rows = nested(docs).withColumn("id", own(ident)).withColumn("hash", F.xxhash64(F.coalesce(own(text), F.lit("")))).withColumn("host", own(host).cast("string"))
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & F.col("host").eqNullSafe(F.col("s"))
    out = rows.join(found, same, "left").where("kept is null or kept").withColumn("all", lines_of(own(text)))
    return unnested(out, docs.columns, {text: spliced(own(text), F.col("all"), F.col("boilerplate"))})


def line_quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of every row, without the places; awkward rows as in ``line_quality``."""
    return line_quality(docs).drop("text_hash", "boilerplate", "host")


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (
  SELECT doc_id, pos, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS win
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
marked AS (SELECT doc_id, pos, (n = 8 AND count(*) OVER (PARTITION BY doc_id, win, n) > 1)::INT AS twice FROM windows),
covered AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM marked),
repeats AS (SELECT doc_id, count(*) AS n_words, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) AS n_dup_lines FROM full_lines WHERE nth > 1 GROUP BY doc_id),
hosts AS (SELECT source, greatest(20.0, count(*) * 0.0001) AS lim FROM documents GROUP BY source),
found AS (SELECT source, k, count(DISTINCT text) AS texts FROM full_lines GROUP BY source, k),
above AS (SELECT f.source, f.k FROM found f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.texts > h.lim),
lost AS (SELECT l.doc_id, sum(l.words) AS n FROM full_lines l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.k = a.k GROUP BY l.doc_id),
base AS (
  SELECT d.doc_id, coalesce(r.n_words, 0)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(t.n, 0)::BIGINT AS n_boilerplate_words
  FROM documents d LEFT JOIN repeats r USING (doc_id) LEFT JOIN dups p USING (doc_id) LEFT JOIN lost t USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_boilerplate_words <= n_words * 0.7 AS kept
FROM base
"""

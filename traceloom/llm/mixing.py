"""Mixing sources to target weights by systematic sampling.

A document of a source with target t and size s is expected t/s times. Within a source the documents stand in order of
(size, salt, id, text), the salt being a digest of the id mod SALT; expected copies are summed along that order, one offset in [0, 1) is added, and a document is
emitted once for every integer that the sum crosses on it. Ordering by size keeps a source's words near its target.

Places in the order are made of three offsets: of the (source, size) among a source's sizes, of the salt among the equals
in size, and a row number within that cell. A source's or a size's rows are never gathered in one task: the
first two are windows over counts, the third over 1/SALT of the rows of one source and size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import quoted, save, times_taken

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SALT = 1024
SEED = 7
#: Sources are a dimension: their totals go to the driver, and more than this is an error, not a cut.
MAX_SOURCES = 200_000


def offset(source: str | None, seed: int = SEED) -> float:
    return int(hashlib.md5(f"{seed}:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32


def targets(sizes: dict[str | None, int], weights=WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Every source's words: proportional to weight, at most cap times its size, together all words.

    Sources in order of cap*size/weight are capped until the common rate of the rest caps no other one; that is where
    sharing the excess again and again ends.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total_weight, rate = sum(sizes.values()), sum(weight.values()), 0.0
    for s in sorted(names, key=lambda s: cap * sizes[s] / weight[s]):
        rate = left / total_weight
        if rate <= cap * sizes[s] / weight[s]:
            break
        left -= cap * sizes[s]
        total_weight -= weight[s]
    return {s: min(rate * weight[s], float(cap * sizes[s])) for s in names}


def mix_copies(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, text_key, size, source_size, target, copies, taken.

    Null texts and texts without words have size 0 and take 0 words. A null source is a source of its own, last in
    order. Null ids come first among equals. Equal rows count each; which of them gets a copy makes no difference. A
    source without words has target 0. An empty table gives an empty one; other columns play no part.
    """
    spark = docs.sparkSession
    text = F.col(quoted(text_col))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), F.xxhash64(text).alias("text_key"), size.alias("size"))
    digest = F.md5(F.coalesce("doc_id", "text_key").cast("string").cast("binary"))  # rows without an id are dealt by their text
    rows = save(rows.withColumn("salt", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SALT), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    by = {r["source"]: r["s"] for r in totals}
    goal = targets(by, weights, cap)
    table = spark.createDataFrame([(s, by[s], goal[s], goal[s] / by[s] if by[s] else 0.0, offset(s, seed)) for s in goal], "source string, source_size long, target double, expected double, u double")
    cells = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "size", before(Window.partitionBy("source").orderBy("size")).alias("at_size"))
    cells = cells.select("source", "size", "salt", before(Window.partitionBy("source", "size").orderBy("salt")).alias("at_salt"))
    same = lambda a, b, *cols: [a["source"].eqNullSafe(b["source"]), *(a[c] == b[c] for c in cols)]
    starts = cells.join(sizes, same(cells, sizes, "size")).select(cells["source"], cells["size"], "salt", (F.col("at_size") + F.col("at_salt")).alias("start"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", "text_key")) - 1)
    placed = placed.join(starts, same(placed, starts, "size", "salt")).select(placed["source"], "doc_id", "text_key", placed["size"], (F.col("start") + F.col("n")).alias("r"))
    table = F.broadcast(table) if len(totals) <= 100_000 else table
    out = placed.join(table, placed["source"].eqNullSafe(table["source"])).drop(table["source"])
    crossed = F.floor(F.col("expected") * (F.col("r") + 1) + F.col("u")) - F.floor(F.col("expected") * F.col("r") + F.col("u"))
    out = out.withColumn("copies", F.least(crossed, F.ceil("expected")).cast("long"))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the input's columns, whatever their names.

    Rows equal in id and text share their copies exactly: as many as mix_copies gives them together. An empty table gives
    an empty one.
    """
    copies = mix_copies(docs, **options).groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
    return times_taken(docs, copies, options.get("id_col", "doc_id"), options.get("text_col", "text"))


#: DuckDB form of mix_copies over the view documents.
ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM rows GROUP BY source),
weighted AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w FROM sums),
ranked AS (
  SELECT source, s, w, {CAP} * s / w AS bound,
    ((SELECT sum(s) FROM sums) - coalesce(sum({CAP} * s) OVER (ORDER BY {CAP} * s / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY {CAP} * s / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
    row_number() OVER (ORDER BY {CAP} * s / w, encode(source) NULLS LAST) AS k FROM weighted),
goal AS (
  SELECT source, s, least((SELECT rate FROM ranked WHERE rate <= bound ORDER BY k LIMIT 1) * w, {CAP} * s) AS target,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM ranked),
placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % {SALT}, doc_id) - 1 AS r FROM rows),
counted AS (
  SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS e, r, u
  FROM placed JOIN goal ON placed.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(e * (r + 1) + u) - floor(e * r + u), ceil(e)) * size AS BIGINT) AS taken FROM counted
"""

"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target is its share of all words; every document of the source expects
target / source_size copies. Within a source the expected copies are prefix-summed over an order by size,
one offset is added, and a document is emitted once for each integer boundary its interval crosses.
The order by size keeps the words taken near the target, and of OFFSETS seeded offsets a source takes the one
whose words come nearest to it (ties: the first). Ranks come in two levels (inside leaves of a size
class and a bucket of ids, then over the leaves' counts), so that no task sorts a whole source.

Defined results: a null or empty text has size 0; null sources form one source, ordered last; a source of
size 0 has target 0 and is not taken; null and repeated doc_ids are sampled row by row, ties broken by a
hash of the text; internal columns start with `__mix_`, so other columns may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SEED, OFFSETS = 17, 16


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row for each source: __mix_of, __mix_total and __mix_target, filled like water up to the caps.

    The windows here run over one row per source, the parts of the mix.
    """
    total = sizes.groupBy(F.col("__mix_source").alias("__mix_of")).agg(F.sum("__mix_size").alias("__mix_total"))
    rank = F.row_number().over(Window.orderBy(F.col("__mix_of") == "", "__mix_of"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    scale = reduce(lcm, weights)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("__mix_full") * F.lit(scale) / F.col("__mix_weight"), "__mix_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = total.select("*", rank.alias("__mix_rank"), weight.alias("__mix_weight"), (F.col("__mix_total") * cap).alias("__mix_full"))
    rest = F.sum("__mix_total").over(whole) - F.coalesce(F.sum("__mix_full").over(before), F.lit(0))
    stops = F.col("__mix_weight") * rest >= F.col("__mix_full") * F.sum("__mix_weight").over(after)
    stopped = ranked.withColumn("__mix_stops", stops)
    left = F.sum("__mix_total").over(whole) - F.sum(F.when(F.col("__mix_stops"), F.col("__mix_full")).otherwise(0)).over(whole)
    share = F.sum(F.when(F.col("__mix_stops"), 0).otherwise(F.col("__mix_weight"))).over(whole)
    target = F.when(F.col("__mix_stops"), F.col("__mix_full").cast("double")).otherwise((F.col("__mix_weight") * left).cast("double") / share)
    return stopped.select("__mix_of", "__mix_total", target.alias("__mix_target"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """The rows of docs with __mix_size, __mix_total, __mix_target and __mix_copies."""
    size = word_count() if size is None else size
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = docs.withColumns({"__mix_size": size, "__mix_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "__mix_id": F.col("doc_id").cast("long"), "__mix_tie": tie})
    n = docs.count()
    buckets = max(1, -int(-(n**0.5) // 16))
    text = F.bin("__mix_size")
    leaf = {"__mix_width": F.length(text), "__mix_head": F.substring(text, 1, 4), "__mix_bucket": F.pmod(F.coalesce("__mix_id", "__mix_size"), F.lit(buckets))}
    keys = ["__mix_source", *leaf]
    sizes = rows.select("__mix_source", "__mix_size", "__mix_id")
    targets = source_targets(sizes, weights, cap)
    counts = sizes.withColumns(leaf).groupBy(*keys).agg(F.count("*").alias("__mix_n"))
    earlier = Window.partitionBy("__mix_source").orderBy(*leaf).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__mix_base", F.coalesce(F.sum("__mix_n").over(earlier), F.lit(0))).drop("__mix_n")
    offset = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), "__mix_of").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    targets = targets.withColumn("__mix_offsets", F.array(*map(offset, range(OFFSETS))))
    rows = rows.withColumns(leaf)
    inner = Window.partitionBy(*keys).orderBy("__mix_size", F.col("__mix_id").asc_nulls_last(), "__mix_tie")
    ranked = rows.withColumn("__mix_rank", F.row_number().over(inner).cast("long"))
    ranked = ranked.join(bases, keys).join(targets, F.col("__mix_source") == F.col("__mix_of"))
    each = F.when(F.col("__mix_total") > 0, F.col("__mix_target") / F.col("__mix_total")).otherwise(F.lit(0.0))
    at = F.col("__mix_base") + F.col("__mix_rank")

    def copies(offset: Column) -> Column:
        return F.when(F.col("__mix_size") > 0, (F.floor(each * at + offset) - F.floor(each * (at - 1) + offset)).cast("long")).otherwise(F.lit(0))

    # The words that each offset would take, in one aggregate over sources.
    taken = [F.abs(F.sum(copies(F.get("__mix_offsets", F.lit(k))) * F.col("__mix_size")) - F.first("__mix_target")) for k in range(OFFSETS)]
    best = ranked.groupBy(F.col("__mix_of").alias("__mix_best_of")).agg(F.array_min(F.array(*(F.struct(x.alias("off"), F.lit(k).alias("k")) for k, x in enumerate(taken))))["k"].alias("__mix_k"))
    chosen = ranked.join(best, F.col("__mix_of") == F.col("__mix_best_of")).withColumn("__mix_copies", copies(F.get("__mix_offsets", F.col("__mix_k"))))
    return chosen.drop(*leaf, "__mix_source", "__mix_of", "__mix_best_of", "__mix_k", "__mix_offsets", "__mix_base", "__mix_rank", "__mix_tie", "__mix_id")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it, in the columns of docs."""
    taken = mix_copies(docs, weights, cap, seed).where("__mix_copies > 0")
    return taken.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)


#: DuckDB's form of op1, over the view documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source
), r AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rk, total * 3 AS fu FROM s
), st AS (
  SELECT *, w * (sum(total) OVER () - coalesce(sum(fu) OVER (ORDER BY fu * 10 / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            >= fu * sum(w) OVER (ORDER BY fu * 10 / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stops FROM r
), t AS (
  SELECT source, total, CASE WHEN stops THEN fu::DOUBLE ELSE
    (w * (sum(total) OVER () - sum(CASE WHEN stops THEN fu ELSE 0 END) OVER ()))::DOUBLE / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM st
), k AS (
  SELECT d.*, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), substr(bin(size), 1, 4),
      coalesce(doc_id, size) % greatest(1, ceil(sqrt((SELECT count(*) FROM d)) / 16))::BIGINT, size, doc_id NULLS LAST) AS rn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT source, j, ('0x' || substr(md5('17:' || j || ':' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range(16) x(j)
), c AS (
  SELECT o.source, o.u, row_number() OVER (PARTITION BY o.source ORDER BY abs(sum(CASE WHEN size > 0 THEN (floor(e * rn + u) - floor(e * (rn - 1) + u))::BIGINT ELSE 0 END * size) - first(target)), j) AS best
  FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source GROUP BY o.source, o.j, o.u
)
SELECT doc_id, size, total AS source_size, target,
  CASE WHEN size > 0 THEN (floor(e * rn + u) - floor(e * (rn - 1) + u))::BIGINT ELSE 0 END * size AS taken
FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND c.best = 1
"""

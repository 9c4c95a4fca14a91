"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. The expected copies are prefix-summed in a fixed order
(size class, hash bucket, size, id), one offset per source is added, and a document is emitted once per integer boundary that its
stretch crosses. The order groups documents of like size, so that the words taken stay near the target.

The prefix sum needs no single task per source: documents fall into blocks (size class x hash bucket), a window numbers the rows of a
block, and a running sum over the blocks of a source gives each block its start. There are more buckets the more documents there are,
so that no block outgrows a task; the blocks of a source that holds a third of all rows are spread over all tasks. The window and the
join with the starts share one shuffle.

Defined cases. A null text has size 0. A null source is a source of its own, last in order. A source of size 0 has target 0 and
none of its documents is taken. Equal documents are told apart by nothing but their order; repeated rows are separate documents.
An empty table gives an empty result. Other columns of the input are kept by mix() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, quoted

#: Weights in the code-point order of sources, repeating; the share of all words to take, and the cap in times of a source's size.
WEIGHTS, SHARE_2X, CAP = (3, 1, 2), 3, 2
#: Hash buckets of a size class: at least so many, and more by powers of two so that there is one for ROWS_EACH documents of the table;
#: the modulus and multiplier of the bucket hash, and that of the offsets.
BUCKETS, ROWS_EACH, PRIME, MIX, SEED = 256, 65_536, (1 << 31) - 1, 40503, 7


def word_count(text):
    """Words [^\\x20\\x09-\\x0D]+ of a text, null: 0; counted on the JVM."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def size_class(size):
    """0 for no words, else 1 + the whole part of the size's binary logarithm."""
    return F.length(F.regexp_replace(F.bin(size), "^0$", "")).cast("long")


def targets(blocks: DataFrame, weights=WEIGHTS, share_2x: int = SHARE_2X, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rank): weighted shares of share_2x / 2 of all words, filled up to the cap, the excess reshared.

    Filling by weight under caps is solved in closed form: sources in order of cap / weight are full up to the first that the level
    reached by the rest does not fill. All sums are of integers, so that the result does not depend on the order of summation.
    There is one row for each source; documents are not in these windows.
    """
    per = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    ordered = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    full = W.orderBy(F.col("source_size") / F.col("w"), "rank")
    before, after = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing)
    x = (
        ordered.withColumn("w", w)
        .withColumn("left_2x", share_2x * F.sum("source_size").over(W.partitionBy()) - 2 * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(after))
        .withColumn("fits", F.col("left_2x") * F.col("w") <= 2 * cap * F.col("source_size") * F.col("w_left"))
        .withColumn("cut", F.min(F.when(F.col("fits"), F.struct(F.row_number().over(full).alias("n"), "left_2x", "w_left"))).over(W.partitionBy()))
        .withColumn("n", F.row_number().over(full))
    )
    level = F.col("w") * F.col("cut.left_2x") / (2 * F.col("cut.w_left"))
    target = F.when(F.col("cut").isNull() | (F.col("n") < F.col("cut.n")), (cap * F.col("source_size")).cast("double")).otherwise(level.cast("double"))
    return x.select("source", "source_size", F.col("rank").cast("long").alias("rank"), target.alias("target"))


def buckets_of(rows: int) -> int:
    n = BUCKETS
    while n * ROWS_EACH < rows:
        n *= 2
    return n


def plan(docs: DataFrame, weights=WEIGHTS, share_2x: int = SHARE_2X, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, the kept columns, size, source_size, target and copies."""
    n_buckets = buckets_of(docs.count())
    doc = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(PRIME))  # ids of the whole range of long, without an overflow
    spread = F.pmod(doc * MIX + F.floor(doc / BUCKETS) * 97, F.lit(n_buckets))
    sized = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("block", (size_class(F.col("size")) * n_buckets + spread).cast("long"))
    if not keep:
        sized = cut(sized)  # ids and sizes only: the texts are read once
    blocks = cut(sized.groupBy("source", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))
    t = targets(blocks, weights, share_2x, cap)
    # a key without nulls, so that window and join need the same partitioning
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    sized, blocks = sized.withColumn("key", key), blocks.withColumn("key", key)
    numbered = sized.withColumn("nth", (F.row_number().over(W.partitionBy("key", "block").orderBy("size", "doc_id")) - 1).cast("long"))
    start = F.coalesce(F.sum("rows").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(blocks.select("key", "block", start.alias("start")), ["key", "block"]).drop("key")
    # one row for each source: as many as the data has, so Spark itself decides by size whether it is broadcast
    placed = placed.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (F.pmod((F.col("rank") + 1) * 61803 + F.lit(SEED) * 7919, F.lit(100_000)) / F.lit(100_000.0)).cast("double")
    at = F.col("start") + F.col("nth")
    copies = (F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)).cast("long")
    return placed.select("doc_id", "source", *keep, "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of docs."""
    packed = docs.select("doc_id", "source", "text", F.struct(*quoted(docs)).alias("row"))  # one column, so that no name can clash
    picked = plan(packed, keep=("row",), **options).filter("copies > 0")
    fields = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return picked.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*fields)


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM words GROUP BY source
), ordered AS (
  SELECT source, source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS rk,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM per
), level AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
         sum(w) OVER (ORDER BY source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft,
         row_number() OVER (ORDER BY source_size / w, rk) AS n
  FROM ordered
), cutoff AS (
  SELECT n AS cut_n, left2 AS cut_left, wleft AS cut_w FROM level WHERE left2 * w <= 4 * source_size * wleft ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, rk,
         CASE WHEN cut_n IS NULL OR n < cut_n THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * cut_left AS DOUBLE) / CAST(2 * cut_w AS DOUBLE) END AS target
  FROM level LEFT JOIN cutoff ON true
), buckets AS (
  SELECT CAST(greatest({BUCKETS}, pow(2, ceil(log2(greatest(1, count(*)) / {ROWS_EACH}.0)))) AS BIGINT) AS nb FROM documents
), reduced AS (
  SELECT *, (doc_id % {PRIME} + {PRIME}) % {PRIME} AS small FROM words
), blocked AS (
  SELECT doc_id, source, size,
         (CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END) * nb
           + ((small * {MIX} + CAST(floor(small / {BUCKETS}) AS BIGINT) * 97) % nb) AS block
  FROM reduced, buckets
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, size, doc_id) - 1 AS pos FROM blocked
), rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ((t.rk + 1) * 61803 + {SEED * 7919}) % 100000 / 100000.0::DOUBLE AS u
  FROM placed p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor((pos + 1) * rate + u) - floor(pos * rate + u)) AS BIGINT) AS taken FROM rated
"""

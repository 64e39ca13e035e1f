"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. *Targets.* All sizes together are shared out by weight; a source's target stops at
   ``cap`` times its size and the excess is shared among the others by weight. The levels
   are found in closed form: sources in order of cap * size / weight reach their cap first.
2. *Streams.* The documents of a source, in order of a seeded hash, form an endless stream of
   words. The source gives the first ``round(target)`` words of it: each document as often as
   the stream passes it, the last one in part. Positions are prefix sums in two levels,
   hash buckets of about ``BUCKET_DOCS`` documents and documents within a bucket, so a hot
   source is many windows.
3. *Blocks.* A source's quota is cut into blocks of ``block_words`` words, or larger ones if there would be more than
   ``MOST_BLOCKS``. A binary tree over
   the output shards splits the quotas: a node gives its left half a multivariate
   hypergeometric draw of the blocks it holds. Every node has a random generator of its own,
   so each shard finds its quotas by walking down from the root, in parallel with the others.
4. *Draws.* A shard takes the next run of its size from each source's blocks in permuted
   order, so no block is taken twice. Within a shard, documents are ordered by hash.

The words taken of a source are exactly ``round(target)``.

Null text has size 0; documents of size 0 are never taken. A null source is a source of its own,
last in order. Repeated rows are separate documents. An empty table gives an empty mix. All columns of
the input, whatever their names, are kept in the struct ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lotline.llm.common import cut_lineage, join_small, packed, text_of, white_words

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET_DOCS = 4096
BLOCK_WORDS = 16_384
MOST_BLOCKS = 800_000_000
"""Blocks grow with the total so that there are no more of them: the generator draws from fewer than 10 ** 9."""
SHARD_BLOCKS = 1024
SEED = 20240601


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, source_no and target, from rows of (source, size).

    Windows over all sources see one row per source, after the map-side sums.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("level", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = (sized.groupBy("source")
               .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
               .withColumn("source_no", F.row_number().over(every) - 1)
               .withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + 1))
               .withColumn("most", (F.col("source_size") * cap).cast("double"))
               .withColumn("level", F.col("most") / F.col("weight")))
    left = (F.sum("source_size").over(all_rows)
            - F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    share = left / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (sources.withColumn("share", share)
            .withColumn("target", F.least("most", F.col("weight") * F.max("share").over(all_rows)))
            .select("source", "source_size", "n_docs", "source_no", "target"))


def place(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED,
          block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the sources with their quotas.

    Texts are read once; what is shuffled of a document is its ids, size and hash.
    """
    source, text = F.col("source"), text_of("text")
    sized = cut_lineage(docs.select(
        F.col("doc_id").alias("doc_id"), source.alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", source, text).alias("h")))
    return _placed(sized, weights, cap, block_words)


def _placed(sized: DataFrame, weights, cap, block_words) -> tuple[DataFrame, DataFrame]:
    sources = cut_lineage(source_targets(sized, weights, cap).withColumn("quota", F.round("target").cast("bigint")))
    block_words = max(block_words, math.ceil((sources.agg(F.sum("quota")).first()[0] or 0) / MOST_BLOCKS))
    sources = (sources.withColumn("blocks", F.ceil(F.col("quota") / block_words))
               .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_DOCS)))
    kept = sources.withColumnRenamed("source", "of")
    rows = join_small(sized, kept, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("bucket", F.floor(unit * F.col("buckets")))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(totals.select("source_no", "bucket",
                                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    within = (Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = join_small(rows, starts, ["source_no", "bucket"], "inner").withColumn(
        "at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    part = F.col("quota") - rounds * F.col("source_size") - F.col("at")
    whole = F.transform(F.sequence(F.lit(0), rounds.cast("int")), lambda e: F.struct(
        e.alias("epoch"),
        F.when(e < rounds, F.col("size")).otherwise(F.greatest(F.lit(0), F.least("size", part))).alias("words"),
        F.floor((e * F.col("source_size") + F.col("at")) / block_words).alias("slot")))
    placed = placed.withColumn("takes", F.filter(whole, lambda t: t["words"] > 0))
    return placed.select("doc_id", "source", "size", "h", "source_no", "source_size", "target", "at",
                         "takes"), sources


def _node_draw(seed: int, low: int, high: int, held: np.ndarray) -> np.ndarray:
    """How many blocks of each source go to the left half of the shards ``low`` up to ``high``."""
    total, half = int(held.sum()), (low + high) // 2
    left = total * (half - low) // (high - low)
    generator = np.random.default_rng([seed, low, high])
    return generator.multivariate_hypergeometric(held, left, method="marginals") if total else held * 0


def shard_quotas(shard: int, shards: int, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each source for one shard."""
    low, high, first, held = 0, shards, np.zeros_like(blocks), blocks
    while high - low > 1:
        half, left = (low + high) // 2, _node_draw(seed, low, high, held)
        if shard < half:
            high, held = half, left
        else:
            low, first, held = half, first + left, held - left
    return first, held


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0 .. n-1: Feistel rounds over the next even power of two, walked into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, n]).integers(1, 1 << 62, 4, dtype=np.uint64) | np.uint64(1)

    def rounds(x):
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right + np.uint64(1)) * key
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & mask)
        return (left << np.uint64(half)) | right

    out = rounds(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = rounds(out[outside])
    return out.astype(np.int64)


def block_shards(sources: DataFrame, shards: int | None = None, seed: int = SEED,
                 shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """source_no, slot and the shard it goes to: each block of every quota once.

    The driver holds one number per source; shards and blocks are rows.
    """
    spark = sources.sparkSession
    quotas = np.array([r["blocks"] for r in sources.orderBy("source_no").select("blocks").collect()],
                      dtype=np.int64)
    n = shards or max(1, math.ceil(int(quotas.sum()) / shard_blocks))

    def draw(batches: Iterator) -> Iterator:
        import pandas as pd  # in the tasks only; the driver has no use for it
        for batch in batches:
            for shard in batch["id"]:
                first, held = shard_quotas(int(shard), n, quotas, seed)
                for source_no in np.flatnonzero(held):
                    run = np.arange(first[source_no], first[source_no] + held[source_no])
                    yield pd.DataFrame({"source_no": source_no, "shard": shard,
                                        "slot": permuted(run, int(quotas[source_no]), seed + int(source_no))})

    return spark.range(n).mapInPandas(draw, "source_no int, shard long, slot long")


def draw_takes(placed: DataFrame, sources: DataFrame, shards: int | None = None,
               seed: int = SEED) -> DataFrame:
    """A row per document and time it is taken: epoch, words and the shard it goes to.

    A document goes whole to the shard that drew the block in which it starts.
    """
    takes = placed.select("*", F.explode("takes").alias("take")).select(
        *[c for c in placed.columns if c != "takes"], "take.epoch", "take.words", "take.slot")
    drawn = cut_lineage(block_shards(sources, shards, seed))
    return join_small(takes, drawn, ["source_no", "slot"], "inner")


def taken_words(placed: DataFrame, takes: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in all) of every document."""
    keys = ["doc_id", "size", "source_size", "target", "source_no", "at", "h"]
    summed = takes.groupBy(*keys).agg(F.sum("words").alias("taken"))
    rest = placed.where(F.size("takes") == 0).select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return summed.unionByName(rest).drop("source_no", "at", "h")


def mix(docs: DataFrame, shards: int | None = None, weights: tuple = WEIGHTS, cap: int = CAP,
        seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed documents: ``row`` (all columns of the input), is_cut, shard, epoch, words and ``place``
    (order within the shard). The text in which a quota ends is cut to its first words, joined by
    spaces; at most one document of a source is.

    Rows are found again by the hash that ordered them, which only rows with equal doc_id, source
    and text share; those few are numbered, and the n-th of them takes the n-th of their places.
    """
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64(
        F.lit(seed), "doc_id", "source", text_of("text")).alias("h"))
    placed, sources = place(docs, weights, cap, seed, block_words)
    placed = cut_lineage(placed)
    by_place = draw_takes(placed, sources, shards, seed).groupBy("h", "at", "size").agg(
        F.collect_list(F.struct("epoch", "words", "shard")).alias("takes"))
    rows_of = placed.groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
    by_hash = cut_lineage(
        by_place.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "size", "takes"))).alias("places"))
        .join(rows_of, "h"))
    joined = join_small(keyed, by_hash, ["h"], "inner")
    single = joined.where("rows = 1").withColumn("copy", F.lit(1))
    equal = joined.where("rows > 1").withColumn("copy", F.row_number().over(Window.partitionBy("h").orderBy("h")))
    rows = single.unionByName(equal).where(F.col("copy") <= F.size("places"))
    rows = rows.withColumn("place", F.get("places", F.col("copy") - 1)).select(
        "row", "h", "copy", "place.size", F.explode("place.takes").alias("take"))
    text = F.col("row")["text"]
    whole = F.col("take.words") >= F.col("size")
    cut = F.when(whole, text).otherwise(
        F.array_join(F.slice(white_words(text), F.lit(1), F.col("take.words").cast("int")), " "))
    return rows.select(F.col("row").withField("text", cut).alias("row"), (~whole).alias("is_cut"), "take.shard",
                       "take.epoch", "take.words", F.xxhash64(F.lit(seed), "h", "copy", "take.epoch").alias("place"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """A folder per shard, the documents of each shuffled within it."""
    (mixed.repartition("shard").sortWithinPartitions("shard", "place")
     .select("shard", "row.*").write.partitionBy("shard").parquet(path))

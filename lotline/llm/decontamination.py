"""Benchmark decontamination by a prefix-filtered set join, built-in expressions only.

A *window* is ten consecutive words of a benchmark item, or the whole of a shorter item. A
document is contaminated where a window occurs in its words.

1. The shingles (five words, or all words of a shorter window) of the items are looked up in
   the documents. How often each occurs there orders them by rarity.
2. A window can only occur where all of its shingles do, so where its rarest one does: that
   one is its prefix. Windows with a shingle that occurs nowhere fall away.
3. Each occurrence of a prefix fixes where the window would start. It must start in the text and
   end in it.
4. What is left is verified word by word against the document.

Documents are held by a digest of their text, so equal texts are searched once and any number of
copies share a result; rows are only joined with what their text gave. Item tables are
broadcast only as far as they are counted to be small (``join_small``).

Texts are lower-cased in A-Z only. Null texts have no words, hit nothing and are hit by
nothing. An item without words has no windows. Repeated item rows count once; a null item_id is not
listed among the items, though its windows hit. An empty benchmark leaves all documents clean; an empty
table of documents gives an empty result. Columns of the input are kept in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import cut_lineage, join_small, packed, text_of

WINDOW = 10
SHINGLE = 5
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case. ``lower`` does the same on an ASCII word, faster."""
    words = F.array_remove(F.split(text, GAPS, -1), "")
    return F.transform(words, lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w))
                       .otherwise(F.translate(w, UPPER, LOWER)))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(words, i, k)))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key (of the window's words), words, size: every distinct window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             item_words(text_of("text")).alias("all_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all_words") - window))
    rows = items.where(F.size("all_words") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("all_words", i + 1, window))).alias("words"))
    return rows.select("item_id", text_key(F.array_join("words", " ")).alias("key"), "words",
                       F.size("words").alias("size")).dropDuplicates(["item_id", "key"])


def _lookups(windows: DataFrame) -> DataFrame:
    """key, size, k, at and hash of every shingle of every distinct window."""
    k = F.least(F.lit(SHINGLE), F.col("size"))
    hashes = F.lit(None)
    for n in range(SHINGLE, 0, -1):
        hashes = F.when(k == n, _shingles(F.col("words"), n)).otherwise(hashes)
    one = windows.dropDuplicates(["key"]).select("key", "size", "words", k.alias("k"), hashes.alias("hashes"))
    return one.select("key", "size", "words", "k", F.size("hashes").alias("needed"),
                      F.posexplode("hashes").alias("at", "hash"))


def _occurrences(docs: DataFrame, hashes: DataFrame, ks: list[int]) -> DataFrame:
    """text_key, n_words, at and hash wherever one of the shingles occurs in a text."""
    texts = docs.select(text_of("text").alias("text")).where("text <> ''")
    texts = texts.select(text_key(F.col("text")).alias("text_key"), item_words(F.col("text")).alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    parts = [texts.select("text_key", "n_words", F.posexplode(_shingles(F.col("words"), k)).alias("at", "hash"))
             for k in ks]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return join_small(rows, hashes, ["hash"], "inner").distinct()


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, at, size, key: every occurrence of every window in every distinct text."""
    windows = cut_lineage(windows_of(benchmark, window))
    lookups = cut_lineage(_lookups(windows))
    ks = sorted(r.k for r in lookups.select("k").distinct().collect())  # at most SHINGLE numbers
    if not ks:
        return _nothing(docs)
    seen = cut_lineage(_occurrences(docs, cut_lineage(lookups.select("hash").distinct()), ks))
    rarity = cut_lineage(seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    present = join_small(lookups, rarity, ["hash"], "inner")
    prefixes = (present.groupBy("key").agg(
        F.min(F.struct("n", "hash", F.col("at").alias("offset"))).alias("rarest"),
        F.count(F.lit(1)).alias("there"), F.first("needed").alias("needed"),
        F.first("size").alias("size"), F.first("words").alias("window"))
        .where("there = needed")
        .select("key", "size", "window", "rarest.hash", "rarest.offset"))
    maybe = join_small(seen, cut_lineage(prefixes), ["hash"], "inner").select(
        "text_key", (F.col("at") - F.col("offset")).alias("at"), "n_words", "size", "key", "window")
    maybe = cut_lineage(maybe.where("at >= 0 and at + size <= n_words").distinct())
    keys = cut_lineage(maybe.select("text_key").distinct())
    texts = docs.select(text_key(text_of("text")).alias("text_key"), text_of("text").alias("text"))
    texts = (join_small(texts, keys, ["text_key"], "left_semi")
             .groupBy("text_key").agg(F.first("text").alias("text"))
             .select("text_key", item_words(F.col("text")).alias("words")))
    near = maybe.join(texts, "text_key")
    return near.where(F.slice("words", F.col("at") + 1, F.col("size")) == F.col("window")).select(
        "text_key", "at", "size", "key")


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "text_key binary, at int, size int, key binary")


def _covered(starts: Column) -> Column:
    """How many places the stretches (at, size), ordered by start, cover together."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n")),
        lambda a: a["n"]).cast("bigint")


def hits_by_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, n_hit and items (sorted ids) of the texts that any window occurs in.

    What is collected per text is bounded by its own words and by the items found in it.
    """
    hits = cut_lineage(found(docs, benchmark, window))
    covered = hits.groupBy("text_key").agg(
        F.collect_set(F.struct("at", "size")).alias("s")).select(
        "text_key", _covered(F.array_sort("s")).alias("n_hit"))
    of = cut_lineage(windows_of(benchmark, window).select("key", "item_id"))
    items = (join_small(hits.select("text_key", "key").distinct(), of, ["key"], "inner")
             .groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return covered.join(items, "text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (all columns of the input), n_words, n_hit, items and contaminated of every document."""
    hits = cut_lineage(hits_by_text(docs, benchmark, window)).withColumnRenamed("text_key", "of")
    rows = docs.select(packed(docs).alias("row"), text_key(text_of("text")).alias("text_key"),
                       F.regexp_count(text_of("text"), F.lit(WORD)).cast("bigint").alias("n_words"))
    joined = join_small(rows, hits, F.col("text_key") == F.col("of"))
    return joined.select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    return decontaminated(docs, benchmark, window).where("not contaminated").select("row.*")

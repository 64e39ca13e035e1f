"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

*Weights.* A shingle is five consecutive words (all words of a shorter text). Its weight in a
text is its count there times its inverse document frequency, the mean over its words. Words
are counted in 2 ** ``IDF_BITS`` buckets of their hash, so the table that every task gets has a fixed
size however large the corpus; a shingle weighs the same in every text, so similarities are exact for
these weights. (The frequency of shingles themselves is unfit as weight here: in a group of a thousand near
copies the shared shingles would count for nothing beside the ones that differ.)

*Sampling.* Each of ``HASHES`` samplers draws a (shingle, level) pair by Ioffe's scheme; two texts
draw the same one with the chance of their weighted Jaccard similarity. Samples are banded, ``ROWS`` to a band;
texts that share a band are candidates. At a similarity of 0.8 a pair is missed once in 500.

*Verification.* Candidates are compared by exact weighted Jaccard similarity, ``SIMILAR`` or more is a link,
and classes are the connected components of the links. No pairs are written down: every text of a bucket is
connected with the bucket's first one, the components of these stars are clusters, and the texts of a cluster meet in one
task, each sent once (``cluster_join``). There, bucket by bucket, each text is compared with all later ones of
another class, so no link between candidates is lost, in crowded buckets neither, while copies join the first
text's class at once.

Equal texts are one text from the signatures on. A null text is an empty text. Texts without
words are alike only if equal. Repeated rows are in one class. An empty table gives an empty result.
Columns of the input other than doc_id and text are not looked at, and ``keep_one`` hands them on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm.cluster_join import PART, joined_classes
from lotline.llm.common import cut_lineage, join_small, packed, text_of, white_words, written
from lotline.llm.signature_trees import Classes
from lotline.operators.components import components
from lotline.operators.spread import join_totals

SHINGLE = 5
SIMILAR = 0.8
HASHES, ROWS = 48, 4
IDF_BITS = 18
POOL_BITS = 16
SLICES = 16
SEED = 71


def text_key(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def word_hashes(text):
    """64-bit hashes of the words of a text, in order; this is all that Python gets to see."""
    return F.transform(white_words(text), lambda w: F.xxhash64(w))


def _bucket_counter(bits: int):
    """Arrow batches of word hashes to slices of the counts of texts by bucket; slice -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for some in _by_words(iter([batch]), column=0):
                words, ends = _flat(some.column(0))
                text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                pairs = np.unique((text << bits) | (words & ((1 << bits) - 1)))
                counts += np.bincount(pairs & ((1 << bits) - 1), minlength=1 << bits)
            texts += batch.num_rows
        parts = counts.reshape(SLICES, -1)
        used = np.flatnonzero(parts.any(1)).tolist()
        rows = [np.array([texts]).tobytes()] + [parts[k].tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array([-1] + used, pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    return count


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order to one sum for each."""
    held, total = None, None
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            if k != held and held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])
            total = counts.copy() if k != held else total + counts
            held = k
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def document_frequencies(texts: DataFrame, bits: int = IDF_BITS) -> tuple[np.ndarray, int]:
    """In how many texts (column ``words``, hashes) a word of each bucket occurs, and how many texts there are.

    A task sends one table of counts, in slices, and 2 ** ``bits`` sums come to the driver.
    """
    rows = texts.select("words").mapInArrow(_bucket_counter(bits), "slice int, counts binary")
    rows = rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_sum_slices, "slice int, counts binary")
    counts, n = np.zeros((SLICES, (1 << bits) // SLICES)), 0
    for r in rows.collect():
        if r["slice"] < 0:
            n = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return counts.ravel(), n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (counts + 1)) + 1).astype(np.float32)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_weights(words: np.ndarray, ends: np.ndarray, idf: np.ndarray):
    """Distinct shingles of many texts: text number, shingle hash and weight, by text and hash.

    ``words`` are the word hashes of all texts in a row, ``ends`` where each text ends in it.
    """
    words = words.astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    runs = np.where(sizes == 0, 0, np.maximum(1, sizes - SHINGLE + 1))
    text = np.repeat(np.arange(len(ends)), runs)
    at = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts, runs)
    width = np.minimum(SHINGLE, sizes)[text]
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    rarity = np.concatenate([idf[(words & np.uint64(len(idf) - 1)).astype(np.int64)], np.zeros(SHINGLE, np.float32)])
    shingle, weight = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32)
    for k in range(SHINGLE):
        inside = k < width
        shingle = np.where(inside, (shingle * _ODD) ^ _mixed(padded[at + k] + np.uint64(k + 1)), shingle)
        weight += np.where(inside, rarity[at + k], np.float32(0))
    weight /= np.maximum(width, 1)
    order = np.lexsort((shingle, text))
    text, shingle, weight = text[order], shingle[order], weight[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    firsts = np.flatnonzero(first)
    counts = np.diff(np.append(firsts, len(text)))
    return text[firsts], _mixed(shingle[firsts]), weight[firsts] * counts.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with variates from a pool that shingles share by hash.

    Sampler k gives shingle f the variates r, c ~ Gamma(2, 1) and b ~ U(0, 1) at place hash_k(f) of its pool. With
    t = floor(ln w / r + b), it draws the shingle of least ln c - r (t - b + 1), and its t.
    """

    def __init__(self, hashes: int = HASHES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32) + np.float32(1e-3)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size) + 1e-12).astype(np.float32)
        self.b = rng.random(size).astype(np.float32)
        self.keys = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Samples of every text that has shingles, as one number each: (texts, hashes)."""
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        lengths = np.diff(np.append(begins, len(text)))
        log_w = np.log(weight)
        out = np.empty((len(begins), len(self.keys)), np.uint64)
        for k, key in enumerate(self.keys):
            place = ((shingle * key) >> np.uint64(64 - POOL_BITS)).astype(np.int64)
            r, b = self.r[place], self.b[place]
            level = np.floor(log_w / r + b)
            score = self.log_c[place] - r * (level - b + 1)
            least = np.minimum.reduceat(score, begins)
            hits = np.flatnonzero(score == np.repeat(least, lengths))
            hit_text = np.searchsorted(begins, hits, side="right") - 1
            drawn = np.empty(len(begins), np.int64)
            drawn[hit_text[::-1]] = hits[::-1]
            out[:, k] = _mixed(shingle[drawn] * np.uint64(31) + level[drawn].astype(np.int64).astype(np.uint64))
        return out


SIGNATURES = "text_key binary, n_words bigint, bands array<bigint>"


def signer(idf: np.ndarray):
    """Arrow batches of (text_key, word hashes) to ``SIGNATURES``; texts without words are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in _by_words(batches):
            words, ends = _flat(batch.column(1))
            text, shingle, weight = shingle_weights(words, ends, idf)
            if not len(text):
                continue
            samples = sampler(text, shingle, weight)
            groups = samples.reshape(len(samples), -1, ROWS)
            bands = np.zeros(groups.shape[:2], np.uint64)
            for k in range(ROWS):
                bands = _mixed(bands * _ODD + groups[:, :, k])
            bands += np.arange(bands.shape[1], dtype=np.uint64)[None, :]
            held = np.unique(text)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(held)), pa.array(np.diff(ends, prepend=0)[held]), _lists(bands.view(np.int64))],
                names=["text_key", "n_words", "bands"])

    return sign


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel()))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[offsets[0]:offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def _by_words(batches: Iterator[pa.RecordBatch], most: int = 1 << 19, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` words, or one text."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (n, bands, word hashes) to (n, data), both lists as bytes one after the other."""
    for batch in batches:
        data = [bands.values.to_numpy().tobytes() + words.values.to_numpy().tobytes()
                for bands, words in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["n", "data"])


class Compared:
    """Texts as ranges of shingles and weights, for comparing one with many."""

    def __init__(self, words: list[np.ndarray], idf: np.ndarray):
        text, shingle, self.weight = shingle_weights(np.concatenate(words), np.cumsum([len(w) for w in words]), idf)
        kinds, self.shingle = np.unique(shingle, return_inverse=True)
        self.sizes = np.bincount(text, minlength=len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = self.weight.astype(np.float64)
        self.total = np.bincount(text, self.weight, len(words))
        self.of_one = np.zeros(len(kinds))

    def similarities(self, one: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of a text with others."""
        own = slice(self.starts[one], self.starts[one] + self.sizes[one])
        self.of_one[self.shingle[own]] = self.weight[own]
        sizes = self.sizes[others]
        firsts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(firsts, sizes) + np.repeat(self.starts[others], sizes)
        shared = np.add.reduceat(np.minimum(self.of_one[self.shingle[at]], self.weight[at]), firsts)
        self.of_one[self.shingle[own]] = 0
        return shared / (self.total[one] + self.total[others] - shared)


def classes_in(idf: np.ndarray, similar: float, data: list[bytes], known: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """The number of a text of each one's class, from the texts' bands and word hashes."""
    width = HASHES // ROWS
    numbers = [np.frombuffer(x, np.int64) for x in data]
    bands = np.stack([x[:width] for x in numbers])
    texts, classes = Compared([x[width:] for x in numbers], idf), Classes(known)
    for band in range(width):
        order = np.argsort(bands[:, band], kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(bands[order, band]) != 0, [True]]))
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            bucket = order[first:last]
            while len(bucket) > 1:
                label = classes.label[bucket]
                if (label == label[0]).all():
                    break
                one, others = bucket[0], bucket[1:][label[1:] != label[0]]
                if side is not None:
                    others = others[side[others] != side[one]]
                seen = (bands[others, :band] == bands[one, :band]).any(1)  # compared in an earlier band
                low, high = (f(texts.total[others], texts.total[one]) for f in (np.minimum, np.maximum))
                others = others[~seen & (low >= high * (similar - 1e-3))]
                if len(others):
                    others = others[texts.similarities(one, others) >= similar - 1e-6]
                    classes.join(np.full(len(others), one), others)
                bucket = bucket[1:]
    return classes.label


def text_classes(docs: DataFrame, similar: float = SIMILAR, most: int = PART) -> DataFrame:
    """text_key and class (the least text number of the class) of every distinct text that has a near-duplicate."""
    texts = docs.select(text_key(text_of("text")).alias("text_key"), word_hashes(text_of("text")).alias("words"))
    idf = inverse_frequencies(*document_frequencies(texts))
    signed = texts.mapInArrow(signer(idf), SIGNATURES).groupBy("text_key").agg(
        F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    signed = written(signed.withColumn("n", F.monotonically_increasing_id()), "signatures")
    spread = signed.select("n", F.explode("bands").alias("bucket"))
    leaders = spread.groupBy("bucket").agg(F.min("n").alias("b"), F.max("n").alias("last")).where("b <> last")
    links = join_totals(spread, leaders, ["bucket"], "inner").where("n <> b").select(F.col("n").alias("a"), "b")
    clusters = components(links).withColumnRenamed("class", "cluster")
    nodes = written(clusters.join(signed, "n").select("n", "cluster", "text_key", "bands", F.col("n_words").alias("weight")), "nodes")
    words = join_small(texts, nodes.select("text_key"), ["text_key"], "left_semi").groupBy("text_key").agg(F.first("words").alias("words"))
    data = words.join(nodes, "text_key").select("n", "bands", "words").mapInArrow(_packer, "n bigint, data binary")
    data = written(data, "candidates")
    classes = joined_classes(nodes.select("n", "cluster", "weight"), data, most, functools.partial(classes_in, idf, similar))
    return nodes.select("n", "text_key").join(classes, "n").select("text_key", "class")


def _groups(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and text_key of every document; and, for every text of a class of several documents,
    the class: its least doc_id, the text that is kept, and how many rows are equally the first."""
    slim = cut_lineage(docs.select("doc_id", text_key(text_of("text")).alias("text_key")))
    classes = cut_lineage(text_classes(docs, similar)).withColumnRenamed("text_key", "of")
    texts = cut_lineage(slim.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")))
    texts = join_small(texts, classes, F.col("text_key") == F.col("of"))
    group = F.coalesce(F.col("class").cast("string"), F.hex("text_key"))
    texts = texts.select("text_key", "rows", group.alias("group"), F.struct("least", "text_key").alias("first"))
    several = (texts.groupBy("group").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"))
               .where("rows > 1").select("group", "first"))
    named = cut_lineage(join_totals(texts.select("text_key", "group"), several, ["group"], "inner").select(
        F.col("text_key").alias("of"), F.col("first.least.doc_id").alias("class_id"), F.col("first.text_key").alias("kept_key")))
    return slim, named


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id and is_kept of every document.

    A class has the least doc_id of its documents (nulls last) as class_id; the document of that id is kept,
    of several the one whose text has the least digest, and of equal rows all are marked. Documents that are like no
    other are their own class.
    """
    slim, named = _groups(docs, similar)
    kept = F.col("of").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("kept_key")))
    return join_small(slim, named, F.col("text_key") == F.col("of")).select(
        "doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        kept.alias("is_kept"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns; of equal rows that would be kept, one."""
    slim, named = _groups(docs, similar)
    chosen = (join_small(slim, named, F.col("text_key") == F.col("of"), "inner")
              .where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("kept_key")))
              .groupBy("text_key").agg(F.count(F.lit(1)).alias("equal")).withColumnRenamed("text_key", "chosen_key"))
    named = cut_lineage(named.join(chosen, F.col("kept_key") == F.col("chosen_key")).drop("chosen_key"))
    rows = docs.select(packed(docs).alias("row"), "doc_id", text_key(text_of("text")).alias("text_key"))
    joined = join_small(rows, named, F.col("text_key") == F.col("of"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("kept_key"))
    single = joined.where(F.col("of").isNull() | (first & (F.col("equal") == 1))).select("row")
    equal = joined.where(F.col("of").isNotNull() & first & (F.col("equal") > 1))
    return single.unionByName(equal.groupBy("text_key").agg(F.first("row").alias("row")).select("row")).select("row.*")

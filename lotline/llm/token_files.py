"""Token ids of documents in Simple-8b files, and reading them back.

A file set is a folder of Parquet files; a row is a *frame* of whole documents:

====================  ======================================================
shard, first          number of the shard (ascending doc_id), ids of it before the frame
doc_ids, lengths      the documents of the frame and how many ids each has
words, escapes        the ids in Simple-8b words and escapes, little endian
word_at, escape_at    where each block of ids starts in either
====================  ======================================================

Spark's writer commits the files, so a lost executor costs its tasks and leaves no
half-written shard. A frame closes at ``FRAME_IDS`` ids, whatever the number of
documents, so a task holds one batch of texts and one frame.

Null text is the empty text: its only id is the end id. Null doc_ids come first.
Rows that repeat a doc_id stay, next to each other in order of a hash of their text.
An empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lotline.llm import simple8b
from lotline.llm.common import cut_lineage, join_small, text_of, tidy
from lotline.llm.word_ids import Cut, WordIds

FRAME_IDS = 1 << 19
END_ID = 0
BATCH_BYTES = 1 << 19
"""Texts are coded in batches of about as many bytes."""

FRAME = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("words", T.BinaryType()), T.StructField("escapes", T.BinaryType()),
    T.StructField("word_at", T.ArrayType(T.IntegerType())),
    T.StructField("escape_at", T.ArrayType(T.IntegerType()))])
FRAME_ARROW = pa.schema([
    ("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary()),
    ("word_at", pa.list_(pa.int32())), ("escape_at", pa.list_(pa.int32()))])


class Coder:
    """Ids of texts by way of the tokenizers library, which codes whole texts and words (see ``word_ids``)."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        [self.line_feed] = self._ids("\n")
        self.plain = WordIds(self._whole, self.words, self.line_feed)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._ids(text), np.uint32)

    def words(self, words: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one go, with a line feed after each to tell where it ends."""
        before = " " if spaced else ""
        lists = [words[at:at + 256] for at in range(0, len(words), 256)]
        joined = [before + ("\n" + before).join(some) + "\n" for some in lists]
        coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(some.ids, np.uint32) for some in coded])
        ends = np.flatnonzero(ids == self.line_feed)
        return ids[ids != self.line_feed], np.diff(ends, prepend=-1) - 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and each one's number of them."""
        return self.plain(Cut(texts, spaced=False, ended=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [raw[first:end] for first, end in zip([0] + ends, ends)]


@functools.cache
def coder(tokenizer_path: str) -> Coder:
    """One for all tasks of a worker process."""
    return Coder(tokenizer_path)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The rows (id, text) of the batches, cut so that each holds about ``most`` bytes of text, or one text."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy())])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            yield batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)
            first = last


def _lists(values: np.ndarray, of: pa.DataType) -> pa.Array:
    """One list with all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of))


def encoder(tokenizer_path: str, end_id: int = END_ID):
    """Arrow batches of (doc_id, text) to frames."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, shard, first = coder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, docs, lengths, held = [], [], [], 0

        def frame() -> pa.RecordBatch:
            words, escapes, word_at, escape_at = simple8b.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, docs))], pa.int32()), pa.concat_arrays(docs)),
                _lists(np.concatenate(lengths), pa.int64()), pa.array([words.tobytes()], pa.binary()),
                pa.array([escapes.tobytes()], pa.binary()), _lists(word_at, pa.int32()), _lists(escape_at, pa.int32())],
                schema=FRAME_ARROW)

        for doc_ids, texts in by_bytes(batches):
            some, counts = coded.ids(texts)
            some, counts = np.insert(some, np.cumsum(counts), np.uint32(end_id)), counts + 1
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            while at < len(counts):  # a frame closes with the document that fills it
                last = min(len(counts), int(np.searchsorted(ends, ends[at] + FRAME_IDS - held)))
                ids.append(some[ends[at]:ends[last]])
                docs.append(doc_ids.slice(at, last - at))
                lengths.append(counts[at:last])
                held += int(ends[last] - ends[at])
                at = last
                if held >= FRAME_IDS:
                    yield frame()
                    first, ids, docs, lengths, held = first + held, [], [], [], 0
        if docs:
            yield frame()

    return frames


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``path``, in ascending order of doc_id.

    One range shuffle orders the documents; the hash of the text as second key splits a
    doc_id that very many rows share.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(tidy(encoder(tokenizer_path, end_id)), FRAME).write.parquet(path)


def _frames(rows: pa.RecordBatch):
    """Per frame: its documents' ids, start in all the files and lengths, and its ids. One frame at a time is held as objects."""
    for at in range(rows.num_rows):
        [row] = rows.slice(at, 1).to_pylist()
        ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u4"),
                              row["word_at"], row["escape_at"], sum(row["lengths"]))
        lengths = np.array(row["lengths"], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        yield row["doc_ids"], starts, lengths, row["before"] + row["first"], ids


def _read_ids(batches):
    for batch in batches:
        for docs, starts, lengths, before, ids in _frames(batch):
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(starts + before),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()),
                                         pa.array(ids.astype(np.int64)))], names=["doc_id", "start", "ids"])


def _read_digests(batches):
    for batch in batches:
        for docs, starts, lengths, before, ids in _frames(batch):
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(starts + before), pa.array(lengths),
                pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The frames, each with the number of ids in earlier shards: one row per shard is summed."""
    frames = spark.read.schema(FRAME).parquet(path)
    shards = frames.groupBy("shard").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return join_small(frames, cut_lineage(before), ["shard"], "inner").select(
        *[f.name for f in FRAME], "before")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files."""
    return _placed(spark, path).mapInArrow(tidy(_read_ids), "doc_id bigint, start bigint, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""
    return _placed(spark, path).mapInArrow(
        tidy(_read_digests), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

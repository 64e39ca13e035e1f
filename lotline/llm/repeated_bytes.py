"""Removal of long repeated byte strings by a distributed merge sort of sampled suffixes.

Each byte that is covered by a 200-byte string which also starts anywhere else, in another text or the same, goes.
All copies go, and what is left is judged on the input.

1. Every text gives its anchors (``suffix_runs``): about one in seventy bytes. Grams that occur once
   cannot belong to a repeated window and their anchors fall away.
2. The suffixes at the other anchors, with the bytes before them that their windows reach, are sorted
   task by task into front-coded runs and exchanged by gram.
3. The runs of a part are merged by a loser tree that never compares a known prefix again. The merged order and its
   LCPs say which windows occur more than once.
4. The repeated windows of a text, as stretches, meet the text again and are cut out.

An anchor is one number, ``at``: its place and how far before it its first and last window start. Its gram is
hashed anew from the text where it is needed. A stretch is one number too, its start and end. So the tables that meet
the texts hold eight bytes an anchor or a stretch, and a text's key.

Equal texts take part once: all of a text that has a copy goes if it has 200 bytes. An anchor gram with more than
``HOT`` occurrences would make one part too large, so its windows are compared by 128-bit hashes
instead, counted map-side first, which spreads them over all tasks. The same windows are found either way.

Null texts are empty. Texts under 200 bytes lose nothing. Repeated rows are copies. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lotline.llm import suffix_runs as runs
from lotline.llm.common import cut_lineage, join_small, text_of, tidy as _tidy, written
from lotline.operators.spread import join_totals

HOT = 20_000
PART_SUFFIXES = 50_000
BROADCAST_BYTES = 1 << 27
ANCHORS = "text_key binary, at bigint, gram bigint"
RUN = ("part int, lcps array<int>, rests binary, lengths array<int>, lefts binary, left_lengths array<int>, "
       "text_keys binary, ats array<bigint>")
STRETCH = "text_key binary, span bigint"
KEY_BYTES = 32
RUNS_AT_ONCE = 64


def text_key(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _at(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Anchors as numbers. Windows start less than ``SPAN`` bytes before their anchor, which a byte holds."""
    return place << 16 | (place - lo) << 8 | (place - hi)


def _placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, lo and hi of anchors."""
    place = at >> 16
    return place, place - (at >> 8 & 255), place - (at & 255)


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, (offsets[1:] - offsets[0]).astype(np.int64)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``BATCH_BYTES`` of text, or one text."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        ends = np.concatenate([[0], _laid_out(texts)[1]])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + runs.BATCH_BYTES, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _by_bytes(batches, 1):
        data, ends = _laid_out(batch.column(1))
        place, lo, hi, gram = runs.anchors(data, ends)
        text = np.searchsorted(ends, lo, side="right")
        begin = np.concatenate([[0], ends])[text]
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(text)), pa.array(_at(place - begin, lo - begin, hi - begin)),
            pa.array(gram.view(np.int64))], names=["text_key", "at", "gram"])


def _run_maker(parts: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, 1):
            keys, held = batch.column(0), batch.column(2)
            data, ends = _laid_out(batch.column(1))
            text = np.repeat(np.arange(len(ends)), pc.list_value_length(held).to_numpy())
            begin = np.concatenate([[0], ends])[text]
            at = held.flatten().to_numpy()
            place, lo, hi = _placed(at)
            part = (runs.gram_hashes_at(data, begin + place) % np.uint64(parts)).astype(np.int64)
            by_part: dict[int, list] = {}
            for p, t, number, first, middle, last in zip(part.tolist(), text.tolist(), at.tolist(), (begin + lo).tolist(),
                                                         (begin + place).tolist(), (begin + hi).tolist()):
                by_part.setdefault(p, []).append(
                    (data[middle:last + runs.LENGTH].tobytes(), data[first:middle].tobytes(), keys[t].as_py(), number))
            rows = []
            for p, found in by_part.items():
                found.sort()
                lcps, rests, lengths = runs.front_coded([f[0] for f in found])
                rows.append({"part": p, "lcps": lcps, "rests": rests, "lengths": lengths,
                             "lefts": b"".join(f[1] for f in found), "left_lengths": [len(f[1]) for f in found],
                             "text_keys": b"".join(f[2] for f in found), "ats": [f[3] for f in found]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RUN_ARROW)

    return make


_ints = pa.list_(pa.int32())
RUN_ARROW = pa.schema([("part", pa.int32()), ("lcps", _ints), ("rests", pa.binary()), ("lengths", _ints),
                       ("lefts", pa.binary()), ("left_lengths", _ints), ("text_keys", pa.binary()),
                       ("ats", pa.list_(pa.int64()))])


def _part_stretches(rows: list[dict]) -> pa.RecordBatch:
    """Repeated stretches of one part from its runs."""
    order_run, lcps = [], []
    for run, _, lcp in runs.merged([runs.expanded(r["lcps"], r["rests"], r["lengths"]) for r in rows]):
        order_run.append(run)
        lcps.append(lcp)
    # The n-th time a run comes up is its n-th suffix.
    order_run = np.array(order_run)
    sizes = np.array([len(r["ats"]) for r in rows])
    order = np.argsort(order_run, kind="stable")
    nth = np.empty(len(order_run), np.int64)
    nth[order] = np.arange(len(order_run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = (np.cumsum(sizes) - sizes)[order_run] + nth
    at, all_lengths = (np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("ats", "left_lengths"))
    place, lo, hi = _placed(at[flat])
    length = all_lengths[flat]
    keys = np.frombuffer(b"".join(r["text_keys"] for r in rows), f"V{KEY_BYTES}")[flat]
    data = np.frombuffer(b"".join(r["lefts"] for r in rows), np.uint8)
    left_end = np.cumsum(all_lengths)[flat]
    left = np.zeros((len(flat), runs.SPAN - 1), np.uint8)
    for o in range(1, runs.SPAN):
        has = length >= o
        left[has, o - 1] = data[left_end[has] - o]
    again = runs.repeated_windows(np.array(lcps), left, place - hi, place - lo)
    return _stretches(again, keys, place)


def _stretches(again: np.ndarray, keys: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Bytes covered by runs of repeated windows; windows are at ``place - column``."""
    padded = np.zeros((len(again), again.shape[1] + 2), np.int8)
    padded[:, 1:-1] = again
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([
        pa.array([k.tobytes() for k in keys[row]], pa.binary()),
        pa.array((place[row] - after + 1) << 32 | (place[row] - first + runs.LENGTH))], names=["text_key", "span"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of part to stretches, one part at a time."""
    part, rows = None, []
    for batch in batches:
        # A batch holds the runs of several parts, so only a few at a time become Python objects.
        for first in range(0, batch.num_rows, RUNS_AT_ONCE):
            for row in batch.slice(first, RUNS_AT_ONCE).to_pylist():
                if row["part"] != part and rows:
                    yield _part_stretches(rows)
                    rows = []
                part = row["part"]
                rows.append(row)
    if rows:
        yield _part_stretches(rows)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of hot anchors: two hashes, text and start."""
    for batch in _by_bytes(batches, 1):
        for key, text, held in zip(*batch.columns):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            _, lo, hi = _placed(held.values.to_numpy())
            starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
            hashes = [runs.gram_hashes(x, runs.LENGTH)[starts] for x in (data, np.uint8(255) - (data ^ (data << 3)))]
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)),
                pa.array([key.as_py()] * len(starts), pa.binary()), pa.array(starts.astype(np.int32))],
                names=["h1", "h2", "text_key", "start"])


def _with_anchors(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """Texts of the pool with their anchors in an array, which the text's own length bounds."""
    held = cut_lineage(anchors.groupBy("text_key").agg(
        F.collect_list("at").alias("anchors")).withColumnRenamed("text_key", "of"))
    joined = join_small(pool, held, F.col("text_key") == F.col("of"), "inner", BROADCAST_BYTES)
    return joined.select("text_key", "text", "anchors")


def repeated_stretches(pool: DataFrame) -> DataFrame:
    """text_key and span (start << 32 | end) of stretches that repeated windows cover, of the texts in ``pool``
    (text_key, text)."""
    texts = pool.where(F.octet_length("text") >= runs.LENGTH)
    anchors = written(texts.mapInArrow(_tidy(_anchors), ANCHORS), "anchors")
    counts = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(join_totals(anchors, counts, ["gram"], "inner"), "repeated-anchors")
    hot = repeated.where(F.col("n") > HOT)
    cool = repeated.where(F.col("n") <= HOT)
    parts = max(1, math.ceil(cool.count() / PART_SUFFIXES))
    coded = _with_anchors(texts, cool).mapInArrow(_tidy(_run_maker(parts)), RUN)
    # A part is an even share of the grams, so its size follows from PART_SUFFIXES and HOT.
    found = coded.repartition("part").sortWithinPartitions("part").mapInArrow(_tidy(_merge), STRETCH)
    if hot.limit(1).count():
        hashed = written(_with_anchors(texts, hot).mapInArrow(
            _tidy(_window_hashes), "h1 bigint, h2 bigint, text_key binary, start int"), "hot-windows")
        again = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = found.unionByName(join_totals(hashed, again, ["h1", "h2"], "inner").select(
            "text_key", (F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("start") + runs.LENGTH).alias("span")))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _by_bytes(batches, 1):
        rows = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc_id, text, copied, stretches in zip(*batch.columns):
            data, spans = memoryview(text.as_buffer()), []
            if copied.as_py() and len(data) >= runs.LENGTH:
                spans = [[0, len(data)]]
            elif stretches.is_valid:
                for start, end in (divmod(s, 1 << 32) for s in sorted(stretches.as_py())):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
            at, kept = 0, []
            for start, end in spans + [[len(data), len(data)]]:
                kept.append(bytes(data[at:start]))
                at = end
            kept = b"".join(kept)
            for name, value in zip(rows, (doc_id.as_py(), len(data), len(data) - len(kept), len(spans),
                                          hashlib.sha256(kept).hexdigest(), kept)):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64())] + [pa.array(rows[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")]
            + [pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.binary())], names=list(rows))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    copied = cut_lineage(rows.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
        .withColumnRenamed("text_key", "copy_key"))
    rows = join_small(rows, copied, F.col("text_key") == F.col("copy_key"))
    is_copy = F.col("copy_key").isNotNull()
    pool = rows.where(~is_copy | F.col("doc_id").eqNullSafe(F.col("first"))).select("text_key", "text")
    stretches = cut_lineage(repeated_stretches(pool).groupBy("text_key").agg(
        F.collect_set("span").alias("stretches")).withColumnRenamed("text_key", "of"))
    # Copies go as a whole and need no stretches, so a text that very many rows share is not shuffled.
    single = join_small(rows.where(~is_copy), stretches, F.col("text_key") == F.col("of"), limit=BROADCAST_BYTES)
    whole = rows.where(is_copy).withColumn("stretches", F.lit(None).cast("array<bigint>"))
    joined = single.select(*whole.columns).unionByName(whole)
    return joined.select("doc_id", "text", is_copy.alias("copied"), "stretches").mapInArrow(
        _tidy(_cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")

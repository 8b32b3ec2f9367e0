"""Removal of repeated byte strings by a depth-limited radix order of suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere
else.  Suffixes are ordered only as deep as needed, by digits that are taken most
significant first, and only suffixes that still share all their digits with another go
on to the next:

1. The first digit of the window at a place is the smallest hash among its ``GRAM``-byte
   grams (leftmost of equals).  Neighbouring windows mostly have it from the same place,
   so a run of them is one row (digit, hash of the run's whole bytes).  A digit that
   occurs in one run only belongs to windows that occur once; these runs are dropped.
2. The second digit is the run's whole content.  Runs with equal content repeat in all
   their windows.
3. Only runs with a repeated first digit and a content of their own - the edges of
   repeated passages - go on, together with one run of each content that shares their
   first digit: their bytes are dealt by the first digit and ordered to full depth by
   the hash of all ``length`` bytes of each window; equal groups are the repeated windows.
   First digits with more than ``MANY`` contents are not brought together in a task:
   their windows are counted as rows, with partial aggregation.

A very long text is cut into stretches that overlap in ``length - 1`` bytes, so that each
window lies in one of them; a run that a cut ends early is compared as an edge.

Equal strings have equal digits at every pass, so the groups are those of a full suffix
order cut at ``length``.  The first passes are grouped counts with partial aggregation
and semi-joins that send rows only; texts cross the network compressed, once for the
edges and once for the cut.  Contents and windows are compared by two 64-bit hashes, the
first digit and their own; documents are told apart by 128 bits of id and text.

Defined cases: a null text is empty; matches never cross documents; texts shorter than
``length`` lose nothing; overlapping repeats inside a document count; repeated rows are
copies of each other and lose everything that they share, in each of them; rows with a
null or repeated id are told apart by their text; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm import _text
from meshlark.llm._store import materialise
from meshlark.llm._worker import frugal

LENGTH, GRAM = 200, 32
#: Contents with the same first digit that one task may hold (some 300 bytes each).
MANY = 50_000


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common smallest gram: row, start in the row, windows, digit, content."""
    n, width = len(data), length - gram + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    prefix = _text.prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashes = _text.span_hash(prefix, at, at + gram)
    # order by the upper half of the hash, then by place
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    # smallest of each `width` grams, from running minima inside stretches of that width
    stretch = -(-len(packed) // width)
    padded = np.full(stretch * width, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    padded[: len(packed)] = packed
    table = padded.reshape(stretch, width)
    onward = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(back[:windows], onward[width - 1 : width - 1 + windows])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(n + 1, dtype=np.int32)  # windows that lie inside a row
    size = np.diff(offsets)
    has = size >= length
    np.add.at(fits, offsets[:-1][has], 1)
    np.add.at(fits, offsets[1:][has] - length + 1, -1)
    inside = np.cumsum(fits)[:windows] > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    new[offsets[:-1][has & (offsets[:-1] < windows)]] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], windows), offsets[row + 1] - length + 1)
    return row, start - offsets[row], stop - start, hashes[anchor[start]], _text.span_hash(prefix, start, stop - 1 + length)


def _digits(length: int, gram: int):
    """Only the first digits, with how often each occurs in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.text_buffer(batch.column(0))
            for _, _, own, edge in _text.overlapping(data, offsets, length - 1):
                digit, n = np.unique(runs(own, edge, length, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(digit.view(np.int64)), pa.array(n)], names=["digit", "n"])

    return run


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.text_buffer(batch.column(1))
            key = batch.column(0)
            for a, at, own, edge in _text.overlapping(data, offsets, length - 1):
                row, start, count, digit, content = runs(own, edge, length, gram)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(a + row)), pa.array((at + start).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(digit.view(np.int64)), pa.array(content.view(np.int64))], names=["key", "start", "n", "digit", "content"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, with their size, for the way to another partition."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        data, offsets = _text.text_buffer(batch.column(2))
        edge = offsets.tolist()
        made = [codec.compress(data[a:b], asbytes=True) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(made, pa.binary())], names=["id", "key", "size", "packed"])


def _unpacked(batch: pa.RecordBatch, i: int, size: int, packed: int) -> bytes:
    n = batch.column(size)[i].as_py()
    return pa.Codec("zstd").decompress(batch.column(packed)[i].as_py(), n, asbytes=True) if n else b""


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same for the others."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


def _bodies(length: int):
    """Bytes of the runs of each text: rows (key, size, packed, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            weight = 0
            for i in range(batch.num_rows):
                text = _unpacked(batch, i, 1, 2)
                for r in batch.column(3)[i].as_py():
                    out.append((r["digit"], keys[i], r["start"], r["n"], r["open"], r["many"], text[r["start"] : r["start"] + r["n"] - 1 + length]))
                    weight += r["n"] + length
                if weight > 4 << 20 or (out and i == batch.num_rows - 1):
                    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["digit", "key", "start", "n", "open", "many", "body"])
                    out, weight = [], 0

    return run


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of its row, and hash, of each window of the bodies."""
    data, offsets = _text.text_buffer(batch.column(6))
    count = batch.column(3).to_numpy().astype(np.int64)
    at = _ragged(offsets[:-1], count)
    return np.repeat(np.arange(len(count)), count), _text.span_hash(_text.prefix_hash(data), at, at + length)


def _together(length: int):
    """Repeated windows of the open runs, as runs (key, start, n); rows come sorted by digit."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        row, window = _windows(batch, length)
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        first = np.concatenate(([0], np.cumsum(batch.column(3).to_numpy().astype(np.int64))[:-1]))
        again = np.flatnonzero((count[inverse.reshape(-1)] > 1) & batch.column(4).to_numpy(zero_copy_only=False)[row])
        turn = np.ones(len(again), dtype=bool)
        turn[1:] = (np.diff(again) > 1) | (row[again[1:]] != row[again[:-1]])
        begin = np.flatnonzero(turn)
        n = np.diff(np.append(begin, len(again)))
        own = row[again[begin]]
        start = batch.column(2).to_numpy()[own] + (again[begin] - first[own])
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            digit = batch.column(0).to_numpy()
            cuts = [*(np.flatnonzero(np.diff(digit)) + 1).tolist(), batch.num_rows]
            lengths = np.concatenate(([0], np.cumsum(batch.column(3).to_numpy().astype(np.int64) + length)))
            at = 0
            for cut in cuts:
                if held and size > 1 << 20 and held[-1].column(0)[-1].as_py() != digit[at]:
                    yield found(held)
                    held, size = [], 0
                if cut == cuts[-1] or size + lengths[cut] - lengths[at] > 1 << 20:
                    held.append(batch.slice(at, cut - at))
                    size += int(lengths[cut] - lengths[at])
                    at = cut
        if held:
            yield found(held)

    return run


def _apart(length: int):
    """The windows of the bodies as rows (digit, key, start, open, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                row, window = _windows(part, length)
                start = _ragged(part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), part.column(4).take(pa.array(row)), pa.array(window.view(np.int64))], names=["digit", "key", "start", "open", "window"])

    return run


def _cut(length: int, id_type: str):
    """Removed spans and what is left: rows (id, size, packed, starts, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digest = [], [], [], []
            for i in range(batch.num_rows):
                raw = _unpacked(batch, i, 1, 2)
                sizes.append(len(raw))
                starts = batch.column(3)[i].as_py()
                if not starts:
                    removed.append(0)
                    spans.append([])
                    digest.append(hashlib.sha256(raw).hexdigest())
                    continue
                start, count = np.array(starts, dtype=np.int64), np.array(batch.column(4)[i].as_py(), dtype=np.int64)
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count - 1 + length, -1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in turns.tolist()])
                digest.append(hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, in bytes)."""
    # equal ids with different texts are different documents; rows that agree in both get the same answer
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.to_json(F.struct("id")), F.lit("")).cast("binary"), F.lit("\n").cast("binary"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))))))
    id_type = own.schema["id"].dataType.simpleString()

    # written first, so that the semi-join below reads two plain exchanges and a common digit's partition can be split
    digits = materialise(own.select("text").mapInArrow(frugal(_digits(length, gram)), "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).where("n > 1").select("digit"), "digits")
    found = own.select("key", "text").mapInArrow(frugal(_runs(length, gram)), "key binary, start int, n int, digit long, content long")
    alike = materialise(found.join(digits, "digit", "left_semi"), "runs")

    contents = materialise(alike.groupBy("digit", "content").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "n")).alias("one")), "contents")
    whole = alike.join(contents.where("copies > 1").select("digit", "content"), ["digit", "content"], "left_semi").select("key", "start", "n")
    mixed = contents.groupBy("digit").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 AND fewest = 1").select("digit", (F.col("kinds") > MANY).alias("many"))
    apart = contents.join(mixed, "digit").select("one.key", F.struct("digit", "one.start", "one.n", (F.col("copies") == 1).alias("open"), "many").alias("run"))
    by_text = apart.groupBy("key").agg(F.collect_list("run").alias("runs"))
    packed = own.select("id", "key", "text").mapInArrow(frugal(_packed), f"id {id_type}, key binary, size long, packed binary")
    # the same text may lie in several rows with the same key; one of them will do
    texts = packed.select("key", "size", "packed").join(by_text, "key").dropDuplicates(["key"]).select("key", "size", "packed", "runs")
    bodies = materialise(texts.mapInArrow(frugal(_bodies(length)), "digit long, key binary, start int, n int, open boolean, many boolean, body binary"), "bodies")
    few = bodies.where("NOT many").repartition("digit").sortWithinPartitions("digit").mapInArrow(frugal(_together(length)), "key binary, start int, n int")
    windows = bodies.where("many").mapInArrow(frugal(_apart(length)), "digit long, key binary, start int, open boolean, window long")
    again = windows.groupBy("digit", "window").agg(F.count("*").alias("n")).where("n > 1").select("digit", "window")
    edges = few.union(windows.where("open").join(again, ["digit", "window"], "left_semi").select("key", "start", F.lit(1).alias("n")))

    gone = whole.union(edges).groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    run, schema = _cut(length, id_type)
    out = packed.join(gone, "key", "left").select("id", "size", "packed", "starts", "counts").mapInArrow(frugal(run), schema)
    return out.withColumnRenamed("id", id_col)

"""Near-duplicate documents by SuperMinHash.

Each document becomes the set of its distinct five-word shingles (64-bit hashes).
Documents with equal sets form a class at once.  Every class gets a SuperMinHash
signature: each element ranks all slots by a permutation of its own, slot values are
rank plus a uniform fraction, and the sketch of a document stops as soon as no later
rank can lower any slot.  Bands of ``ROWS`` slots give candidate buckets; pairs are
confirmed on the full sets, and confirmed links are joined to components.

A bucket is never expanded into pairs.  Its smallest document is its centre, and every
other member is confirmed against the centre alone, in salted parts of ``STAR`` members,
so a bucket of any size is linear work in tasks of bounded size.  What these links leave
are buckets of three or more members in several components: members that missed their
centre, but may be linked with one another.  Such buckets, joined where they share
members, form groups; in each, the members outside its largest component are compared
with all others, and those inside it not with each other, as no link between them could
join anything.  A side of more than ``BLOCK`` shingles is cut into blocks by hash, and
each two blocks meet in a task of their own, so that no task holds more than two blocks
and no pair that matters is left out.

25 bands of 5 slots miss a pair at J = 0.85 with probability 4e-7 and one at J = 0.80 with 5e-5.

Defined cases: a document without words or text has an empty set and is linked with
nothing; with fewer than five words the whole sequence is its one shingle; repeated
rows are copies of each other, and rows that share an id share their links; other columns are ignored; an empty table gives no
rows.  Ids must not be null (rows with a null id are reported as their own component,
null, and kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm import _text
from meshlark.llm._store import materialise, release, small
from meshlark.llm._worker import frugal
from meshlark.llm.components import components

SLOTS, BANDS, ROWS = 128, 25, 5
WIDTH = 5
#: Shingles of a block.
BLOCK = 250_000
#: Members that meet a copy of their bucket's centre in one part.
STAR = 256
#: Shingles that are sketched together.
PART = 1 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows, sorted within each row, and n + 1 row edges."""
    n = len(offsets) - 1
    words, row = _text.word_hashes(data, offsets, _text.NOT_BLANK)
    size = np.bincount(row, minlength=n)
    m = len(words) - WIDTH + 1
    if m > 0:
        whole = row[:m] == row[WIDTH - 1 :]
        mixed = np.zeros(m, dtype=np.uint64)
        for j in range(WIDTH):
            mixed += words[j : j + m] * _ODD[j]
        long_hash, long_row = _text.mix(mixed[whole]), row[:m][whole]
    else:
        long_hash, long_row = np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.concatenate(([0], np.cumsum(size)))
    short = np.flatnonzero((size > 0) & (size < WIDTH))
    short_hash = np.zeros(len(short), dtype=np.uint64)
    for j in range(WIDTH - 1):
        has = size[short] > j
        short_hash[has] += words[edge[short[has]] + j] * _ODD[j]
    short_hash = _text.mix(short_hash + size[short].astype(np.uint64))
    values, rows = np.concatenate((long_hash, short_hash)), np.concatenate((long_row, short))
    if len(short):
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    at = np.searchsorted(rows, np.arange(n + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[first], np.concatenate(([0], np.cumsum(first)))[at]


def signatures(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, one row of SLOTS values for each row of shingles; the top byte is the rank."""
    n = len(edge) - 1
    out = np.full(n * SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for lo in range(0, len(values), PART):  # a slot keeps the least of all parts
        rows = np.clip(edge - lo, 0, min(PART, len(values) - lo))
        _lower(out, values[lo : lo + PART], np.repeat(np.arange(n), np.diff(rows)), np.flatnonzero(np.diff(rows)))
    return out.reshape(n, SLOTS)


def _lower(out: np.ndarray, values: np.ndarray, owner: np.ndarray, going: np.ndarray) -> None:
    """Put the ranks of these shingles into the slots of their owners, as long as a slot could still be lowered."""
    key = _text.mix(values ^ _ODD[4])
    part = np.arange(len(values))
    mask, byte = np.uint64(SLOTS - 1), np.uint64(8)
    for rank in range(SLOTS):
        k = key[part]
        slot = np.full(len(part), rank, dtype=np.uint64)
        for turn in range(3):  # a permutation of the slots that belongs to the element
            bits = k >> np.uint64(16 * turn)
            slot = (slot * (bits | np.uint64(1)) + (bits >> byte)) & mask
            slot ^= slot >> np.uint64(3 + turn % 2)
        fraction = _text.mix(k + np.uint64(rank * int(_ODD[0]) & 0xFFFFFFFFFFFFFFFF)) >> byte
        np.minimum.at(out, owner[part] * SLOTS + slot.astype(np.int64), fraction | (np.uint64(rank) << np.uint64(56)))
        # a document goes on while any slot could still be lowered by the next rank
        most = out.reshape(-1, SLOTS)[going].max(axis=1)
        still = most >= (np.uint64(rank + 1) << np.uint64(56)) if rank + 1 < SLOTS else np.zeros(len(going), bool)
        if not still.all():
            going = going[still]
            if not len(going):
                break
            active = np.zeros(len(out) // SLOTS, dtype=bool)
            active[going] = True
            part = part[active[owner[part]]]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        mixed = np.full(len(signature), b + 1, dtype=np.uint64)
        for j in range(ROWS):
            mixed = _text.mix(mixed + signature[:, b * ROWS + j] * _ODD[j])
        out[:, b] = mixed
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.text_buffer(batch.column(1))
        for a, b in _text.chunks(offsets):
            values, edge = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n, size = b - a, np.diff(edge)
            bands = band_hashes(signatures(values, edge)).view(np.int64)
            print1, print2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                print1[full] = np.add.reduceat(_text.mix(values ^ _ODD[1]), edge[:-1][full])
                print2[full] = np.bitwise_xor.reduceat(_text.mix(values ^ _ODD[2]), edge[:-1][full])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(size.astype(np.int64)), pa.array(print1.view(np.int64)), pa.array(print2.view(np.int64)), lists], names=["id", "n", "p1", "p2", "bands"])


def links_within(values: np.ndarray, edge: np.ndarray, similarity: int, labels: list | None = None) -> list[tuple[int, int]]:
    """Links of ``similarity`` per cent or more among sets that join all that can be joined (places of two linked sets).

    Sets of the same label are joined already.
    """
    m, size = len(edge) - 1, np.diff(edge)
    first: dict = {}
    root = [first.setdefault(x, i) for i, x in enumerate(labels)] if labels else list(range(m))
    out: list[tuple[int, int]] = []

    def end(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    members = np.bincount(np.array(root, dtype=np.int64), minlength=m)
    outside = np.flatnonzero(np.array(root, dtype=np.int64) != members.argmax()).tolist() if m else []
    # only shingles of the sets outside the largest component matter
    _, shingle, seen = np.unique(values, return_inverse=True, return_counts=True)
    shingle, owner = shingle.reshape(-1), np.repeat(np.arange(m), size)
    shared = seen[shingle] > 1
    by = np.argsort(shingle[shared], kind="stable")
    posted, at = owner[shared][by], np.concatenate(([0], np.cumsum(np.where(seen > 1, seen, 0))))
    for x in outside:
        own = shingle[edge[x] : edge[x + 1]]
        lo, n = at[own], at[own + 1] - at[own]
        total = np.cumsum(n)
        if not len(total) or not total[-1]:
            continue
        same = np.bincount(posted[np.repeat(lo - (total - n), n) + np.arange(total[-1])], minlength=m)
        for y in np.flatnonzero((100 * same >= similarity * (size[x] + size - same)) & (same > 0)).tolist():
            a, b = end(x), end(y)
            if a != b:
                out.append((x, y))
                root[b] = a
    return out


def _stars(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Links of the members with the centre of their part; rows (key, id, member, text) come sorted by key, centres first."""
    key, centres = None, []
    for batch in batches:
        kind = batch.schema.field(1).type
        keys, names, member = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        data, offsets = _text.text_buffer(batch.column(3))
        found: list[tuple] = []
        for lo, hi in _text.chunks(offsets):
            values, edge = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for i in range(lo, hi):
                own = values[edge[i - lo] : edge[i - lo + 1]]
                if keys[i] != key:
                    key, centres = keys[i], []
                if not member[i]:
                    centres.append((names[i], own.copy()))
                    continue
                for name, centre in centres:
                    few, most = sorted((len(own), len(centre)))
                    if few and 100 * few >= similarity * most:
                        at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        same = int((centre[at] == own).sum())
                        if 100 * same >= similarity * (few + most - same):
                            found.append((name, names[i]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of rows (key, id, label, text), which come sorted by key."""
    key, ids, labels, sets, sizes = None, [], [], [], []

    def done() -> pa.RecordBatch:
        found = links_within(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))), similarity, [repr(x) for x in labels])
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], kind), pa.array([ids[y] for _, y in found], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(1).type
        keys, names, labelled = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        data, offsets = _text.text_buffer(batch.column(3))
        for lo, hi in _text.chunks(offsets):
            values, edge = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for i in range(lo, hi):
                if keys[i] != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, labels, sets, sizes = keys[i], [], [], [], []
                ids.append(names[i])
                labels.append(labelled[i])
                sets.append(values[edge[i - lo] : edge[i - lo + 1]])
                sizes.append(len(sets[-1]))
    if len(ids) > 1:
        yield done()


def _star_links(own: DataFrame, pairs: DataFrame, similarity: int, kind: str) -> DataFrame:
    """Links (a, b) among the pairs (centre, rep)."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    key = lambda part: F.xxhash64("centre", part).alias("key")
    members = pairs.join(parts, "centre").select(F.col("rep").alias("id"), key(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), F.lit(True).alias("member"))
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("centre").alias("id"), key(F.col("part")), F.lit(False).alias("member"))
    keyed = small(materialise(members.union(centres), "star-keys"))
    placed = own.join(keyed, "id").select("key", "id", "member", "text").distinct()
    return placed.repartition("key").sortWithinPartitions("key", "member", "id").mapInArrow(frugal(lambda batches: _stars(batches, similarity)), f"a {kind}, b {kind}").distinct()


def _left_links(own: DataFrame, classes: DataFrame, component: DataFrame, similarity: int, kind: str) -> DataFrame | None:
    """Links among members of one bucket in different components."""
    labelled = classes.join(component.select(F.col("id").alias("rep"), "component"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("label"), "bands")
    labelled = materialise(labelled, "labelled")
    banded = labelled.select("rep", "label", F.explode("bands").alias("band"))
    mixed = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most")).where("members > 2 AND least <> most").select("band", "centre")
    shared = materialise(banded.join(mixed, "band").where("rep <> centre").select("centre", "rep").distinct(), "mixed")
    if shared.isEmpty():
        release(shared)
        return None
    groups = components(shared, "centre", "rep")
    sized = materialise(groups.join(labelled.select(F.col("rep").alias("id"), "n", "label"), "id"), "groups")
    release(shared)
    sums = sized.groupBy("component", "label").agg(F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sums = sums.groupBy("component").agg(F.max(F.struct("n", "label")).alias("big"), F.sum("n").alias("n")).where("big.n < n")
    sums = sums.select("component", F.col("big.label").alias("big"), blocks(F.col("big.n")).alias("inner"), blocks(F.col("n") - F.col("big.n")).alias("outer"))
    dealt = sized.join(sums, "component").withColumn("inside", F.col("label") == F.col("big")).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meet = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    block, outer, inner = F.col("block"), F.col("outer"), F.col("inner")
    across = F.when(F.col("inside"), F.transform(upto(outer), lambda j: meet(0, block, j))).otherwise(F.transform(upto(inner), lambda i: meet(0, i, block)))
    # one block outside meets itself beside every block inside
    among = F.when(F.col("inside") | (outer == 1), F.array().cast("array<struct<kind:int,a:int,b:int>>")).otherwise(F.transform(F.filter(upto(outer), lambda j: j != block), lambda j: meet(1, F.least(block, j), F.greatest(block, j))))
    keyed = dealt.select("id", "label", "component", F.explode(F.concat(across, among)).alias("place")).select("id", "label", F.xxhash64("component", "place").alias("key"))
    keyed = small(materialise(keyed, "left-keys"))
    placed = own.join(keyed, "id").select("key", "id", "label", "text").distinct()
    return placed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(frugal(lambda batches: _confirm(batches, similarity)), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links of ``similarity`` per cent), kept."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    sketched = materialise(own.mapInArrow(frugal(_sketch), f"id {kind}, n long, p1 long, p2 long, bands array<long>"), "sketches")
    sets = sketched.where("n > 0 AND id IS NOT NULL")
    classes = materialise(sets.groupBy("p1", "p2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1").select("band", "centre")
    pairs = materialise(banded.join(buckets, "band").where("rep <> centre").select("centre", "rep").distinct(), "stars")
    links = materialise(_star_links(own, pairs, similarity, kind), "star-links")
    release(pairs)
    component = components(links)
    release(links)
    of = classes.select("p1", "p2", "n", "rep")
    of = of.join(component, of["rep"] == component["id"], "left").select("p1", "p2", "n", F.coalesce("component", "rep").alias("component"))
    further = _left_links(own, classes, component, similarity, kind)
    if further is not None:
        # links left over join components as a whole, a far smaller graph
        named = component.select("id", F.col("component").alias("label"))
        end = lambda rows, c: rows.join(named.withColumnRenamed("id", c), c, "left").select(*[x for x in rows.columns if x != c], F.coalesce("label", c).alias(c))
        joined = components(end(end(materialise(further, "left-links"), "a"), "b")).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        of = of.join(joined, "component", "left").select("p1", "p2", "n", F.coalesce("whole", "component").alias("component"))
    out = sketched.select("id", "n", "p1", "p2").join(of, ["p1", "p2", "n"], "left")
    component_id = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))

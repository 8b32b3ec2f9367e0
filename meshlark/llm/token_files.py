"""Token ids as files of Simple-8b words.

Documents are put into ascending order of their id by a range partitioning, encoded
with a tokenizer, ended with an id, and written: each partition is a shard, each row
of it a run of whole documents with

* ``words``: 64-bit words, a 4-bit selector and 60 payload bits each.  A selector says
  how many ids share the word and with how many bits each; an id of more than 30 bits
  escapes into a word of its own;
* ``offsets``: the word at which each block of ``BLOCK`` ids begins, so that blocks can
  be encoded and decoded side by side in vector operations;
* ``doc_ids`` and ``doc_lengths``, and ``first``: the ids before this row in its shard.

The files are Parquet written by Spark's committer to the shared folder, so a lost
executor's part is written again and no half-written shard is ever seen.

Encoding makes use of the tokenizer's pre-tokenizer splitting text into pieces that
are encoded independently: pieces are found for a whole column at once from character
classes that are asked of the pre-tokenizer itself, and only pieces not yet seen by a
worker go through the tokenizer.  Texts with other characters, or with the content of
an added token, and tokenizers of another kind are encoded directly.  A very long text is
cut before spaces between a letter or digit and a letter, where every piece ends, and encoded part by part.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with
the same id are ordered by text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm import _text
from meshlark.llm._store import materialise
from meshlark.llm._worker import frugal

#: Ids in a word and bits of each, by selector (fixed values of Simple-8b).
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

BLOCK = 1024
#: A row of a file is closed once it has this many ids (it then ends with a whole document).
ROW_IDS = 1 << 18
#: Pieces that a worker remembers (some 40 bytes each); beyond it the memory is emptied.
MEMORY = 2_000_000
#: Bytes of text that are encoded together, and ids that are packed or unpacked together.
PART, PACKED = 1 << 19, 256 * BLOCK


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block of BLOCK ids (with the end)."""
    made, ends = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo in range(0, len(ids), PACKED):  # blocks stand for themselves, so their runs do
        words, offsets = _encode_words(np.asarray(ids[lo : lo + PACKED], dtype=np.uint64))
        made.append(words)
        ends.append(offsets[1:] + ends[-1][-1])
    return np.concatenate(made), np.concatenate(ends)


def _encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    end = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    width = np.zeros(n, dtype=np.uint8)
    for b in sorted(set(BITS)):
        width[(ids >> np.uint64(b)) > 0] = b + 1  # more than b bits
    choice = np.full(n, 15, dtype=np.uint8)
    # the widest of the n ids from each place on, by doubling; a selector fits if none is too wide
    reach = {1: width}
    size = 1
    while size * 2 <= 240 and size * 2 <= max(1, n):
        a = reach[size].copy()
        np.maximum(a[:-size], reach[size][size:], out=a[: n - size])
        reach[size * 2] = a
        size *= 2
        if int(a[: max(1, n - size + 1)].min()) > 20:
            break
    for s in range(14, -1, -1):
        count = COUNTS[s]
        half = 1 << (count.bit_length() - 1)
        if count > n or half not in reach:
            continue
        most = reach[half][: n - count + 1]
        if half < count:
            most = np.maximum(most, reach[half][count - half : n - half + 1])
        fits = np.flatnonzero((most <= BITS[s]) & (np.arange(n - count + 1) + count <= end[: n - count + 1]))
        choice[fits] = s
    counts = np.array(COUNTS)[choice]
    at, steps = np.arange(blocks) * BLOCK, []
    stop = np.minimum(at + BLOCK, n)
    while len(at):
        steps.append(at)
        at = at + counts[at]
        going = at < stop
        at, stop = at[going], stop[going]
    starts = np.sort(np.concatenate(steps)) if steps else np.empty(0, np.int64)
    words = np.empty(len(starts), dtype=np.uint64)
    picked = choice[starts]
    for s in np.unique(picked):
        which = np.flatnonzero(picked == s)
        word = np.full(len(which), np.uint64(s) << np.uint64(60), dtype=np.uint64)
        if BITS[s]:
            for j in range(COUNTS[s]):
                word |= ids[starts[which] + j] << np.uint64(j * BITS[s])
        words[which] = word
    return words, np.searchsorted(starts, np.append(np.arange(blocks) * BLOCK, n))


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selector]
    at = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            which = np.flatnonzero(selector == s)
            mask = np.uint64((1 << BITS[s]) - 1)
            for j in range(COUNTS[s]):
                out[at[which] + j] = (words[which] >> np.uint64(j * BITS[s])) & mask
    return out


def _between_letters(data: np.ndarray) -> np.ndarray:
    """Places of spaces after an ASCII letter or digit and before a small letter."""
    small = (data >= 97) & (data <= 122)
    before = small | ((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57))
    return np.flatnonzero((data[1:-1] == 32) & before[:-2] & small[2:]) + 1 if len(data) > 2 else np.empty(0, np.int64)


class Pieces:
    """A tokenizer with the ids of the pieces met so far."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        if self.split:
            self.kinds = self._classes()
        self.forget()

    def forget(self) -> None:
        self.known, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    LETTER, NUMBER, OTHER, SPACE, ELSEWHERE = range(1, 6)

    def _classes(self) -> np.ndarray:
        """Class of each character below 0x530 and of general punctuation, as the pre-tokenizer treats it."""
        kinds = np.full(0x2070, self.ELSEWHERE, dtype=np.uint8)
        split = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
        for c in [*range(1, 0x530), *range(0x2000, 0x2070)]:
            x = chr(c)
            kinds[c] = self.LETTER if split(f"a{x}a") else self.NUMBER if split(f"1{x}1") else self.OTHER if split(f"!{x}!") else self.SPACE
        return kinds

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one row, part by part."""
        made, lo = [np.empty(0, np.uint32)], 0
        while lo < len(data):
            hi = self._cut(data, lo + PART) if self.split else len(data)
            made.append(self.encode(data[lo:hi], np.array([0, hi - lo]))[0])
            lo = hi
        ids = np.concatenate(made)
        return ids, np.array([len(ids)])

    def _cut(self, data: np.ndarray, at: int) -> int:
        """The first place from ``at`` on where such a space stands, or the end; no added token may hold one."""
        if any(_between_letters(np.frombuffer(x, np.uint8)).size for x in self.added):
            return len(data)
        while at < len(data):
            found = _between_letters(data[at - 1 : at + (1 << 16)])
            if len(found):
                return at - 1 + int(found[0])
            at += (1 << 16) - 1
        return len(data)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows together, and the ids in each row."""
        n = len(offsets) - 1
        if not self.split:
            made = self.direct([bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in range(n)])
            return np.concatenate([*made, np.empty(0, np.uint32)]), np.array([len(x) for x in made], dtype=np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        rows = np.searchsorted(byte_at, offsets)
        byte_at = np.append(byte_at, len(data))
        kind = np.where(points < len(self.kinds), self.kinds[np.minimum(points, len(self.kinds) - 1)], self.ELSEWHERE).astype(np.uint8)
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(rows, np.flatnonzero(kind == self.ELSEWHERE), side="right") - 1] = True
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(content, at + 1)
        start = self._starts(points, kind, rows)
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], len(points)) if len(begin) else begin
        owner = np.searchsorted(rows, begin, side="right") - 1
        plain = ~odd[owner]
        lo, hi, owner = byte_at[begin[plain]], byte_at[stop[plain]], owner[plain]
        hashes = _text.span_hash(_text.prefix_hash(data), lo, hi)
        place = self._places(hashes, raw, lo, hi)
        sizes = self.size[place]
        total = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.pool[np.repeat(self.start[place] - total[:-1], sizes) + np.arange(total[-1])]
        per_row = np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            made = dict(zip(which.tolist(), self.direct([raw[offsets[i] : offsets[i + 1]].decode() for i in which]), strict=True))
            edge = np.concatenate(([0], np.cumsum(per_row)))
            flat = np.concatenate([*[made[i] if i in made else flat[edge[i] : edge[i + 1]] for i in range(n)], np.empty(0, np.uint32)])
            for i, ids in made.items():
                per_row[i] = len(ids)
        return flat, per_row

    def _starts(self, points: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces start: runs of one class, with one space before letters, numbers and others joined to them."""
        n = len(points)
        first = np.zeros(n + 1, dtype=bool)
        first[rows] = True
        if not n:
            return first[:0]
        start = first[:n].copy()
        blank = kind == self.SPACE
        turn = (kind[1:] != kind[:-1]) & ~((points[:-1] == 32) & ~blank[1:])
        start[1:] |= turn
        # the last blank before something else is cut off from a run of blanks, except at a row's end
        start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
        mark = np.flatnonzero((points == 39) & start)
        for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
            at = mark[mark + len(letters) < n]
            for j, c in enumerate(letters):
                at = at[(points[at + 1 + j] == ord(c)) & ~first[at + 1 + j]]
            start[at + 1] = False
            if len(letters) == 2:
                start[at + 2] = False
            after = at + 1 + len(letters)
            start[after[after < n]] = True
        return start

    def _places(self, hashes: np.ndarray, raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the pieces among the known ones; new ones are encoded first."""
        if len(self.known) > MEMORY:
            self.forget()
        value, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, value)
        new = (at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != value) if len(self.known) else np.ones(len(value), dtype=bool)
        if new.any():
            fresh, made = index[new], []
            for at_once in range(0, len(fresh), 2048):  # the tokenizer's own results are many times larger than the ids
                some = fresh[at_once : at_once + 2048]
                made += self.direct([raw[a:b].decode() for a, b in zip(lo[some].tolist(), hi[some].tolist(), strict=True)])
            sizes = np.array([len(x) for x in made], dtype=np.int64)
            end = self.used + int(sizes.sum())
            if end > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.empty(2 * end - self.used, np.uint32)))
            self.pool[self.used : end] = np.concatenate(made)
            starts = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.used = end
            self.known, self.start, self.size = (np.insert(have, at[new], more) for have, more in ((self.known, value[new]), (self.start, starts), (self.size, sizes)))
            at = np.searchsorted(self.known, value)
        return at[inverse.reshape(-1)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The tokenizer of this worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


_FILE = "shard int, row int, first long, n_ids long, words binary, offsets array<int>, doc_ids array<{id}>, doc_lengths array<long>"


def write(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, extra: list[str] | None = None) -> DataFrame:
    """Write the files and return them as read back.  ``extra``: further columns to order rows of the same id by, after the id."""
    order = list(dict.fromkeys([id_col, *(extra or [])]))
    own = docs.select(*order, text_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = pieces(tokenizer), TaskContext.get().partitionId()
        held_ids, held_docs, held_lengths, first, row, kind = [], [], [], 0, 0, None

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(held_ids)
            words, offsets = encode_words(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([offsets], pa.list_(pa.int32())), pa.array([held_docs], pa.list_(kind)), pa.array([held_lengths], pa.list_(pa.int64()))],
                names=["shard", "row", "first", "n_ids", "words", "offsets", "doc_ids", "doc_lengths"],
            )

        for batch in batches:
            at_id, at_text = batch.schema.get_field_index(id_col), batch.schema.get_field_index(text_col)
            kind, names = batch.schema.field(at_id).type, batch.column(at_id)
            data, offsets = _text.text_buffer(batch.column(at_text))
            for a, b in _text.chunks(offsets, PART):
                own = data[offsets[a] : offsets[b]]
                ids, sizes = coder.encode_long(own) if len(own) > 2 * PART else coder.encode(own, offsets[a : b + 1] - offsets[a])
                held_ids.append(np.insert(ids, np.cumsum(sizes), end_id).astype(np.uint32))
                held_docs += names.slice(a, b - a).to_pylist()
                held_lengths += (sizes + 1).tolist()
                if sum(map(len, held_ids)) >= ROW_IDS:
                    yield packed()
                    first, row = first + sum(map(len, held_ids)), row + 1
                    held_ids, held_docs, held_lengths = [], [], []
        if held_docs:
            yield packed()

    return materialise(own.mapInArrow(frugal(run), _FILE.format(id=id_type)), "tokens")


def read(files: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files: id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    totals = sorted(map(tuple, files.groupBy("shard").agg(F.sum("n_ids")).collect()))  # one number per shard
    before, at = {}, 0
    for shard, n in totals:
        before[shard] = at
        at += n
    sent = spark.sparkContext.broadcast(before)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                words, blocks = np.frombuffer(col["words"][i].as_buffer(), dtype="<u8"), col["offsets"][i].values.to_numpy()
                cuts = [*blocks[:-1:PACKED // BLOCK].tolist(), len(words)]
                ids = np.concatenate([decode_words(words[a:b]).astype("<u4") for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                lengths = col["doc_lengths"][i].values.to_numpy()
                edge = np.concatenate(([0], np.cumsum(lengths)))
                if edge[-1] != len(ids) or len(ids) != col["n_ids"][i].as_py():
                    raise ValueError(f"shard {col['shard'][i]}, row {col['row'][i]}: {len(ids)} ids, {edge[-1]} expected")
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                start = sent.value[col["shard"][i].as_py()] + col["first"][i].as_py() + edge[:-1]
                yield pa.RecordBatch.from_arrays([col["doc_ids"][i].values, pa.array(start), pa.array(lengths), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(frugal(run), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")

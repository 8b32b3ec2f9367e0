"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased; a word is a run of letters, digits and
non-ASCII characters).  Every distinct word of the benchmark gets a letter of its own,
so that a text becomes a line with one letter for each word, other words being blank.
Every window of ``window`` consecutive item words is a key of one automaton over these
letters; the lines of a batch are scanned once, and the places of a match are word
numbers, which are mapped back to byte offsets of the original.  Letters of a batch are
found by word hashes, all at once; a text with a match is scanned again by its words.

The automaton is bounded in windows (``max_windows``, about 1 kB each at ten words): a
larger benchmark gives several, which scan a group of batches one after another, so a
worker holds one of them at a time.  Items are broadcast only up to ``max_broadcast_mb``;
what is beyond that takes further passes over the documents, each with the finds of
those before.  No item is left out and nothing is shuffled.

Defined cases: a null or wordless text has no words and is clean; a null or wordless
item has no windows; items with the same window all count; rows that share an item_id
are one item; repeated documents are judged each; very long texts are read in stretches;
other columns of the input are ignored, whatever their names; an empty table of
documents gives no rows, an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm import _text
from meshlark.llm._store import materialise
from meshlark.llm._worker import frugal

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STRETCH = 1 << 20
_INSIDE = np.frombuffer(_TO_WORDS, dtype=np.uint8) != 32
#: Windows of one automaton, and megabytes of benchmark text that are broadcast at once.
MAX_WINDOWS, MAX_BROADCAST_MB = 150_000, 64
#: Bytes of text that meet all automata in turn before more is read.
GROUP = 32 << 20
#: An automaton of no more windows stays with the worker for its next task.
_SMALL = 20_000
_automata: dict[str, tuple] = {}

Shard = list[tuple[str, list[bytes]]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def shards_of(items: Iterator[tuple[str, bytes]], window: int, max_windows: int) -> Iterator[Shard]:
    """Items as words, in parts of at most ``max_windows`` windows; a longer item is cut with an overlap."""
    shard, filled = [], 0
    for name, text in items:
        words, at = words_of(text), 0
        while at == 0 or at < len(words) - window + 1:
            if not words:
                break
            if filled >= max_windows:
                yield shard
                shard, filled = [], 0
            piece = words[at : at + max_windows - filled + window - 1]
            shard.append((name, piece))
            took = max(1, len(piece) - window + 1)
            filled, at = filled + took, at + took
    if shard:
        yield shard


def build(shard: Shard, window: int) -> tuple:
    """The automaton of a part, the letters of its words, its number of windows, and the sorted hashes of its words with their letters' numbers; a key's value is (its words, the numbers of its items)."""
    import ahocorasick

    letters: dict[bytes, str] = {}
    found: dict[str, set[int]] = defaultdict(set)
    for i, (_, words) in enumerate(shard):
        for w in words:
            if w not in letters:
                n = len(letters) + 1
                letters[w] = chr(n if n < 0xD800 else n + 0x800)
        line = "".join([letters[w] for w in words])
        for at in range(max(1, len(line) - window + 1)):
            found[line[at : at + window]].add(i)
    made = ahocorasick.Automaton()
    for key, ids in found.items():
        made.add_word(key, (len(key), tuple(ids)))
    made.make_automaton()
    names = b" ".join(letters)
    hashes, _ = _text.word_hashes(np.frombuffer(names, dtype=np.uint8), np.array([0, len(names)]), _INSIDE)
    order = np.argsort(hashes)
    return made, letters, len(found), hashes[order], np.array([ord(x) for x in letters.values()], dtype=np.uint32)[order]


def rows_with_matches(made: tuple, hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Rows whose line, by the hashes of its words, holds a key."""
    automaton, known, letters = made[0], made[3], made[4]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    line = np.zeros(len(hashes) + n, dtype="<u4")
    place = np.arange(len(hashes)) + row  # a blank after each row, so that no match goes over its end
    line[place] = np.where(known[at] == hashes, letters[at], 0)
    ends = np.array([end for end, _ in automaton.iter(line.tobytes().decode("utf-32-le"))], dtype=np.int64)
    return np.unique(row[np.searchsorted(place, ends)]) if len(ends) else ends


def automaton_of(key: str, shard: Shard, window: int) -> tuple:
    """The automaton of this worker process for a part; only one is held at a time."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = build(shard, window)
    return _automata[key]


def line_of(text: bytes, letters: dict[bytes, str]) -> str:
    """One letter for each word of the text."""
    plain, parts, lo = text.translate(_TO_WORDS), [], 0
    while lo < len(plain):
        hi = plain.find(b" ", lo + _STRETCH)
        hi = len(plain) if hi < 0 else hi
        parts.append("".join([letters.get(w, "\0") for w in plain[lo:hi].split()]))
        lo = hi
    return "".join(parts)


def scan(text: bytes, made: tuple, covered: list[tuple[int, int]], items: set[int]) -> int:
    """Add the ranges of hit words (merged) and the items that occur, by the words themselves; return the number of words."""
    automaton, letters = made[:2]
    line = line_of(text, letters)
    found: list[tuple[int, int]] = []
    for end, (size, ids) in automaton.iter(line):
        lo = end - size + 1
        while found and found[-1][1] >= lo:
            lo = min(lo, found.pop()[0])
        found.append((lo, end + 1))
        items.update(ids)
    covered += found
    return len(line)


def word_offsets(text: bytes) -> np.ndarray:
    """Byte offsets [start, end) of the words in the original text."""
    kept = np.frombuffer(text.translate(_TO_WORDS), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _passes(shards: Iterator[Shard], most: int) -> Iterator[list[Shard]]:
    held, size = [], 0
    for shard in shards:
        weight = sum(len(w) for _, words in shard for w in words)
        if held and size + weight > most:
            yield held
            held, size = [], 0
        held.append(shard)
        size += weight
    yield held


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS, max_broadcast_mb: float = MAX_BROADCAST_MB, keep: list[str] | None = None
) -> DataFrame:
    """One row for each document: id (and the columns ``keep``), n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated, and hits: word ranges with byte offsets in the original."""
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    own = [f"c{i}" for i in range(len(names))]
    state = docs.select(*[docs[n].alias(c) for n, c in zip(names, own, strict=True)], docs[text_col].alias("words_of"))
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    items = ((r["item"], r["text"].encode()) for r in rows.toLocalIterator())
    passes = _passes(shards_of(items, window, max_windows), int(max_broadcast_mb * (1 << 20)))
    shards = next(passes)
    while (further := next(passes, None)) is not None:
        state = materialise(_scanned(state, own, shards, window, last=False), "benchmark")
        shards = further
    state = _scanned(state, own, shards, window, last=True)
    return state.toDF(*names, *state.columns[len(own) :])


def _scanned(state: DataFrame, own: list[str], shards: list[Shard], window: int, last: bool) -> DataFrame:
    """Documents with the finds of these parts added to those of earlier passes."""
    sent = [(hashlib.sha256(repr((window, s)).encode()).hexdigest(), state.sparkSession.sparkContext.broadcast(s)) for s in shards]
    again = "found" in state.columns

    def judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = []
        for batch in batches:
            n, at = batch.num_rows, batch.schema.get_field_index("found")
            data, offsets = _text.text_buffer(batch.column(batch.schema.get_field_index("words_of")))
            ranges = [[(x["word_start"], x["word_end"]) for x in r] for r in batch.column(at).to_pylist()] if again else [[] for _ in range(n)]
            items = [set(x) for x in batch.column(batch.schema.get_field_index("items")).to_pylist()] if again else [set() for _ in range(n)]
            sets.append((batch, data, offsets, ranges, items, *_text.word_hashes(data, offsets, _INSIDE)))
        for key, value in sent:
            shard = value.value
            made = automaton_of(key, shard, window)
            for batch, data, offsets, ranges, items, hashes, row in sets:
                for i in rows_with_matches(made, hashes, row, batch.num_rows).tolist():
                    ids: set[int] = set()
                    scan(data[offsets[i] : offsets[i + 1]].tobytes(), made, ranges[i], ids)
                    items[i].update(shard[j][0] for j in ids)
        for batch, data, offsets, ranges, items, _, row in sets:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in own]
            found = [merged(r) for r in ranges]
            counts = np.bincount(row, minlength=batch.num_rows)
            named = [sorted(x) for x in items]
            if last:
                n_hit, hits = np.zeros(len(found), dtype=np.int64), []
                for i, r in enumerate(found):
                    where = word_offsets(data[offsets[i] : offsets[i + 1]].tobytes()) if r else None
                    hits.append([{"word_start": a, "word_end": b, "byte_start": int(where[a][0]), "byte_end": int(where[b - 1][1])} for a, b in r])
                    n_hit[i] = sum(b - a for a, b in r)
                made_of = {
                    "n_words": pa.array(counts), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in named], pa.int64()), "items": pa.array(named, pa.list_(pa.string())),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()), "contaminated": pa.array(n_hit > 0),
                    "hits": pa.array(hits, pa.list_(pa.struct([(c, pa.int64()) for c in ("word_start", "word_end", "byte_start", "byte_end")]))),
                }
            else:
                pairs = [[{"word_start": a, "word_end": b} for a, b in r] for r in found]
                made_of = {"words_of": batch.column(batch.schema.get_field_index("words_of")), "found": pa.array(pairs, pa.list_(pa.struct([("word_start", pa.int64()), ("word_end", pa.int64())]))), "items": pa.array(named, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*columns, *made_of.values()], names=[*own, *made_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(sent) <= 1 or size >= GROUP:
                yield from judged(held)
                held, size = [], 0
        if held:
            yield from judged(held)
        if any(x[2] > _SMALL for x in _automata.values()):
            _automata.clear()

    fields = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in own)
    if last:
        fields += ", n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, hits array<struct<word_start:long,word_end:long,byte_start:long,byte_end:long>>"
    else:
        fields += f", words_of {state.schema['words_of'].dataType.simpleString()}, found array<struct<word_start:long,word_end:long>>, items array<string>"
    return state.mapInArrow(frugal(run), fields)

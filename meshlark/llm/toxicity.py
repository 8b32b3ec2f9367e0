"""Toxicity by nearest labelled examples.

Texts become unit vectors over all terms of the labelled examples.  A term's weight is
its TF-IDF, (1 + log count) * idf, times its relevance, FLOOR + log(1 + evidence): the
log-likelihood ratio, beyond ``LEAST_LLR``, by which toxic examples hold it more often
than the base rate says.  No term is left out; without evidence it weighs little.  The ``k``
nearest examples by exact cosine vote with their similarity as weight, shrunk towards
the base rate, so the score is a share of toxic neighbours, and they are the evidence.

Exact search uses a block-max inverted index: postings by term, examples in blocks.
Postings of a query's rarer terms are summed; terms that many examples hold only add
their largest weight in a block to its bound.  Blocks are visited by falling bound, and
those whose bound stays below the k-th best cosine are never read.

The index is fitted on at most ``max_examples`` labelled rows (by hash of their id) with at
most ``max_postings`` distinct terms in sum (both documented bounds; rows beyond are not
learned from) and broadcast; near copies among examples cast one vote (the same smallest
five-word shingle hash and label).  Document frequencies are counted over all documents.
Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text, and one without any term of an example, gets the
base rate; null labels are left out; of several labels of a document the highest counts;
without labelled rows every score is 0; repeated rows are scored each; other columns are
ignored, whatever their names; an empty table gives no rows.  Ties between neighbours go
to the earlier example.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm import _text
from meshlark.llm._store import materialise, release
from meshlark.llm._worker import frugal

MAX_EXAMPLES, MAX_POSTINGS = 4096, 2_000_000
NEIGHBOURS = 25
BLOCK = 64
#: A term that at least this share of the examples holds is common: it is bounded by its block maxima.
COMMON = 0.25
#: Blocks that are read before the first comparison with the bounds.
FIRST = 8
#: Relevance of a term without evidence, and the log-likelihood ratio that is no evidence yet.
FLOOR, LEAST_LLR = 0.05, 4.0
SHRINK = 0.1
THRESHOLD = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word (letters, digits, non-ASCII; A-Z lower-cased)."""
    return _text.word_hashes(data, offsets, _WORD)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.text_buffer(batch.column(2))
        for a, b in _text.chunks(offsets):
            hashes, row = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            terms, counts, copies = [], [], []
            edge = np.searchsorted(row, np.arange(b - a + 1))
            for i in range(b - a):
                own = hashes[edge[i] : edge[i + 1]]
                t, n = np.unique(own, return_counts=True)
                terms.append(t.view(np.int64))
                counts.append(n)
                with np.errstate(over="ignore"):
                    s = own[:1] if len(own) < 5 else _text.mix(own[:-4] + own[1:-3] * np.uint64(3) + own[2:-2] * np.uint64(9) + own[3:-1] * np.uint64(27) + own[4:] * np.uint64(81))
                copies.append(int(s.min().view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(copies, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "label", "copy", "terms", "counts"]
            )


def _counted(vocabulary: np.ndarray):
    """In how many rows each term occurs, in one part; term -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, terms, _ in term_counts(batch.column(0), vocabulary):
                df += np.bincount(terms, minlength=len(vocabulary))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "n"])

    return run


def term_counts(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a column: row, term number and count, for the terms of the (sorted) vocabulary that occur."""
    data, offsets = _text.text_buffer(column)
    for a, b in _text.chunks(offsets):
        hashes, row = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == hashes)
        key, n = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
        yield a + key // len(vocabulary), key % len(vocabulary), n


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class BlockMaxIndex:
    """Unit vectors of n examples as postings by term; common terms also with their largest weight in each block."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int = BLOCK, common: float = COMMON) -> None:
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        order = np.lexsort((owner, term))
        owner, term, weight = owner[order], term[order], weight[order]
        size = np.bincount(term, minlength=terms)
        often = size >= max(1, math.ceil(common * n))
        self.place = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)  # row of a common term, or -1
        self.dense = np.zeros((int(often.sum()), self.blocks * block))
        held = often[term] if len(term) else np.empty(0, bool)
        self.dense[self.place[term[held]], owner[held]] = weight[held]
        self.most = self.dense.reshape(len(self.dense), self.blocks, block).max(axis=2)
        self.owner, self.weight = owner[~held].astype(np.int32), weight[~held]
        self.at = np.concatenate(([0], np.cumsum(np.where(often, 0, size))))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0, nearest first."""
        row = self.place[terms]
        rare = row < 0
        count = self.at[terms[rare] + 1] - self.at[terms[rare]]
        idx = _ragged(self.at[terms[rare]], count)
        sums = np.bincount(self.owner[idx], weights=self.weight[idx] * np.repeat(weights[rare], count), minlength=self.blocks * self.block).reshape(self.blocks, self.block)
        row, heavy = row[~rare], weights[~rare]
        bound = sums.max(axis=1) + heavy @ self.most[row]
        order = np.argsort(-bound, kind="stable")
        ids, cosines = np.empty(0, np.int64), np.empty(0)
        for part in (order[:FIRST], order[FIRST:]):
            least = cosines[-1] if len(ids) == k else 0.0
            part = part[(bound[part] > 0) & (bound[part] * (1 + 1e-9) >= least)]
            if not len(part):
                break
            dots = sums[part]
            if len(row):
                dots = dots + (heavy @ self.dense[row].reshape(len(row), self.blocks, self.block)[:, part].reshape(len(row), -1)).reshape(len(part), self.block)
            dots = np.round(dots.reshape(-1), 12)
            where = (part[:, None] * self.block + np.arange(self.block)).reshape(-1)
            hit = np.flatnonzero(dots > 0)
            ids, cosines = np.concatenate((ids, where[hit])), np.concatenate((cosines, dots[hit]))
            if len(ids) > k:  # the k-th best and its ties
                some = np.flatnonzero(cosines >= -np.partition(-cosines, k - 1)[k - 1])
                ids, cosines = ids[some], cosines[some]
            best = np.lexsort((ids, -cosines))[:k]
            ids, cosines = ids[best], cosines[best]
        return ids, cosines


class Model:
    """Terms, their weights, the example index and the base rate; bounded by max_examples and max_postings, whatever the corpus."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, ids: pa.Array, labels: np.ndarray, index: BlockMaxIndex, rate: float) -> None:
        self.vocabulary, self.weight, self.ids, self.labels, self.index, self.rate = vocabulary, weight, ids, labels, index, rate

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        length = math.sqrt(float((w * w).sum()))
        if not length:
            return self.rate, np.empty(0, np.int64), np.empty(0)
        ids, cosines = self.index.nearest(terms, w / length, NEIGHBOURS)
        votes = float((cosines * self.labels[ids]).sum())
        return (votes + SHRINK * self.rate) / (float(cosines.sum()) + SHRINK), ids, cosines


def evidence_of(a: np.ndarray, n: np.ndarray, n1: float, every: int) -> np.ndarray:
    """Log-likelihood ratio, against the base rate, of terms in n examples, a of them toxic; 0 where they aren't more often toxic."""
    if not 0 < n1 < every:
        return np.zeros(len(n))
    rate, share = n1 / every, a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(a > 0, a * np.log(share / rate), 0) + np.where(n > a, (n - a) * np.log((1 - share) / (1 - rate)), 0)
    return np.where(share > rate, out, 0.0)


def fit(
    docs: DataFrame, labels: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, max_postings: int = MAX_POSTINGS
) -> Model:
    """Fit on the labelled rows that satisfy ``train`` (a condition on the labels' columns)."""
    own = labels.where(train) if train is not None else labels
    own = own.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("long").alias("label"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), "id").select("id", "label", "text")  # max_examples rows of two numbers
    kind = joined.schema["id"].dataType.simpleString()
    found = joined.mapInArrow(frugal(_examples), f"id {kind}, label long, copy long, terms array<long>, counts array<long>")
    thin = materialise(found.groupBy("copy", "label").agg(F.min_by(F.struct("id", "terms", "counts"), F.struct("id", "terms")).alias("x")).select("label", "x.*"), "toxic-examples")
    sizes = thin.select("id", F.size("terms").alias("n"), F.xxhash64("id").alias("turn")).orderBy("turn", "id").collect()  # at most max_examples rows
    total, left_out = 0, []
    for r in sizes:
        total += r["n"]
        if total > max_postings:
            left_out.append(r["id"])
    rows = (thin.where(~F.col("id").isin(left_out)) if left_out else thin).orderBy(F.xxhash64("id"), "id", "label").toArrow()  # at most max_postings terms
    release(thin)
    column = lambda name: pa.concat_arrays([*rows.column(name).chunks, pa.array([], rows.schema.field(name).type)])
    ids, y, terms = column("id"), column("label").to_numpy().astype(float), column("terms")
    owner = np.repeat(np.arange(len(y)), terms.value_lengths().to_numpy(zero_copy_only=False))
    hashes, counts = terms.flatten().to_numpy(), column("counts").flatten().to_numpy()
    vocabulary, term = np.unique(hashes.view(np.uint64), return_inverse=True)
    term, rate = term.reshape(-1), float(y.mean()) if len(y) else 0.0
    if not len(vocabulary):
        return Model(vocabulary, np.empty(0), ids, y, BlockMaxIndex(term, term, np.empty(0), 0, 0), rate)
    counted = texts.select("text").mapInArrow(frugal(_counted(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    at, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + df)) + 0.01
    evidence = evidence_of(np.bincount(term, weights=y[owner], minlength=len(vocabulary)), np.bincount(term, minlength=len(vocabulary)), y.sum(), len(y))
    weight = np.maximum(0.0, idf) * (FLOOR + np.log1p(np.maximum(0.0, evidence - LEAST_LLR)))
    w = (1 + np.log(counts)) * weight[term]
    w /= np.sqrt(np.bincount(owner, weights=w * w, minlength=len(y)))[owner]
    # examples with the same leading term share blocks, which makes the bounds tight
    leading = np.zeros(len(y), dtype=np.int64)
    order = np.lexsort((w, owner))
    leading[owner[order]] = term[order]
    place = np.argsort(leading, kind="stable")
    turn = np.empty(len(y), dtype=np.int64)
    turn[place] = np.arange(len(y))
    return Model(vocabulary, weight, ids.take(pa.array(place)), y[place], BlockMaxIndex(turn[owner], term, w, len(y), len(vocabulary)), rate)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: id (and the columns ``keep``), score, predicted, evidence (nearest examples with similarity and label)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_postings
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    fresh = [f"c{i}" for i in range(len(names))]
    own = docs.select(*[docs[n].alias(c) for n, c in zip(names, fresh, strict=True)], docs[text_col].alias("scored_text"))
    id_type = own.schema["c0"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            n = batch.num_rows
            scores, sizes = np.full(n, m.rate), np.zeros(n, dtype=np.int64)
            near: list = [np.empty(0, np.int64)] * n
            close: list = [np.empty(0)] * n
            memo: dict[bytes, tuple] = {}
            for row, term, count in term_counts(batch.column(batch.schema.get_field_index("scored_text")), m.vocabulary) if len(m.vocabulary) else ():
                starts = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else row
                for lo, hi in zip(starts, [*starts[1:], len(row)][: len(starts)], strict=True):
                    key = term[lo:hi].tobytes() + count[lo:hi].tobytes()
                    if key not in memo:
                        memo[key] = m.score(term[lo:hi], count[lo:hi])
                    i = row[lo]
                    scores[i], near[i], close[i] = memo[key]
                    sizes[i] = len(near[i])
            at = np.concatenate([np.empty(0, np.int64), *near])
            found = pa.StructArray.from_arrays([m.ids.take(pa.array(at)), pa.array(np.concatenate([np.empty(0), *close])), pa.array(m.labels[at].astype(np.int32))], names=["id", "similarity", "label"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in fresh], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), evidence], names=[*fresh, "score", "predicted", "evidence"])

    fields = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in fresh)
    return own.mapInArrow(frugal(run), f"{fields}, score double, predicted int, evidence array<struct<id:{id_type},similarity:double,label:int>>").toDF(*names, "score", "predicted", "evidence")

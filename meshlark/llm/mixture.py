"""Mixing sources to target weights along a curriculum.

Each source has a weight and a schedule: a piecewise-linear rate over training time
[0, 1].  Its share of all words is its target (no more than ``max_repeats`` times its
size; the excess is shared anew by weight).  A source's documents form a stream in a
fixed pseudo-random order, repeated as often as the target needs; a copy that begins
after c words gets the training position at which the integral of the schedule reaches
c / target, so cumulative demand is inverted.  The result is range-sorted by position.

Whole documents are taken.  A copy is taken if its middle lies below the target; what
then is missing or too much (less than one document) is made up by taking or leaving
out further single documents of the fitting size, ``CORRECTIONS`` times.

At scale: words are counted where the text lies; only (key, source, size) is shuffled.
The running sums of a source are two-level: sums of the hash slices of each source
(about ``SLICE_ROWS`` rows of the table's largest source to a slice) are summed in
order, then each slice alone, so that no source, however large, comes together in
one task.  One row per source reaches the driver (at most
``MAX_SOURCES``, checked).

Defined cases: a null text has size 0 and is never taken (nor is any wordless text); a
null source is a source of its own, last; sources are ordered by code point; equal
documents are told apart by their id, and rows that agree in id and text share a place
in the order and count each; an empty table gives no rows; other columns are ignored,
and any that clash with the result's names are left out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.llm._store import materialise

SLICE_ROWS = 20_000
MAX_SOURCES = 200_000
CORRECTIONS = 4
MAX_REPEATS = 3
#: Rates at evenly spaced points of training time, by the source's place modulo 3: level, falling, rising.
SCHEDULES = [(1.0, 1.0), (1.5, 0.5), (0.5, 1.5)]


def size_of(text: Column) -> Column:
    """Number of words between spaces, tabs and line ends."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def shares(sizes: list[int], weights: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Targets that sum to all sizes, none above max_repeats times its size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        all_weights = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / all_weights > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / all_weights
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left = total - sum(out)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def inverse(share: Column, rates: tuple[float, ...]) -> Column:
    """Training time at which the integral of the piecewise-linear rates reaches a share of the whole."""
    n = len(rates) - 1
    areas = [(rates[i] + rates[i + 1]) / 2 / n for i in range(n)]
    whole, done, out = sum(areas), 0.0, None
    for i, area in enumerate(areas):
        slope, need = (rates[i + 1] - rates[i]) * n, share * whole - done
        # rates[i] * x + slope * x^2 / 2 = need
        x = need / rates[i] if slope == 0 else 2 * need / (rates[i] + F.sqrt(F.greatest(F.lit(0.0), F.lit(rates[i] ** 2) + 2 * slope * need)))
        at = F.lit(i / n) + x
        done += area
        out = F.when(share * whole <= done, at) if out is None else out.when(share * whole <= done, at)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out.otherwise(1.0)))


def _inverse_of(rates: tuple[float, ...]):
    return lambda share: inverse(F.least(F.lit(1.0), share), rates)


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] | None = None, schedules: list[tuple[float, ...]] | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: id, print (hash of id and text), source, size, source_size, target, copies, taken, positions (of the copies)."""
    weights, schedules = weights or [1, 2, 3], schedules or SCHEDULES
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("print"))
    rows = materialise(rows, "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = shares([r["n"] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    sources = spark.createDataFrame([(i, r["source"], r["n"], t, i % len(schedules)) for i, (r, t) in enumerate(zip(found, targets, strict=True))], "place int, source string, source_size long, target double, schedule int")
    bits = min(24, max(4, (max([r["rows"] for r in found], default=0) // SLICE_ROWS).bit_length()))
    # at most MAX_SOURCES short rows, so they may be broadcast
    rows = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).select("id", "print", "place", rows["source"], "size", "source_size", "target", "schedule", F.shiftrightunsigned(F.col("print"), 64 - bits).cast("int").alias("slice"))

    slices = rows.groupBy("place", "slice").agg(F.sum("size").alias("n"))
    before = slices.select("place", "slice", (F.sum("n").over(Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("place", "slice").orderBy("print", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    # 2 ** bits rows for each source
    rows = rows.withColumn("within", within).join(F.broadcast(before) if len(found) << bits <= 500_000 else before, ["place", "slice"])
    rows = rows.withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "slice")

    middle = F.col("start") + F.col("size") / 2
    fits = F.floor((F.col("target") - middle) / F.col("source_size")) + 1
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.least(F.lit(max_repeats), F.greatest(F.lit(0), fits))).otherwise(0).cast("int"))
    rows = materialise(rows, "mix-order")
    for _ in range(CORRECTIONS):
        rows, changed = _corrected(rows, max_repeats)
        if not changed:
            break
    copy = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: (F.col("start") + e * F.col("source_size")) / F.col("target"))
    kinds = [F.transform(copy, _inverse_of(r)) for r in schedules]
    at = F.when(F.col("copies") <= 0, F.array().cast("array<double>"))
    for k, x in enumerate(kinds):
        at = at.when(F.col("schedule") == k, x)
    return rows.select(F.col("id").alias(id_col), "print", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), at.alias("positions"))


def _corrected(rows: DataFrame, max_repeats: int) -> tuple[DataFrame, bool]:
    """Take or leave out one copy in each source where that brings its sum nearer to the target."""
    sums = {r["place"]: r["gap"] for r in rows.groupBy("place").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).collect()}
    if not sums:
        return rows, False
    spark = rows.sparkSession
    gaps = spark.createDataFrame(list(sums.items()), "place int, gap double")
    near = rows.join(F.broadcast(gaps), "place").where((F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < max_repeats).otherwise(F.col("copies") > 0))
    off = F.abs(F.abs("gap") - F.col("size"))
    best = near.where(off < F.abs("gap")).groupBy("place").agg(F.min(F.struct(off.alias("off"), "print", "id", F.sign("gap").cast("int").alias("step"))).alias("best"), F.count("*").alias("n")).select("place", "best.*").collect()
    if not best:
        return rows, False
    picked = spark.createDataFrame([(r["place"], r["print"], r["step"]) for r in best], "place int, print long, step int")
    out = rows.join(F.broadcast(picked), ["place", "print"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")
    return out, True


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with the columns of docs, whatever their names."""
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*name.values())
    planned = plan(rows, id_col=name[id_col], text_col=name[text_col], source_col=name[source_col], **options)
    placed = planned.where("copies > 0").select(F.col(name[id_col]).alias("id"), F.col("print").alias("its"), F.col("positions").alias("at")).dropDuplicates(["id", "its"])
    own = rows.withColumn("print", F.xxhash64(name[id_col], name[text_col]))
    chosen = own.join(placed, (F.col("print") == F.col("its")) & F.col(name[id_col]).eqNullSafe(F.col("id"))).select(*name.values(), "print", F.explode("at").alias("position"))
    return chosen.orderBy("position", "print").select(*name.values()).toDF(*docs.columns)

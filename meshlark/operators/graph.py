"""Graph operators on arc tables; loops run on tables, and only emptiness reaches the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and drop its lineage: a table in the folder that spark.checkpoint.dir (or setCheckpointDir) names.

    Where neither is set there is no folder that all executors share, but a local master alone uses its warehouse.
    """
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = str(current.get())
    if not named:
        if (spark.sparkContext.master or "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/meshlark-shared"
    path = f"{named.rstrip('/')}/meshlark-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # a join's estimate of a compressed file is many times less than its rows in the driver
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _few(df: DataFrame, most: int = 100_000, rows: int | None = None) -> DataFrame:
    """A table (that is computed already) to be broadcast where it has no more than ``most`` rows, as counted (here, or by the caller); beyond, joins shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def both_ways(links: DataFrame) -> DataFrame:
    """links (src, dst and more) and the same from dst to src, in one pass."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.select(F.explode(ways).alias("way"), *rest).select("way.src", "way.dst", *rest)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable.  nodes: node; links: src, dst (either direction).

    Each round points nodes to their smallest neighbour, follows the pointers to their
    ends by doubling and contracts the links, which at least halves the nodes with links.
    """
    left = cut(links.select("src", "dst").where("src <> dst").distinct())
    label = nodes.select("node", F.col("node").alias("label"))
    while not left.isEmpty():
        ends = left.union(left.select("dst", "src"))
        parent = cut(ends.groupBy(F.col("src").alias("v")).agg(F.least(F.first("src"), F.min("dst")).alias("p")))
        moved = True
        while moved:
            # each step is joined once and written; whether it moved a pointer is read from there
            further = cut(parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p"))
            moved = not further.where("pp <> p").isEmpty()
            parent = further.select("v", F.col("pp").alias("p"))
        label = cut(label.join(parent, label["label"] == parent["v"], "left").select("node", F.coalesce("p", "label").alias("label")))
        a, b = parent.select(F.col("v").alias("src"), F.col("p").alias("pa")), parent.select(F.col("v").alias("dst"), F.col("p").alias("pb"))
        left = cut(left.join(a, "src").join(b, "dst").where("pa <> pb").select(F.least("pa", "pb").alias("src"), F.greatest("pa", "pb").alias("dst")).distinct())
    return label


def distances(arcs: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """node, distance, origin of the nearest start (ties to the smaller origin).  arcs: src, dst, weight > 0; starts: node.

    Rounds of relaxation from the nodes that were improved last, so a round costs what
    the frontier costs, and the number of rounds is that of arcs on the longest path.
    """
    return _relaxed(cut(arcs.select("src", "dst", "weight")), starts, limit)


def _relaxed(arcs: DataFrame, starts: DataFrame, limit: int | None, targets: DataFrame | None = None) -> DataFrame:
    """distances() over arcs that are computed already, as every round reads them; with targets, only as far as the nearest."""
    known = cut(starts.select("node", F.lit(0).cast("long").alias("distance"), F.col("node").alias("origin"), F.lit(0).alias("round")))
    done = 0
    targets = targets if targets is None else _few(targets)
    while rows := (front := known.where(F.col("round") == done)).count():
        front = _few(front, rows=rows)
        done += 1
        offered = front.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), "origin", F.lit(done).alias("round"))
        if targets is not None:
            best = known.join(targets, "node").agg(F.min("distance").alias("d")).first()["d"]
            limit = best if limit is None or best is not None and best < limit else limit
        if limit is not None:
            offered = offered.where(F.col("distance") <= limit)
        # what is known wins over an equal offer, as its round is smaller
        known = cut(known.union(offered).groupBy("node").agg(F.min(F.struct("distance", "origin", "round")).alias("x")).select("node", "x.*"))
    return known.select("node", "distance", "origin")


def levels(arcs: DataFrame, start: int) -> DataFrame:
    """Breadth-first levels with the first path in slot order, to the last level there is.  arcs: src, slot, dst; result: node, level, path (slots)."""
    spark = arcs.sparkSession
    front = spark.createDataFrame([(start, 0, [])], "node long, level int, path array<int>")
    known = cut(front)
    front = known
    level = 0
    while True:
        level += 1
        offered = _few(front).join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array(F.col("slot").cast("int"))).alias("path"))
        new = offered.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = cut(new.select("node", F.lit(level).alias("level"), "path"))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return known


def route(arcs: DataFrame, starts: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes of the shortest route from any start to any target (node, distance); no rows if there is none.

    Ties go to the smaller target and to the smaller node before.  The way back is read by
    doubling: 2^k-th nodes before are known after k rounds, so a long route takes few.
    Nothing farther than the nearest target found so far is explored.
    """
    arcs = cut(arcs.select("src", "dst", "weight"))
    known = _relaxed(arcs, starts, limit, targets)
    end = known.join(_few(targets), "node").agg(F.min(F.struct("distance", "node")).alias("x")).where("x IS NOT NULL").select("x.node")
    found = _few(known)
    near, far = found.select(F.col("node").alias("src"), F.col("distance").alias("d0")), found.select(F.col("node").alias("dst"), F.col("distance").alias("d1"))
    tight = arcs.join(near, "src").join(far, "dst").where("d0 + weight = d1")
    up = cut(tight.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("p")))
    on = cut(end)
    while True:
        further = cut(_few(on).join(up, F.col("node") == F.col("v")).select(F.col("p").alias("node")))
        if further.isEmpty():
            break
        on = cut(on.union(further).distinct())
        up = cut(up.join(up.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p")))
    return known.join(_few(on), "node").select("node", "distance")


def invalid_steps(steps: DataFrame, arcs: DataFrame) -> DataFrame:
    """Steps (seq, src, dst, weight) that are no arc of the graph, or one of another weight."""
    return steps.join(arcs, ["src", "dst", "weight"], "left_anti")


def calls(edges: DataFrame, roots: DataFrame, most: int = 16) -> DataFrame:
    """root, callee, depth (fewest calls) within most calls; a root that calls itself is a row of its own.  edges: caller, callee; roots: root."""
    first = roots.join(edges, roots["root"] == edges["caller"]).select("root", "callee", F.lit(1).alias("depth")).distinct()
    known = front = cut(first)
    for depth in range(2, most + 1):
        step = _few(front).select("root", F.col("callee").alias("caller")).join(edges, "caller").select("root", "callee").distinct()
        front = cut(step.join(known, ["root", "callee"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return known

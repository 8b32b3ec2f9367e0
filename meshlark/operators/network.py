"""Directed slot networks of scenes: weak and strong components, reach, transfers between scenes.

A scene's triangles carry 16-bit numbers and three slots each, so a scene is one bounded
group (``MAX_TRIANGLES``, checked); scenes are spread over the cluster, however many.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.graph import cut

MAX_TRIANGLES = 65_536


def _arcs(pdf: pd.DataFrame) -> dict[int, list[int]]:
    """Targets of each triangle in slot order."""
    out: dict[int, list[int]] = {}
    for tri, dst in pdf.sort_values(["tri", "slot"])[["tri", "dst"]].itertuples(index=False):
        targets = out.setdefault(int(tri), [])
        if not pd.isna(dst):
            targets.append(int(dst))
    if len(out) > MAX_TRIANGLES:
        raise ValueError(f"a scene of more than {MAX_TRIANGLES} triangles")
    return {t: [d for d in ds if d in out] for t, ds in out.items()}


def breadth_first(arcs: dict[int, list[int]], starts: list[int]) -> dict[int, tuple[int, int | None]]:
    """Level and parent of what the starts reach; the first find in slot order stays."""
    found: dict[int, tuple[int, int | None]] = {s: (0, None) for s in starts if s in arcs}
    queue = deque(found)
    while queue:
        at = queue.popleft()
        for to in arcs[at]:
            if to not in found:
                found[to] = (found[at][0] + 1, at)
                queue.append(to)
    return found


def strong(arcs: dict[int, list[int]]) -> dict[int, int]:
    """Smallest member of each triangle's strong component."""
    back: dict[int, list[int]] = {t: [] for t in arcs}
    for t, ds in arcs.items():
        for d in ds:
            back[d].append(t)
    finished, seen = [], set()
    for root in arcs:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(arcs[root]))]
        while stack:
            at, rest = stack[-1]
            step = next((d for d in rest if d not in seen), None)
            if step is None:
                finished.append(at)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(arcs[step])))
    label: dict[int, int] = {}
    for root in reversed(finished):
        if root not in label:
            members, todo = [], [root]
            label[root] = root
            while todo:
                at = todo.pop()
                members.append(at)
                for b in back[at]:
                    if b not in label:
                        label[b] = root
                        todo.append(b)
            least = min(members)
            label.update(dict.fromkeys(members, least))
    return label


def components(access: DataFrame) -> DataFrame:
    """access: field, tri, slot, dst (null: none).  Result: field, tri, weak, strong (smallest members)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        arcs = _arcs(pdf)
        both: dict[int, list[int]] = {t: list(ds) for t, ds in arcs.items()}
        for t, ds in arcs.items():
            for d in ds:
                both[d].append(t)
        weak, tight = strong(both), strong(arcs)
        return pd.DataFrame([(key[0], t, weak[t], tight[t]) for t in arcs], columns=["field", "tri", "weak", "strong"])

    return access.groupBy("field").applyInPandas(run, "field long, tri long, weak long, strong long")


def reach(access: DataFrame, starts: DataFrame) -> DataFrame:
    """starts: field, start.  Result: field, start, tri, level, parent of every triangle in reach."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        arcs = _arcs(left)
        rows = [(key[0], s, t, level, parent) for s in sorted(set(right["start"])) for t, (level, parent) in breadth_first(arcs, [s]).items()]
        return pd.DataFrame(rows, columns=["field", "start", "tri", "level", "parent"]).astype({"parent": "Int64"})

    return access.groupBy("field").cogroup(starts.groupBy("field")).applyInPandas(run, "field long, start long, tri long, level int, parent long")


def transfers(access: DataFrame, gateways: DataFrame, field: int, tri: int, most: int = 3) -> DataFrame:
    """Entries (field, tri) that a walk from one triangle comes to, with the fewest transfers.

    gateways: from_field, from_tri, to_field, to_tri.  One round for each transfer, from
    the entries that the round before found.
    """
    spark = access.sparkSession
    known = cut(spark.createDataFrame([(field, tri, 0)], "field long, tri long, transfers int"))
    front = known
    for n in range(1, most + 1):
        walked = reach(access, front.select("field", F.col("tri").alias("start"))).select("field", "tri").distinct()
        through = walked.join(gateways, (walked["field"] == gateways["from_field"]) & (walked["tri"] == gateways["from_tri"])).select(F.col("to_field").alias("field"), F.col("to_tri").alias("tri")).distinct()
        front = cut(through.join(known.select("field", "tri"), ["field", "tri"], "left_anti").withColumn("transfers", F.lit(n)))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return known


def reach_pairs(access: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: field, start, target.  Those of which a walk inside the scene comes from start to target."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        arcs, rows = _arcs(left), []
        for start, some in right.groupby("start"):
            met = breadth_first(arcs, [start]) if start in arcs else {}
            rows += [(key[0], start, t) for t in sorted(set(some["target"])) if t in met]
        return pd.DataFrame(rows, columns=["field", "start", "target"])

    return access.groupBy("field").cogroup(pairs.groupBy("field")).applyInPandas(run, "field long, start long, target long")

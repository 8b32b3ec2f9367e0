"""Control flow of scripts: dominators, post-dominators and control dependence, per root.

A root's graph is small and bounded (the caller's budget), so each is one group; bit sets
in whole numbers make the fixed point.  A graph with a cycle, a dangling successor or too
many nodes gives a status and no evidence at all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

MAX_NODES = 8192


def _order(nodes: list[int], succ: dict[int, list[int]]) -> list[int] | None:
    """Topological order, or None if there is a cycle."""
    left = {n: 0 for n in nodes}
    for n in nodes:
        for s in succ[n]:
            left[s] += 1
    ready, out = sorted(n for n in nodes if not left[n]), []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for s in succ[n]:
            left[s] -= 1
            if not left[s]:
                ready.append(s)
    return out if len(out) == len(nodes) else None


def analyse(root: int, succ: dict[int, list[int]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """Status, and (branch, dependent, strong) for the nodes that the root reaches."""
    seen, stack = {root}, [root]
    while stack:
        for s in succ.get(stack.pop(), []):
            if s not in succ:
                return "dangling", []
            if s not in seen:
                seen.add(s)
                stack.append(s)
    if len(seen) > MAX_NODES:
        return "limited", []
    order = _order(sorted(seen), succ)
    if order is None:
        return "cycle", []
    bit = {n: 1 << i for i, n in enumerate(order)}
    every = (1 << len(order)) - 1
    pred: dict[int, list[int]] = {n: [] for n in order}
    for n in order:
        for s in succ[n]:
            pred[s].append(n)
    dom, pdom = {}, {}
    for n in order:
        meet = every if pred[n] else 0
        for p in pred[n]:
            meet &= dom[p]
        dom[n] = meet | bit[n]
    for n in reversed(order):
        meet = every if succ[n] else 0
        for s in succ[n]:
            meet &= pdom[s]
        pdom[n] = meet | bit[n]
    out = []
    for b in order:
        if len(set(succ[b])) > 1:
            for n in order:
                if n != b and any(pdom[s] & bit[n] for s in succ[b]) and not pdom[b] & bit[n]:
                    out.append((b, n, bool(dom[n] & bit[b])))
    return "ok", sorted(out)


def control_dependence(edges: DataFrame, entry: int | None = None) -> DataFrame:
    """edges: root, node, succ (null: none); a root starts at the node entry (None: at the node of its own number).  Result: root, status, branch, dependent, strong."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict[int, list[int]] = {}
        for n, s in zip(pdf["node"], pdf["succ"], strict=True):
            succ.setdefault(int(n), [])
            if not pd.isna(s):
                succ[int(n)].append(int(s))
        status, found = analyse(int(key[0]) if entry is None else entry, {n: sorted(s) for n, s in succ.items()})
        rows = [(int(key[0]), status, *x) for x in found] or [(int(key[0]), status, None, None, None)]
        return pd.DataFrame(rows, columns=["root", "status", "branch", "dependent", "strong"]).astype({"branch": "Int64", "dependent": "Int64", "strong": "boolean"})

    return edges.groupBy("root").applyInPandas(run, "root long, status string, branch long, dependent long, strong boolean")

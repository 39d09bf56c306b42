"""Slate replacement as exact bipartite matching, one user at a time in Arrow batches of users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship


def best_matching(weights: list[list[float]], threshold: float = 0.0, cap: int | None = None) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight among those over the threshold, at most ``cap`` of them.

    Dynamic programming over subsets of columns (a slate has few open slots); ties go
    to the earlier row and column.
    """
    width = len(weights[0]) if weights else 0
    cap = width if cap is None else cap
    best: dict[int, tuple[float, tuple[tuple[int, int], ...]]] = {0: (0.0, ())}
    for i, row in enumerate(weights):
        after = dict(best)
        for used, (total, pairs) in best.items():
            if len(pairs) >= cap:
                continue
            for j in range(width):
                if not used >> j & 1 and row[j] > threshold:
                    value = total + row[j]
                    key = used | 1 << j
                    if key not in after or value > after[key][0] + 1e-12:
                        after[key] = (value, (*pairs, (i, j)))
        best = after
    return list(max(best.values(), key=lambda x: (round(x[0], 12), -len(x[1])))[1])


def greedy_matching(weights: list[list[float]], threshold: float = 0.0) -> list[tuple[int, int]]:
    """The diagnostic rule: the best free pair again and again."""
    order = sorted(((-w, i, j) for i, row in enumerate(weights) for j, w in enumerate(row) if w > threshold))
    rows, columns, out = set(), set(), []
    for _, i, j in order:
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return out


def match_slots(edges: DataFrame, threshold: float = 0.0, cap: int = 2) -> DataFrame:
    """(customer_id, challenger, victim) of the best matching per user, from edges (customer_id, challenger, victim, weight).

    A user has at most pool size x open slots edges, so a group is bounded by the
    parameters of the pool, not by the data.
    """
    ship(edges.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="challenger", columns="victim", values="weight", aggfunc="max", fill_value=float("-inf")).sort_index().sort_index(axis=1)
        pairs = best_matching(table.to_numpy().tolist(), threshold, cap)
        return pd.DataFrame({"customer_id": [frame["customer_id"].iloc[0]] * len(pairs), "challenger": [table.index[i] for i, _ in pairs], "victim": [table.columns[j] for _, j in pairs]})

    return edges.select("customer_id", "challenger", "victim", "weight").groupBy("customer_id").applyInPandas(one, "customer_id long, challenger long, victim long")

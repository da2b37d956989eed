"""Minimum-cut labelling of a few nodes: terminal capacities from a classifier, smoothness from edges."""

from __future__ import annotations

from collections import deque

EPS = 1e-9


def min_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise cost: ``costs[i]`` are the prices of False and of True, each edge's weight that of unequal ends.

    A node whose own preference outweighs all its undecided edges is fixed
    first; that loses no optimum and mostly leaves little to cut.  Ties go to False.
    """
    pref = [a - b for a, b in costs]  # > 0: True is cheaper
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * len(costs)
    todo = deque(range(len(costs)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(pref[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = pref[i] > EPS
            for j, w in near[i].items():
                if label[j] is None:
                    pref[j] += w if label[i] else -w
                    todo.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        _cut(left, pref, near, label)
    return [bool(x) for x in label]


def _cut(left: list[int], pref: list[float], near: list[dict[int, float]], label: list[bool | None]) -> None:
    """Max-flow by shortest augmenting paths from True's terminal (-1) to False's (-2)."""
    cap: dict[int, dict[int, float]] = {-1: {}, -2: {}}
    inside = set(left)
    for i in left:
        cap[i] = {j: w for j, w in near[i].items() if j in inside}
        if pref[i] > 0:
            cap[-1][i] = pref[i]
            cap[i].setdefault(-1, 0.0)
        else:
            cap[i][-2] = -pref[i]
            cap[-2].setdefault(i, 0.0)
    while True:
        come: dict[int, int] = {-1: -1}
        queue = deque([-1])
        while queue and -2 not in come:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > EPS and v not in come:
                    come[v] = u
                    queue.append(v)
        if -2 not in come:
            break
        path, v = [], -2
        while v != -1:
            path.append((come[v], v))
            v = come[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow
    for i in left:
        label[i] = i in come

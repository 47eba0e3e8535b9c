"""Schema trees of JSON records, and the cheapest script of edits from one tree to another."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple

import numpy as np

#: Between the labels of a path. JSON texts hold it only escaped, names of fields don't hold it at all.
STEP = "\u001f"
ITEM = "[]"

ADD, DELETE, RETYPE, RENAME, MOVE = 1.0, 1.0, 0.5, 0.8, 1.2


class Edit(NamedTuple):
    kind: str  # added, removed, renamed, moved or retyped
    path: str
    new_path: str
    cost: float


def kind_of(value: Any) -> str:
    """JSON type; integers and fractions are one."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def nodes(value: Mapping[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    """Path and value of every node below an object; the items of an array are one node."""
    for name, x in value.items():
        path = above + name
        yield path, x
        yield from _below(x, path)


def _below(x: Any, path: str) -> Iterator[tuple[str, Any]]:
    if isinstance(x, dict):
        yield from nodes(x, path + STEP)
    elif isinstance(x, list):
        for item in x:
            yield path + STEP + ITEM, item
            yield from _below(item, path + STEP + ITEM)


def rendered(value: Any) -> str:
    """Text by which values are compared: a string itself, anything else as JSON with sorted keys."""
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def record_of(text: str | None) -> dict[str, Any]:
    """The object of a JSON text; nothing for null, broken and other texts."""
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def parent(path: str) -> str:
    return path.rpartition(STEP)[0]


def tops(paths: set[str]) -> list[str]:
    """Those without a parent among them, in order."""
    return sorted(p for p in paths if parent(p) not in paths)


def edit_script(old: Mapping[str, set[str]], new: Mapping[str, set[str]], agreement: Mapping[tuple[str, str], float]) -> list[Edit]:
    """Cheapest edits from old to new, trees given as path -> JSON types.

    Sibling labels are unique, so equal paths match. What is left, the topmost lost and new nodes, is matched by
    least cost: a lost node whose values agree for over half with those of a new one is renamed beneath the same parent
    or moved to another, and its children follow; others are deleted and added, each at the size of its subtree.
    """
    edits: list[Edit] = []
    _script(dict(old), dict(new), agreement, edits)
    return sorted(edits)


def _script(old: dict[str, set[str]], new: dict[str, set[str]], agreement: Mapping[tuple[str, str], float], edits: list[Edit]) -> None:
    for path in old.keys() & new.keys():
        a, b = old[path] - {"null"}, new[path] - {"null"}
        if a and b and a != b:
            edits.append(Edit("retyped", path, path, RETYPE))
    lost, come = tops(old.keys() - new.keys()), tops(new.keys() - old.keys())
    size = lambda tree, top: 1 + sum(p.startswith(top + STEP) for p in tree)
    cost = np.array([[_pair(p, q, agreement) for q in come] for p in lost]).reshape(len(lost), len(come))
    matched = _assign(cost, [DELETE * size(old, p) for p in lost], [ADD * size(new, q) for q in come])
    for i, j in matched:
        p, q = lost[i], come[j]
        edits.append(Edit("renamed" if parent(p) == parent(q) else "moved", p, q, float(cost[i, j])))
        under = lambda tree, top: {x[len(top) + 1 :]: kinds for x, kinds in tree.items() if x.startswith(top + STEP)}
        within: list[Edit] = []
        a, b = p + STEP, q + STEP
        _script(under(old, p), under(new, q), {(x[len(a) :], y[len(b) :]): share for (x, y), share in agreement.items() if x.startswith(a) and y.startswith(b)}, within)
        edits.extend(Edit(e.kind, p + STEP + e.path, q + STEP + e.new_path if e.new_path else "", e.cost) for e in within)
    edits.extend(Edit("removed", p, "", DELETE * size(old, p)) for i, p in enumerate(lost) if i not in {m[0] for m in matched})
    edits.extend(Edit("added", q, "", ADD * size(new, q)) for j, q in enumerate(come) if j not in {m[1] for m in matched})


def _pair(p: str, q: str, agreement: Mapping[tuple[str, str], float]) -> float:
    share = agreement.get((p, q), 0.0)
    return np.inf if share <= 0.5 else (RENAME if parent(p) == parent(q) else MOVE) + 1 - share


def _assign(cost: np.ndarray, delete: list[float], add: list[float]) -> list[tuple[int, int]]:
    """Least-cost matching of rows and columns, each of which may also stay alone at its own cost: shortest augmenting paths."""
    rows, columns = cost.shape
    if not rows or not columns or not np.isfinite(cost).any():
        return []
    n = rows + columns
    square = np.full((n, n), 1e9)
    square[:rows, :columns] = np.where(np.isfinite(cost), cost, 1e9)
    square[np.arange(rows), columns + np.arange(rows)] = delete
    square[rows + np.arange(columns), np.arange(columns)] = add
    square[rows:, columns:] = 0
    u, v, of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while of[j0]:
            used[j0] = True
            slack = square[of[j0] - 1] - u[of[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, np.concatenate([[np.inf], least[1:]]))))
            delta = least[j1]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    return [(of[j] - 1, j - 1) for j in range(1, columns + 1) if of[j] - 1 < rows and np.isfinite(cost[of[j] - 1, j - 1])]

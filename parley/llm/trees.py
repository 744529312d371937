"""Trees of Spark ML models as rules and as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TREE = re.compile(r"^\s*Tree \d+")
_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")
_LEAF = re.compile(r"^(\s*)Predict: (\S+)")


@dataclass(frozen=True)
class Leaf:
    """Conditions (feature, is "<=", threshold) from the root, and the prediction."""
    path: tuple[tuple[int, bool, float], ...]
    value: float


def tree_leaves(model) -> list[list[Leaf]]:
    """The leaves of every tree of a fitted tree ensemble over continuous features."""
    trees: list[list[Leaf]] = []
    path: list[tuple[int, tuple[int, bool, float]]] = []   # (indent, condition)
    for line in model.toDebugString.splitlines():
        if _TREE.match(line):
            trees.append([])
            path = []
        elif m := _SPLIT.match(line):
            indent = len(m[1])
            path = [p for p in path if p[0] < indent]
            path.append((indent, (int(m[3]), m[4] == "<=", float(m[5]))))
        elif m := _LEAF.match(line):
            path = [p for p in path if p[0] < len(m[1])]
            trees[-1].append(Leaf(tuple(c for _, c in path), float(m[2])))
    return trees


def path_condition(path: tuple[tuple[int, bool, float], ...], features: list[Column]) -> Column:
    """All conditions of a path, the strictest per feature and side."""
    sides: dict[tuple[int, bool], float] = {}
    for f, low, t in path:
        old = sides.get((f, low))
        sides[f, low] = t if old is None else min(old, t) if low else max(old, t)
    out = F.lit(True)
    for (f, low), t in sides.items():
        out = out & (features[f] <= F.lit(t) if low else features[f] > F.lit(t))
    return out


def tree_value(leaves: list[Leaf], features: list[Column]) -> Column:
    """The prediction of one tree as nested conditions."""
    def build(rest: list[Leaf], depth: int) -> Column:
        if len(rest) == 1 and len(rest[0].path) == depth:
            return F.lit(rest[0].value)
        f, low, t = rest[0].path[depth]
        here = [x for x in rest if x.path[depth] == rest[0].path[depth]]
        other = [x for x in rest if x.path[depth] != rest[0].path[depth]]
        test = features[f] <= F.lit(t) if low else features[f] > F.lit(t)
        return F.when(test, build(here, depth + 1)).otherwise(build(other, depth + 1))

    return build(leaves, 0)

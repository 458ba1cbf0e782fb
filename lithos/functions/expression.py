"""Numeric expression trees as nested tuples, compiled to one Column, and their random generation and crossover."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.functions import maths

#: Node kinds by name: number of children and the Column that they make.
NODES = {
    "add": (2, lambda a, b: a + b), "sub": (2, lambda a, b: a - b), "mul": (2, lambda a, b: a * b), "div": (2, maths.safe_divide),
    "abs": (1, F.abs), "neg": (1, lambda a: -a), "square": (1, lambda a: a * a), "exp": (1, F.exp), "log": (1, maths.safe_log),
    "sqrt": (1, lambda a: F.sqrt(F.abs(a))), "pow": (2, maths.whole_power), "squash": (1, maths.squash),
    "if": (4, lambda a, b, c, d: F.when(a >= b, c).otherwise(d)),
}


def column(tree) -> Column:
    """A tree is a number, a column's name, or (kind, child, ...)."""
    if isinstance(tree, str):
        return F.col(tree).cast("double")
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    kind, *children = tree
    arity, make = NODES[kind]
    if len(children) != arity:
        raise ValueError(f"{kind} takes {arity} children, not {len(children)}")
    return make(*map(column, children))


def random_tree(names: list[str], depth: int, rng: random.Random):
    """A tree of at most `depth` levels over these columns."""
    if depth <= 1 or rng.random() < 0.2:
        return rng.choice(names) if rng.random() < 0.7 else round(rng.uniform(-1, 1), 3)
    kind = rng.choice(sorted(set(NODES) - {"exp", "pow"}))
    return (kind, *(random_tree(names, depth - 1, rng) for _ in range(NODES[kind][0])))


def places(tree, at: tuple = ()) -> list[tuple]:
    """Paths of all nodes."""
    below = [p for i, c in enumerate(tree[1:], 1) for p in places(c, (*at, i))] if isinstance(tree, tuple) else []
    return [at, *below]


def subtree(tree, at: tuple):
    for i in at:
        tree = tree[i]
    return tree


def replaced(tree, at: tuple, new):
    if not at:
        return new
    i = at[0]
    return (*tree[:i], replaced(tree[i], at[1:], new), *tree[i + 1 :])


def crossover(a, b, rng: random.Random):
    """`a` with one of its subtrees replaced by one of `b`."""
    return replaced(a, rng.choice(places(a)), subtree(b, rng.choice(places(b))))


def perturbed(tree, rng: random.Random, scale: float = 0.1):
    """The tree with its numbers moved by normal noise."""
    if isinstance(tree, tuple):
        return (tree[0], *(perturbed(c, rng, scale) for c in tree[1:]))
    return tree + rng.gauss(0, scale) if isinstance(tree, (int, float)) else tree

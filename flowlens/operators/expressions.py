"""Synthesised features: expression trees over columns, written as text and read back, compiled to Spark columns, and searches for
good ones.

A generation's trees are compiled into one select, so the data is read once for all of them. There are two dialects: tables of operators
by name, with how many arguments each takes, how it is written and the column that it makes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import keep

from .evaluation import auc

#: The operators' names and the small numbers that keep a quotient and a root defined.
_QUOTIENT, _ROOT = 1e-6, 1e-12

Dialect = dict[str, tuple[int, str, Callable[..., Column]]]
OPERATORS: Dialect = {
    "+": (2, "({} + {})", lambda a, b: a + b),
    "-": (2, "({} - {})", lambda a, b: a - b),
    "*": (2, "({} * {})", lambda a, b: a * b),
    "/": (2, "({} / {})", lambda a, b: a / (F.abs(b) + _QUOTIENT)),
    "max": (2, "({} max {})", F.greatest),
    "min": (2, "({} min {})", F.least),
    "abs": (1, "abs({})", F.abs),
    "sqrt_abs": (1, "sqrt_abs({})", lambda a: F.sqrt(F.abs(a) + _ROOT)),
    "log1p_abs": (1, "log1p_abs({})", lambda a: F.log1p(F.abs(a))),
    "neg": (1, "(-{})", lambda a: -a),
}


#: Fixed value: what stands for a divisor nearer to 0 in the second dialect.
_LEAST = 1e-8
WORDS: Dialect = {
    "add": (2, "({} add {})", lambda a, b: a + b),
    "sub": (2, "({} sub {})", lambda a, b: a - b),
    "mul": (2, "({} mul {})", lambda a, b: a * b),
    "div": (2, "({} div {})", lambda a, b: a / F.when(F.abs(b) < _LEAST, _LEAST).otherwise(b)),
    "abs": (1, "abs({})", F.abs),
    "log1p": (1, "log1p({})", lambda a: F.log1p(F.abs(a))),
    "sqrt": (1, "sqrt({})", lambda a: F.sqrt(F.abs(a))),
    "neg": (1, "neg({})", lambda a: -a),
}
#: Fixed value: what binds less comes first; equal operators without brackets group from the right.
_LOOSEST_FIRST = ["max", "min", "+", "-", "*", "/", "add", "sub", "mul", "div"]


class Apply(NamedTuple):
    """An operator and its arguments. A leaf is no node of its own: a string is a column's name, a float a constant."""

    operator: str
    arguments: tuple[Tree, ...]


Tree = Apply | str | float


def apply(operator: str, *arguments: Tree, dialect: Dialect = OPERATORS) -> Apply:
    if len(arguments) != dialect[operator][0]:
        raise ValueError(f"{operator} takes {dialect[operator][0]} arguments")
    return Apply(operator, arguments)


def subtrees(tree: Tree) -> list[tuple[tuple[int, ...], Tree]]:
    """Every node and leaf with its path: which argument to follow from the root on."""
    below = [((k, *path), t) for k, x in enumerate(tree.arguments) for path, t in subtrees(x)] if isinstance(tree, Apply) else []
    return [((), tree), *below]


def text(tree: Tree, dialect: Dialect = OPERATORS) -> str:
    if isinstance(tree, Apply):
        return dialect[tree.operator][1].format(*(text(x, dialect) for x in tree.arguments))
    return tree if isinstance(tree, str) else f"{tree:.6g}"


_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?(?=[ )]|$)", re.I)


def parse(written: str, columns: list[str], dialect: Dialect = OPERATORS) -> Tree:
    """The tree that text() writes so. Column names may hold spaces, signs and brackets: the longest name that fits a place counts. An
    operator between two arguments stands between spaces; brackets may be left out. ValueError says where a text can't be read."""
    names = sorted(columns, key=lambda c: (-len(c), c))
    infix = [x for x in _LOOSEST_FIRST if x in dialect]
    prefix = [x for x, (n, _, _) in dialect.items() if n == 1 and x != "neg" or x == "neg" and dialect is not OPERATORS]
    at = 0

    def skip() -> None:
        nonlocal at
        while written[at : at + 1] == " ":
            at += 1

    def fail(wanted: str) -> ValueError:
        return ValueError(f"{wanted} expected at {at} in {written!r}")

    def close() -> None:
        nonlocal at
        skip()
        if written[at : at + 1] != ")":
            raise fail("')'")
        at += 1

    def leaf() -> Tree:
        nonlocal at
        skip()
        for name in names:
            end = at + len(name)
            if written.startswith(name, at) and (end == len(written) or written[end] in " )"):
                at = end
                return name
        for name in prefix:
            if written.startswith(f"{name}(", at):
                at += len(name) + 1
                inner = binary(0)
                close()
                return apply(name, inner, dialect=dialect)
        number = _NUMBER.match(written, at)
        if number:
            at = number.end()
            return float(number[0])
        signed = _NUMBER.match(written, at + 1)  # a bracket may begin with a number below 0
        if written.startswith("(-", at) and "neg" in dialect and not (signed and written[signed.end() : signed.end() + 1] == " "):
            at += 2
            inner = binary(0)
            close()
            return apply("neg", inner, dialect=dialect)
        if written.startswith("-", at) and "neg" in dialect:
            at += 1
            return apply("neg", leaf(), dialect=dialect)
        if written.startswith("(", at):
            at += 1
            inner = binary(0)
            close()
            return inner
        raise fail("a column, a number or '('")

    def binary(level: int) -> Tree:
        nonlocal at
        if level == len(infix):
            return leaf()
        left = binary(level + 1)
        if written.startswith(f" {infix[level]} ", at):
            at += len(infix[level]) + 2
            return apply(infix[level], left, binary(level), dialect=dialect)
        return left

    tree = binary(0)
    skip()
    if at < len(written):
        raise fail("the end")
    return tree


def column(tree: Tree, dialect: Dialect = OPERATORS) -> Column:
    """Every tree has a value on every row whose columns have one."""
    if isinstance(tree, Apply):
        return dialect[tree.operator][2](*(column(x, dialect) for x in tree.arguments))
    return F.col(f"`{tree}`").cast("double") if isinstance(tree, str) else F.lit(float(tree))


def replaced(tree: Tree, path: tuple[int, ...], new: Tree) -> Tree:
    """tree with `new` at a path."""
    if not path:
        return new
    k, rest = path[0], path[1:]
    return Apply(tree.operator, tuple(replaced(x, rest, new) if i == k else x for i, x in enumerate(tree.arguments)))


def grow(rng: random.Random, features: list[str], depth: int, dialect: Dialect = OPERATORS) -> Tree:
    if depth <= 0 or rng.random() < 0.25:
        return rng.choice(features) if rng.random() < 0.85 else round(rng.uniform(-2, 2), 2)
    operator = rng.choice(sorted(dialect))
    return apply(operator, *(grow(rng, features, depth - 1, dialect) for _ in range(dialect[operator][0])), dialect=dialect)


def equal_rows(df: DataFrame, features: list[str], *more: Column) -> DataFrame:
    """features and more, `rows`: how many rows are equal in them. A search reads this table, made once, in every generation."""
    return keep(df.groupBy(*[F.col(f"`{c}`") for c in features], *more).agg(F.count(F.lit(1)).alias("rows")), "equal-rows")


def score_trees(df: DataFrame, trees: list[Tree], positive: str, counted: bool = False) -> list[float | None]:
    """The fitness of each tree: its oriented AUC less 0.0025 for each node beyond the first; None without both classes. counted: df comes
    from equal_rows."""
    n = F.col("rows") if counted else F.lit(1).cast("long")
    rows = df.select(n.alias("rows"), F.explode(F.array(*[F.struct(F.lit(i).alias("tree"), column(t).alias("x"), F.col(positive).alias("y")) for i,
        t in enumerate(trees)])).alias("p")).select("rows", "p.*").where("x is not null and not isnan(x)")
    found = {r["tree"]: r["oriented_auc"] for r in auc(rows, ["tree"], "x", "y", "rows").collect()}  # a row for each tree
    return [found[i] - 0.0025 * (len(subtrees(t)) - 1) if i in found else None for i, t in enumerate(trees)]


def search(df: DataFrame, features: list[str], positive: str, population: int = 12, generations: int = 3, most_nodes: int = 25,
    seed: int = 1) -> list[tuple[Tree, float]]:
    """The trees of all generations with their fitness, the best first (ties by their text). A generation's new trees are scored in
    one pass; the next one keeps the best quarter and fills up with children of tournament winners, some of them mutated."""
    df, rng, known = equal_rows(df, features, F.col(positive)), random.Random(seed), {}
    living: list[Tree] = [*features, *(grow(rng, features, 3) for _ in range(population - len(features)))]
    order = lambda t: (-known[t], text(t))
    for _ in range(generations):
        new = [t for t in dict.fromkeys(living) if t not in known and len(subtrees(t)) <= most_nodes]
        known |= {t: fit for t, fit in zip(new, score_trees(df, new, positive, True) if new else [], strict=True) if fit is not None}
        pool = sorted({t for t in living if t in known}, key=order)
        if not pool:
            break
        winner = lambda pool=pool: min(rng.sample(pool, min(3, len(pool))), key=order)
        living = pool[: population // 4]
        while len(living) < population:
            one, gift = winner(), rng.choice(subtrees(winner()))[1]
            child = replaced(one, rng.choice(subtrees(one))[0], gift)
            if rng.random() < 0.3:
                child = replaced(child, rng.choice(subtrees(child))[0], grow(rng, features, 2))
            living.append(child)
    return [(t, known[t]) for t in sorted(known, key=order)]


def part_of(key: str, seed: int = 1, test: float = 0.3) -> Column:
    """train or test, by an md5 of seed and key."""
    return F.when(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") < test * 2**32,
        "test").otherwise("train")


def split_scores(df: DataFrame, trees: list[Tree], positive: str, key: str, seed: int = 1, test: float = 0.3,
    dialect: Dialect = OPERATORS, counted: bool = False) -> dict[Tree, tuple[float, ...]]:
    """Of each tree the AUC and the oriented AUC on the training part and on the test part; 0.5 where all values are equal.

    The parts are cut within each class by the order of an md5 of seed and key, so a tree's figures are the same on every run. What is
    no number counts as 0, infinities as 1,000,000 with their sign. counted: df comes from equal_rows and
    has its part."""
    part, n = (F.col("part"), F.col("rows")) if counted else (part_of(key, seed, test), F.lit(1).cast("long"))
    sound = lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), x)))
    each = [F.struct(F.lit(i).alias("tree"), F.round(sound(column(t, dialect)), 9).alias("x")) for i, t in enumerate(trees)]
    rows = df.select(F.col(positive).alias("y"), part.alias("part"), n.alias("rows"), F.explode(F.array(*each)).alias("p")).select("y", "part", "rows", "p.*")
    found = {(r["tree"], r["part"]): (r["auc"], r["oriented_auc"]) for r in auc(rows, ["tree", "part"], "x", "y", "rows").collect()}  # two rows for each tree
    return {t: (*found.get((i, "train"), (0.5, 0.5)), *found.get((i, "test"), (0.5, 0.5))) for i, t in enumerate(trees)}


def search_split(
    df: DataFrame, features: list[str], positive: str, key: str, population: int = 16, generations: int = 3, elite: int = 4, mutation: float = 0.3,
        crossover: float = 0.7, top: int = 10, seed: int = 1
) -> list[tuple[str, float, float, float, float]]:
    """The `top` expressions in the second dialect by oriented AUC on the test part, then on the training part: text and the four figures
    of split_scores. A generation keeps its `elite` best by the training part; children come from its best quarter."""
    df, rng, known = equal_rows(df, features, F.col(positive), part_of(key, seed).alias("part")), random.Random(seed), {}
    living = [grow(rng, features, 3, WORDS) for _ in range(population)]
    for _ in range(generations):
        new = [t for t in dict.fromkeys(living) if t not in known]
        known |= split_scores(df, new, positive, key, seed, dialect=WORDS, counted=True) if new else {}
        ranked = sorted(living, key=lambda t: (-known[t][1], text(t, WORDS)))
        parents, living = ranked[: max(2, population // 4)], ranked[:elite]
        while len(living) < population:
            child = rng.choice(parents)
            if rng.random() < crossover:
                child = replaced(child, rng.choice(subtrees(child))[0], rng.choice(subtrees(rng.choice(parents)))[1])
            if rng.random() < mutation:
                child = replaced(child, rng.choice(subtrees(child))[0], grow(rng, features, 3, WORDS))
            living.append(child)
    best = sorted(known, key=lambda t: (-known[t][3], -known[t][1], text(t, WORDS)))[:top]
    return [(text(t, WORDS), *known[t]) for t in best]

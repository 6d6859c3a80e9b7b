"""Nodes of a similarity search: rows (node, vertex) of vertices that may be alike.

A node may hold any number of vertices, so none is ever listed in one place:
company is found by sums, and pairs come from joins that give each vertex a
bounded number of partners. A small node is compared exhaustively. Of a larger one
each vertex is first compared with one leader, the vertex that stands in the
largest company over all nodes: the text that copies were made from is such a
vertex. Once the components of these links are known, only vertices of different
components are compared: where that takes few comparisons, all at once, as a
condition of a join, so that only pairs which can be links come out of it. Other
nodes have another star for what is outside the largest component, and then
branch on further tokens, at every level so often that two sets at the threshold
share one branch on average, until few comparisons are left or none.

Candidates are scored by sketches first. Of the first candidates, pairs of small
nodes and stars, each vertex then tries its likeliest partner; most pairs fall
inside a component after that and need no comparison. Later candidates lie in
different components as it is, and are all compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components

#: How often each vertex tries its likeliest partner before all of the first pairs are compared.
BEST_FIRST = 1
#: Tokens of a branch.
DEPTH = 2
#: A node branches if comparing it across its components takes more than the square of this.
MEDIUM = 1024
#: What ``apart`` adds.
PARTED = ("major", "n", "minor", "leader")
#: So often ``levels`` levels follow each other with fresh components between them. Nodes shrink at every level; what
#: is still large after all of them holds sets that agree on all tokens and are no links, and is compared across its components.
ROUNDS = 6

#: Of two vertices' features (longs), given as functions from a feature's name to its column: whether the pair can be a link, and how likely it is one.
Alike = Callable[[Callable[[str], Column], Callable[[str], Column]], tuple[Column, Column]]


def _branches(level: int, n_tokens: int, percent: int, trees: int) -> Column:
    """The branches of a node, each as the places of its tokens: so many on
    average that two sets at the threshold share ``trees`` of them."""
    whole, part = divmod(round(1e6 * trees * (100 / percent) ** DEPTH), 1_000_000)
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(level), F.lit(salt)), F.lit(n_tokens)).cast("int")
    all_of = [F.array(*(pick(f"{i}-{d}") for d in range(DEPTH))) for i in range(whole + 1)]
    more = F.pmod(F.xxhash64("node", F.lit(level), F.lit("more")), F.lit(1_000_000)) < part
    return F.when(more, F.array(*all_of)).otherwise(F.array(*all_of[:-1]))


def company(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one vertex, with ``n``, how many."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes.where("n > 1"), "node")


def central(rows: DataFrame) -> DataFrame:
    """``rows`` with central (the sizes of all of the vertex's nodes together) and
    ``leader``, the node's most central vertex."""
    rows = rows.join(rows.groupBy("vertex").agg(F.sum("n").alias("central")), "vertex")
    leaders = rows.groupBy("node").agg(F.max(F.struct("central", "vertex")).alias("_lead"))
    return rows.join(leaders.select("node", F.col("_lead.vertex").alias("leader")), "node")


def relabelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    known = label.select(F.col("id").alias("component"), F.col("component").alias("_found"))
    return rows.join(known, "component", "left").withColumn("component", F.coalesce("_found", "component")).drop("_found")


def apart(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold several components, with n (the node's vertices),
    major (the component of most of them), minor (how many are not of it) and
    leader (of the smallest components' vertices the most central)."""
    sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("central", "vertex")).alias("_lead"))
    sizes = sizes.groupBy("node").agg(
        F.max_by("component", F.struct("_n", "component")).alias("major"),
        F.sum("_n").alias("n"),
        (F.sum("_n") - F.max("_n")).alias("minor"),
        F.max(F.struct(-F.col("_n"), F.col("_lead"))).alias("_lead"),
    )
    sizes = sizes.where("minor > 0").select("node", "major", "n", "minor", F.col("_lead._lead.vertex").alias("leader"))
    return rows.join(sizes, "node")


def star(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of every vertex and its node's leader."""
    rows = rows.where("vertex <> leader")
    return rows.select(F.least("leader", "vertex").alias("a"), F.greatest("leader", "vertex").alias("b"))


def _own(features: DataFrame, end: str) -> list[Column]:
    """The features, longs all of them, as columns that are known not to be null:
    the code that is generated for comparing them stays short enough to be compiled."""
    return [F.coalesce(c, F.lit(0).cast("long")).alias(f"{c}_{end}") for c in features.columns if c != "vertex"]


def scored(pairs: DataFrame, features: DataFrame, alike: Alike) -> DataFrame:
    """The pairs that can be links, each once, with ``common``, higher for likelier ones."""
    pairs = pairs.distinct()
    for end in ("a", "b"):
        own = features.select(F.col("vertex").alias(end), *_own(features, end))
        pairs = pairs.join(own, end)
    possible, common = alike(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
    return pairs.where(possible).select("a", "b", common.alias("common"))


def across(rows: DataFrame, features: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b, common) of a node's vertices of different components that
    can be links: those outside the largest component against all."""
    rows = rows.select("node", "vertex", "component", "major").join(features, "vertex")
    one = rows.select("node", "major", F.col("vertex").alias("u"), F.col("component").alias("cu"), *_own(features, "u"))
    other = rows.where("component <> major").select("node", F.col("vertex").alias("v"), F.col("component").alias("cv"), *_own(features, "v"))
    possible, common = alike(lambda c: F.col(f"{c}_u"), lambda c: F.col(f"{c}_v"))
    both = one.join(other, "node").where(F.expr("cu <> cv AND (cu = major OR u < v)") & possible)
    return both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), common.alias("common")).distinct()


def linked(
    rows: DataFrame,
    features: DataFrame,
    alike: Alike,
    tokens: Callable[[DataFrame], DataFrame],
    n_tokens: int,
    percent: int,
    small: int,
    levels: int,
    fetch: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame, DataFrame], DataFrame],
    trees: int = 1,
    medium: int = MEDIUM,
    finer: tuple[Callable[[DataFrame], DataFrame], Alike] | None = None,
) -> tuple[DataFrame, list[DataFrame]]:
    """Components of the vertices of ``rows`` (node, vertex), as (id, component),
    and the links that made them.

    ``features`` (vertex, ...) is what ``alike`` judges by whether a pair can be a
    link; ``fetch`` takes pairs and returns what it needs of their vertices;
    ``confirm`` takes pairs and that, and returns the links among them. A node in
    which more than ``medium`` squared comparisons are left, of more than ``small``
    vertices outside its largest component, branches on ``tokens`` of its vertices (a function from (vertex) to
    (vertex, tokens: an array)), chosen by the node; the first time in ``trees``
    trees, for one alone misses more pairs the more levels follow. Nothing is left
    out: see ``ROUNDS``. ``finer`` are features that cost more, as a function like
    ``tokens``, and what judges by them, for comparing all of a large node.
    """
    links: list[DataFrame] = []
    held: list[DataFrame] = []

    def joined(pairs: DataFrame, label: DataFrame | None, best_first: int = 0) -> DataFrame:
        pairs = materialise(pairs, "scored")
        if label is not None and pairs.isEmpty():
            return label
        needed = fetch(pairs)
        held.append(needed)
        label = _resolved(pairs, label, links, lambda some: confirm(some, needed), best_first)
        if not links:
            links.append(confirm(pairs, needed))
        return label

    def branching(k: int) -> Column:
        return (F.col("minor") > small) & (F.col("minor") * F.col("n") > medium**2) & F.lit(k < ROUNDS - 1)

    rows = materialise(company(rows), "nodes")
    held.append(rows)
    few = rows.where(F.col("n") <= small).select("node", "vertex")
    pairs = few.join(few.select("node", F.col("vertex").alias("b")), "node").where("vertex < b").select(F.col("vertex").alias("a"), "b")
    large = rows.where(F.col("n") > small)
    if large.isEmpty():
        label = joined(scored(pairs, features, alike), None, BEST_FIRST)
    else:
        large = materialise(central(large), "nodes")
        held.append(large)
        label = joined(scored(pairs.unionByName(star(large)), features, alike), None, BEST_FIRST)
        own = tokens(large.select("vertex").distinct())
        held.append(own)
        fine, judge = features, alike
        if finer is not None:
            fine, judge = finer[0](large.select("vertex").distinct()), finer[1]
            held.append(fine)
        # From here on the rows carry their tokens and their component.
        rows = large.select("node", "vertex", "central", F.col("vertex").alias("component")).join(own, "vertex")
        for k in range(ROUNDS):
            rows = materialise(apart(relabelled(rows, label)), "nodes")
            held.append(rows)
            before, label = label, joined(scored(star(rows.where(branching(k)).where("component <> major")), features, alike), label)
            if label is not before:
                rows = materialise(apart(relabelled(rows.drop(*PARTED), label)), "nodes")
                held.append(rows)
            found = None
            for level in range(k * levels + 1, (k + 1) * levels + 1):
                pairs = across(rows.where(~branching(k)).drop("tokens"), fine, judge)
                found = pairs if found is None else found.unionByName(pairs)
                many = rows.where(branching(k))
                if done := many.isEmpty():
                    break
                branches = _branches(level, n_tokens, percent, trees if level == 1 else 1)
                further = many.select("node", "vertex", "central", "component", "tokens", F.explode(branches).alias("pick"))
                at = (F.element_at("tokens", F.col("pick")[d] + 1) for d in range(DEPTH))
                rows = further.select(F.xxhash64("node", "pick", *at).alias("node"), "vertex", "central", "component", "tokens")
                rows = materialise(apart(rows), "nodes")
                held.append(rows)
            label = joined(found.distinct(), label)
            if done:
                break
            rows = rows.drop(*PARTED)
    for table in held:
        discard(table)
    return label, links


def _resolved(scored: DataFrame, label: DataFrame | None, links: list[DataFrame], confirm: Callable[[DataFrame], DataFrame], best_first: int) -> DataFrame:
    """Components after all scored pairs: first each vertex's likeliest partner,
    ``best_first`` times, then every pair that still joins different components."""
    for step in range(best_first + 1):
        if scored.isEmpty():  # as it is of an empty table
            break
        tried, rest = scored, None
        if step < best_first:
            whole = F.struct(*scored.columns)
            ends = scored.select(F.explode(F.array("a", "b")).alias("v"), whole.alias("pair"))
            best = ends.groupBy("v").agg(F.max_by("pair", F.struct("pair.common", "pair.a", "pair.b")).alias("pair"))
            tried = materialise(best.select("pair.*").distinct(), "tried")
            rest = scored.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = confirm(tried)
        links.append(found)
        edges = found.select("a", "b")
        if label is not None:
            edges = edges.unionByName(label.select(F.col("id").alias("a"), F.col("component").alias("b")))
        label = connected_components(edges)
        if rest is None:
            discard(scored)
            break
        for end in ("a", "b"):
            rest = rest.join(label.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        before, scored = scored, materialise(rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(*scored.columns), "scored")
        discard(before)
        discard(tried)
    if label is None:
        none = scored.select("a", "b").limit(0)
        label = connected_components(none)
    return label

"""Components of links found in inverted lists, without all pairs of a long list.

First each member of a list meets the list's two centres, and short lists give all their pairs;
confirmed links are contracted to components. Then, in long lists that still hold several components,
the members outside the largest meet all others. So no two components are left with a link between
them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.components import components
from tidegauge.llm.tables import discard, settle

#: Lists of at most so many members give all their pairs at once.
SHORT = 8
#: Pairs looked at in one go, as each carries what both of its ends are, until there are ``GOES`` of these.
GO, GOES = 250_000, 8


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` whose ends aren't in one component of ``found`` (id, component)."""
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def connect(pairs: DataFrame, known: DataFrame, confirm: Callable, edges: DataFrame | None, found: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links of ``pairs``, added to ``edges``, and their components.

    The best partner of each item is looked at first; pairs that are in one component by then need
    no look, so most pairs of a large group are never compared in full.
    """
    best = settle(pairs.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b"), "best")
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for some in (best, rest):
        asked = settle(some if found is None else apart(some, found), "asked")
        goes, more = min(GOES, 1 + asked.count() // GO), False
        for i in range(goes):
            new = settle(confirm(asked.filter(F.pmod(F.xxhash64("a"), F.lit(goes)) == i), known), "links")
            if edges is None or new.take(1):
                edges, more = new if edges is None else edges.union(new), True
        discard(asked)
        if more:
            found = components(edges)
    discard(best)
    return edges, found


def resolve(lists: list[DataFrame], candidates: Callable, fetch: Callable, confirm: Callable, sketch: tuple[str, ...] = (), agree: Callable[[Callable, Callable], Column] | None = None, cross: Callable | None = None) -> DataFrame:
    """(id, component) of all ids with a confirmed link.

    ``lists``: (token, id, df) and the columns of ``sketch``; df is the number of the token's rows, 2
    at least. A token lies in one of the parts, which are shuffled one after another. ``agree(x, y)``, of two functions from column name to column, is a condition that all
    links fulfil; it is part of the joins, so that pairs which fail it are never rows.
    ``candidates``: of (a, b) and the sketches, a < b, the distinct pairs worth a full look as (a, b,
    matches), matches being higher the likelier the link; of more parts than one they are the same. ``fetch``: what ``confirm`` needs of some
    ids. ``confirm``: the linked pairs. ``cross``: given the members outside their list's largest
    component and all members of these lists, both (token, id, df, sketch, c), enough links (a, b) to
    join all components c that have one; without it, such pairs are joined like the first ones.
    """
    if agree is None:
        agree = lambda x, y: F.lit(True)
    short = lambda part: part.filter(F.col("df") <= SHORT)
    long = lambda part: part.filter(F.col("df") > SHORT)
    own = [met(short(part), None, sketch, agree).union(met(long(part), centres(long(part), sketch), sketch, agree)) for part in lists]
    pairs = gathered([settle(candidates(x), "pairs") for x in own])
    edges, found = connect(pairs, fetch(ends(pairs)), confirm, None, None)
    of = found.withColumnRenamed("component", "c")
    held = [settle(long(part).join(of, "id", "left").select("token", "id", "df", *sketch, F.coalesce("c", "id").alias("c")), "held") for part in lists]
    rest = []
    for part in held:
        sizes = part.groupBy("token", "c").agg(F.count("*").alias("n"))
        largest = settle(sizes.groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("token", "most"), "largest")
        outside, mixed = part.join(largest, "token").filter("c != most").drop("most"), part.join(largest.select("token"), "token", "left_semi")
        if cross is not None:
            rest.append(settle(cross(outside, mixed), "links"))
        else:
            rest.append(settle(candidates(met(outside, mixed, sketch, agree, differing=True)).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs"))
        discard(part)
    if cross is not None:
        new = reduce(DataFrame.union, rest)
        return components(edges.union(new)) if new.take(1) else found
    discard(pairs)
    rest = gathered(rest)
    if rest.take(1):
        edges, found = connect(rest, fetch(ends(rest)), confirm, edges, found)
    return found


def gathered(parts: list[DataFrame]) -> DataFrame:
    """The pairs of all parts, each once."""
    if len(parts) == 1:
        return parts[0]
    out = settle(reduce(DataFrame.union, parts).groupBy("a", "b").agg(F.max("matches").alias("matches")), "pairs")
    for part in parts:
        discard(part)
    return out


def centres(lists: DataFrame, sketch: tuple[str, ...]) -> DataFrame:
    """Two members of each list, chosen by a hash of their ids, so that lists of one group share theirs."""
    own, by = F.struct("id", *sketch), F.xxhash64("id")
    ends = lists.groupBy("token").agg(F.array(F.min_by(own, by), F.max_by(own, by)).alias("centres"))
    return ends.select("token", F.explode("centres").alias("centre")).select("token", "centre.*")


def met(lists: DataFrame, others: DataFrame | None, sketch: tuple[str, ...], agree: Callable, differing: bool = False) -> DataFrame:
    """(a, b) and both sketches of members of ``lists`` that meet one of ``others``, or each other, in
    a list and agree; of different components (c) only if ``differing``."""
    more = ("c",) if differing else ()
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in ("token", "id", *sketch, *more)))
    fits = (F.col("token_x") == F.col("token_y")) & agree(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))
    fits &= F.col("id_x") < F.col("id_y") if others is None else F.col("id_x") != F.col("id_y")
    if differing:
        fits &= F.col("c_x") != F.col("c_y")
    joined = side(lists, "x").join(side(lists if others is None else others, "y"), fits)
    return joined.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), *(F.col(f"{c}_{x}") for c in sketch for x in "xy"))

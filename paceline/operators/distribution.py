"""Exact distribution of the podium when places are drawn one after the other by weight.

With weights w summing to one, P(i first) = w_i, and a pair (j, k) takes the first two places with
probability w_j w_k / (1 - w_j). P(i second) and P(i third) are sums over the other entrants. The
sum for the third place runs over pairs; it is reduced to per-race aggregates, so work is linear in
the field:

    P3_i = w_i (T - R_i),  R_i = sum over k of g(w_i, w_k),  T = half the sum of R_i
    g(a, b) = a b (1/(1-a) + 1/(1-b)) / (1 - a - b)

The partners in the small head of largest weights are added one by one. For the others the term
1/(1 - a - b) is expanded in powers of b/(1-a), which is at most 1/HEAD because at least HEAD
partners weigh as much or more. With E_m the race's tail sum of w^m / (1 - w) this adds up to

    a/(1-a) (E_1 + sum over m of E_m / (1-a)^m)

so TERMS sums per race give the result to double precision.

One or two entrants may hold all but a trace of the weight. What is left after entrants of the head
is therefore added up from the others, never taken as a difference from one, and the sums for a
member of the head leave out its own terms instead of subtracting them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.ordering import sized, top_rows, with_group_totals
from paceline.session import fixed

HEAD = 10
TERMS = 13


def draw_weights(probs: DataFrame, key: Sequence[str], groups: int | None = None) -> DataFrame:
    """Probabilities scaled to one per race; even weights where fewer than three are positive."""
    totals = with_group_totals(
        probs, key, groups, _total=F.sum("prob"), _positive=F.count_if(F.col("prob") > 0), _n=F.count(F.lit(1))
    )
    weight = F.when(F.col("_positive") >= 3, F.col("prob") / F.col("_total")).otherwise(1 / F.col("_n"))
    return totals.withColumn("weight", weight).drop("_total", "_positive").withColumnRenamed("_n", "field_size")


def _heads(weights: DataFrame, key: Sequence[str], entity: str, size: int, groups: int | None, sums: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(races, entrants): per race the ``size`` heaviest (``h``: place, id, weight), the weight ``t`` of the tail and
    ``sums`` over the tail; every entrant with its ``slot`` in the head from 1, or 0."""
    ids = weights.select(*key, F.col(entity).alias("id"), "weight")
    best = top_rows(ids, key, [F.desc("weight"), F.asc("id")], size, "place")
    heads = fixed(best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "id", "weight"))).alias("h")))
    rows = weights.join(sized(heads, groups), list(key))
    # as structs, null ids compare like others
    slot = F.array_position(F.transform("h", lambda x: F.struct(x["id"].alias("id"))), F.struct(F.col(entity).alias("id")))
    rows = rows.withColumn("slot", slot)
    in_tail = F.col("slot") == 0
    tails = rows.filter(in_tail).groupBy(*key).agg(F.sum("weight").alias("t"), *sums)
    races = heads.join(sized(tails, groups), list(key), "left")
    return races.na.fill(0.0, [c for c in tails.columns if c not in key]), rows.drop("h")


def _tails(weights: DataFrame, best: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, tail): the weight of all entrants but the ``best``, without a join with the entrants.

    Weights are added up by power of two, and the best are taken out of the sum of their own power. What is left there
    weighs at least half as much a head as they do, so little is lost to rounding; where a count says that nothing is left, it is zero.
    """
    power = F.coalesce(F.floor(F.log2("weight")), F.lit(0)).alias("power")
    added = weights.groupBy(*key, power).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    taken = best.groupBy(*key, power).agg((-F.count(F.lit(1))).alias("n"), (-F.sum("weight")).alias("w"))
    left = added.unionByName(taken).groupBy(*key, "power").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return left.groupBy(*key).agg(F.sum(F.when(F.col("n") > 0, F.col("w")).otherwise(0.0)).alias("tail"))


def _rest(*left_out: str) -> str:
    """SQL for the weight of all entrants but the given places (from 0) of the head ``w``."""
    others = " AND ".join(f"k <> {i}" for i in left_out)
    return f"aggregate(filter(w, (y, k) -> {others}), t, (s, y) -> s + y)"


def place_probabilities(
    probs: DataFrame, key: Sequence[str], entity: str = "driver_id", groups: int | None = None
) -> DataFrame:
    """Adds p1, p2, p3 and the podium probability of every entrant; ``groups`` bounds the races.

    The weights are written once; all other intermediates have a row per race.
    """
    weights = fixed(draw_weights(probs, key, groups))
    powers = [F.expr(f"sum(pow(weight, {m}) / (1 - weight))").alias(f"e{m}") for m in range(1, TERMS + 1)]
    races, rows = _heads(weights, key, entity, HEAD, groups, powers)

    races = races.withColumn("w", F.expr("transform(h, x -> x.weight)"))
    races = races.withColumn("ratio", F.expr(f"transform(w, (x, i) -> coalesce(1 / nullif({_rest('i')}, 0D), 0D))"))
    races = races.withColumn("odds", F.expr("transform(w, (x, i) -> x * ratio[i])"))
    pair = f"coalesce(x * z * (ratio[i] + ratio[j]) / nullif({_rest('i', 'j')}, 0D), 0D)"
    races = races.withColumn("g", F.expr(f"transform(w, (x, i) -> transform(w, (z, j) -> CASE WHEN i = j THEN 0D ELSE {pair} END))"))

    def powers_of(ratio: str) -> str:
        horner = "0D"
        for m in range(TERMS, 0, -1):
            horner = f"(({horner} + e{m}) * {ratio})"
        return f"(e1 + {horner})"

    races = races.withColumn("s", F.expr(f"transform(w, (x, i) -> odds[i] * {powers_of('ratio[i]')})"))
    # for each head member, and for the tail (last), the sums over the head that leave it out
    add = "(a, b) -> a + b"
    left_out = "concat(transform(w, (x, i) -> i), array(-1))"
    races = races.withColumns(
        {
            "odds_of": F.expr(f"transform({left_out}, o -> aggregate(filter(odds, (y, k) -> k <> o), e1, {add}))"),
            "tails_of": F.expr(f"transform({left_out}, o -> aggregate(filter(s, (y, k) -> k <> o), 0D, {add}))"),
            "pairs_of": F.expr(
                f"transform({left_out}, o -> aggregate(transform(filter(sequence(0, size(w) - 1), i -> i <> o), "
                f"i -> aggregate(filter(g[i], (y, j) -> j > i AND j <> o), 0D, {add})), 0D, {add}))"
            ),
        }
    )
    sums = [f"e{m}" for m in range(1, TERMS + 1)]
    races = fixed(races.select(*key, "w", "ratio", "t", *sums, "odds_of", "tails_of", "pairs_of"))
    rows = rows.join(sized(races, groups), list(key))
    # an entrant of the tail leaves its own terms out of the sums by subtraction: they are the smallest
    own = "(weight / (1 - weight))"
    with_tail = f"({own} * {powers_of('(1 / (1 - weight))')} - 2 * weight * {own} / (1 - 2 * weight))"
    with_head = (
        "aggregate(transform(w, (x, i) -> coalesce(x * weight * (ratio[i] + 1 / (1 - weight)) "
        "/ nullif(1 / ratio[i] - weight, 0D), 0D)), 0D, (a, b) -> a + b)"
    )
    rows = rows.withColumn("_r", F.expr(f"CASE WHEN slot = 0 THEN {with_tail} ELSE 0D END"))
    total = rows.groupBy(*key).agg((F.sum("_r") / 2).alias("_tt"))
    rows = rows.join(sized(total, groups), list(key))
    rows = rows.withColumn("_o", F.expr("CASE WHEN slot = 0 THEN size(w) ELSE slot - 1 END").cast("int"))
    third = f"pairs_of[_o] + tails_of[_o] + _tt - CASE WHEN slot = 0 THEN {with_head} + _r ELSE 0D END"
    places = {
        "p1": F.col("weight"),
        "p2": F.expr(f"CASE WHEN field_size >= 2 THEN weight * (odds_of[_o] - CASE WHEN slot = 0 THEN {own} ELSE 0D END) ELSE 0D END"),
        "p3": F.expr(f"CASE WHEN field_size >= 3 THEN weight * ({third}) ELSE 0D END"),
    }
    placed = rows.withColumns(places).withColumn("podium_prob", F.expr("p1 + p2 + p3"))
    return placed.select(*probs.columns, *places, "podium_prob")


def _orderings(a: Column, b: Column, c: Column, left: Column) -> Column:
    """Probability that the three take the podium in any order, with ``left`` the weight of all others."""

    def first_two(x: Column, y: Column, z: Column) -> Column:
        return x * y / (y + z + left) + y * x / (x + z + left)

    def with_third(x: Column, y: Column, z: Column) -> Column:
        return first_two(x, y, z) * F.when(z + left > 0, z / (z + left)).otherwise(0.0)

    return with_third(a, b, c) + with_third(a, c, b) + with_third(b, c, a)


def top_combinations(
    probs: DataFrame, key: Sequence[str], k: int = 5, entity: str = "driver_id", groups: int | None = None
) -> DataFrame:
    """The k likeliest podium trios per race, best first; members are in order of weight.

    Replacing a member by a heavier entrant never lowers a trio's probability. A trio using the
    r-th heaviest entrant is therefore matched or beaten by the r - 3 trios that swap that member
    for one of the other heavier entrants; the k + 2 heaviest are all that can appear, so the
    search is exact.
    """
    weights = fixed(draw_weights(probs, key, groups).select(*key, F.col(entity).alias("id"), "weight"))
    best = top_rows(weights, key, [F.desc("weight"), F.asc("id")], k + 2, "rank")
    heads = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "weight"))).alias("m"))
    grouped = heads.join(_tails(weights, best, key), list(key))
    trio_ranks = [(a, b, c) for a in range(k + 2) for b in range(a + 1, k + 2) for c in range(b + 1, k + 2)]
    m = F.col("m")
    trios = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in trio_ranks]
    )
    exploded = grouped.select(*key, "m", "tail", F.explode(F.filter(trios, lambda t: t["c"] < F.size(m))).alias("t"))
    member = [F.get(m, F.col(f"t.{x}")) for x in "abc"]
    others = F.filter(m, lambda x, i: (i != F.col("t.a")) & (i != F.col("t.b")) & (i != F.col("t.c")))
    left = F.aggregate(others, F.col("tail"), lambda total, x: total + x["weight"])
    scored = exploded.select(
        *key,
        *[member[i]["id"].alias(f"member_{i + 1}") for i in range(3)],
        F.col("t").alias("_ranks"),
        _orderings(*[x["weight"] for x in member], left).alias("combo_prob"),
    )
    order = [F.desc(F.round("combo_prob", 12)), F.asc("_ranks")]
    return top_rows(scored, key, order, k, "combo_rank").drop("_ranks")

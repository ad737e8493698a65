import itertools
import random
from fractions import Fraction

import pytest

from paceline.operators.distribution import place_probabilities, top_combinations
from paceline.operators.podium import podium


def race(spark, probs, positions=None, number=1):
    rows = [(number, d, float(p), None if positions is None else positions.get(d)) for d, p in probs.items()]
    return spark.createDataFrame(rows, "ro long, driver_id string, prob double, place double")


def answer(df, position=None, threshold=0.05):
    return podium(df, ["ro"], position, threshold).orderBy("predicted_position").collect()


def test_exactly_three_places(spark):
    pick = random.Random(0)
    rows = answer(race(spark, {f"d{i}": pick.random() for i in range(20)}))
    assert [r.predicted_position for r in rows] == [1, 2, 3] and len({r.driver_id for r in rows}) == 3


def test_confidence(spark):
    high = answer(race(spark, dict(a=0.9, b=0.8, c=0.7, d=0.1, e=0.05)), threshold=0.10)
    assert high[0].confidence == pytest.approx(0.235294, abs=1e-6) and high[0].confidence_level == "high"
    low = answer(race(spark, dict(a=0.5, b=0.48, c=0.47, d=0.46, e=0.45)), threshold=0.10)
    assert low[0].confidence == pytest.approx(0.004237, abs=1e-6) and low[0].confidence_level == "low"


def test_ranking_by_position(spark):
    places = dict(ver=1.5, lec=2.1, ham=3.2, tail=5.0)
    rows = answer(race(spark, dict(ver=0.7, lec=0.6, ham=0.8, tail=0.1), places), "place")
    assert [r.driver_id for r in rows] == ["ver", "lec", "ham"]
    assert rows[0].confidence == pytest.approx(0.210344 - 0.115439, abs=1e-6)
    assert [r.probability for r in rows] == [0.7, 0.6, 0.8]


def test_fewer_than_four(spark):
    rows = answer(race(spark, dict(a=0.5, b=0.2)))
    assert [r.driver_id for r in rows] == ["a", "b"] and rows[0].confidence == 0.0


def brute(weights):
    """Ordered triples by definition."""
    out, trios = {d: [0.0, 0.0, 0.0] for d in weights}, {}
    for a, b, c in itertools.permutations(weights, 3):
        wa, wb, wc = weights[a], weights[b], weights[c]
        p = wa * wb / (1 - wa) * wc / (1 - wa - wb)
        for i, d in enumerate((a, b, c)):
            out[d][i] += p
        trios[frozenset((a, b, c))] = trios.get(frozenset((a, b, c)), 0) + p
    return out, trios


def exact_brute(probs):
    """By definition, in fractions."""
    whole = {d: Fraction(p) for d, p in probs.items()}
    total = sum(whole.values())
    weights = {d: p / total for d, p in whole.items()}
    out, trios = {d: [Fraction(0)] * 3 for d in weights}, {}
    for a, b, c in itertools.permutations(weights, 3):
        rest = sum(w for d, w in weights.items() if d != a)
        p = weights[a] * weights[b] / rest * weights[c] / (rest - weights[b])
        for i, d in enumerate((a, b, c)):
            out[d][i] += p
        trios[frozenset((a, b, c))] = trios.get(frozenset((a, b, c)), 0) + p
    return {d: [float(x) for x in ps] for d, ps in out.items()}, sorted(map(float, trios.values()), reverse=True)


def test_near_certain_fields(spark):
    fields = [
        dict(a=0.5, b=0.5, c=1e-18, d=1e-18),
        dict(a=1.0, b=1e-18, c=1e-18, d=3e-18),
        {"a": 1.0, "b": 1e-9, **{f"d{i}": 1e-25 * (1 + i) for i in range(14)}},
        {f"d{i}": 10.0 ** (-7 * i) for i in range(13)},
    ]
    for number, probs in enumerate(fields):
        want, trios = exact_brute(probs)
        df = race(spark, probs, number=number)
        for r in place_probabilities(df, ["ro"]).collect():
            assert [r.p1, r.p2, r.p3] == pytest.approx(want[r.driver_id], rel=1e-6, abs=1e-12)
        best = top_combinations(df, ["ro"]).orderBy("combo_rank").collect()
        assert [r.combo_prob for r in best] == pytest.approx(trios[:5], rel=1e-6, abs=1e-12)


def races():
    pick = random.Random(5)
    yield dict(a=0.5, b=0.3, c=0.1, d=0.05, e=0.05)
    yield dict(a=0.9, b=0.05, c=0.03, d=0.02)
    yield dict(a=0.55, b=0.4489, c=0.001, d=0.0001)
    yield {f"d{i}": 1.0 for i in range(25)}
    yield {f"d{i}": pick.random() ** 4 for i in range(24)}
    yield {f"d{i}": 10.0 if i < 2 else pick.random() * 1e-3 for i in range(22)}


def test_place_probabilities_equal_brute_force(spark):
    for number, probs in enumerate(races()):
        total = sum(probs.values())
        exact, trios = brute({d: p / total for d, p in probs.items()})
        df = race(spark, probs, number=number)
        for r in place_probabilities(df, ["ro"]).collect():
            assert [r.p1, r.p2, r.p3] == pytest.approx(exact[r.driver_id], abs=1e-10)
        best = sorted(trios.values(), reverse=True)[:5]
        got = top_combinations(df, ["ro"]).orderBy("combo_rank").collect()
        assert [r.combo_prob for r in got] == pytest.approx(best, abs=1e-12)
        for r in got:
            assert r.combo_prob == pytest.approx(trios[frozenset((r.member_1, r.member_2, r.member_3))], abs=1e-12)


def test_known_distribution(spark):
    df = race(spark, dict(a=0.5, b=0.3, c=0.1, d=0.05, e=0.05))
    rows = {r.driver_id: r for r in place_probabilities(df, ["ro"]).collect()}
    assert rows["a"].p2 == pytest.approx(0.322473, abs=1e-6)
    assert rows["c"].p3 == pytest.approx(0.303097, abs=1e-6)
    assert [rows[d].podium_prob for d in "abcde"] == pytest.approx([0.958875, 0.892724, 0.556481, 0.29596, 0.29596], abs=1e-6)
    assert top_combinations(df, ["ro"], 1).first().combo_prob == pytest.approx(0.437302, abs=1e-6)


def test_degenerate_fields(spark):
    even = place_probabilities(race(spark, dict(a=0.7, b=0.0, c=0.0, d=0.0)), ["ro"]).collect()
    assert all(r.podium_prob == pytest.approx(0.75) for r in even)
    pair = {r.driver_id: r for r in place_probabilities(race(spark, dict(a=0.6, b=0.2)), ["ro"]).collect()}
    assert pair["a"].p1 == pytest.approx(0.5) and pair["a"].p2 == pytest.approx(0.5) and pair["a"].p3 == 0.0

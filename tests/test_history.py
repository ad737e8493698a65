import pytest
from pyspark.sql import functions as F

from paceline.operators import history
from paceline.operators.features import spread_of_times, teammate_gaps
from paceline.sources.league import standings_before

RESULTS = (
    "race_id string, ro long, year long, round long, driver_id long, constructor_id long, position long, status string, "
    "points double, is_podium long"
)


def results(spark, rows):
    full = [
        (f"{y}_{r}", y * 100 + r, y, r, d, c, p, s, float(pts), int(p is not None and p <= 3)) for y, r, d, c, p, s, pts in rows
    ]
    return spark.createDataFrame(full, RESULTS)


def roster(df):
    return df.withColumnRenamed("position", "finish_position").withColumn("circuit_id", (F.col("round") % 2).cast("string"))


def test_history_is_chronological(spark):
    """Round 10 comes after round 2 although its id sorts before it as text."""
    df = results(spark, [(2024, r, 1, 1, r, "Finished", 0) for r in (1, 2, 3, 10)])
    form = {r.ro: r for r in history.recent_form(roster(df)).collect()}
    assert form[202401].driver_last5_avg_pos == 15.0
    assert form[202402].driver_last5_avg_pos == 1.0
    assert form[202410].driver_last5_avg_pos == pytest.approx(2.0)


def test_unclassified_races_take_no_slot(spark):
    places = [1, None, 2, None, 3, 4, 5, 6, None]
    df = results(spark, [(2024, i + 1, 1, 1, p, "Finished" if p else "Engine", 0) for i, p in enumerate(places)])
    form = {r.ro: r for r in history.recent_form(roster(df)).collect()}
    assert form[202409].driver_last5_avg_pos == pytest.approx((2 + 3 + 4 + 5 + 6) / 5)
    assert form[202409].driver_last3_avg_pos == pytest.approx(5.0)
    assert form[202402].driver_last5_avg_pos == 1.0 and form[202403].driver_last5_avg_pos == 1.0


def test_team_rates(spark):
    rows = [(2024, r, d, 7, 1, "Finished" if (r + d) % 3 else "Engine", 0) for r in range(1, 13) for d in range(1, 31)]
    df = results(spark, rows)
    got = {r.ro: r for r in history.team_history(df, roster(df)).collect()}
    past = [(r, d, int((r + d) % 3 != 0)) for r in range(1, 12) for d in range(1, 31)]
    last20 = sorted(past)[-20:]
    assert got[202412].constructor_reliability == pytest.approx(sum(x[2] for x in last20) / 20)
    assert got[202412].constructor_season_reliability == pytest.approx(sum(x[2] for x in past) / len(past))
    at_circuit = [x for x in past if x[0] % 2 == 0]
    assert got[202412].constructor_circuit_reliability == pytest.approx(sum(x[2] for x in at_circuit) / len(at_circuit))
    assert got[202401].constructor_reliability == 0.9 and got[202401].constructor_survival_prob == pytest.approx(0.9)


def test_standings_carry_absent_drivers(spark):
    df = results(spark, [(2024, 1, 1, 1, 1, "Finished", 25), (2024, 1, 2, 1, 2, "Finished", 18), (2024, 2, 2, 1, 1, "Finished", 25),
                         (2024, 3, 2, 1, 1, "Finished", 25)])
    races = df.select("race_id", "ro", "year", "round").distinct()
    got = {(r.round, r.driver_id): (r.points, r.position) for r in standings_before(df, races).collect()}
    assert got == {(2, 1): (25.0, 1), (2, 2): (18.0, 2), (3, 1): (25.0, 2), (3, 2): (43.0, 1)}


def test_teammate_and_spread(spark):
    rows = [(1, 1, 10, 1, None, None, 70.0), (1, 1, 11, 2, 71.0, None, None), (1, 1, 12, 3, None, 72.5, None), (1, 2, 13, 4, 75.0, None, None)]
    quali = spark.createDataFrame(
        rows, "ro long, constructor_id long, driver_id long, position long, q1_sec double, q2_sec double, q3_sec double"
    )
    gaps = {r.driver_id: r.teammate_quali_gap for r in teammate_gaps(quali).collect()}
    assert gaps == {10: -1.0, 11: 1.0, 12: 2.5, 13: 0.0}
    df = spark.createDataFrame([(70.0, 72.0, None), (70.0, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(spread_of_times("a", "b", "c")).collect()] == [1.0, None]

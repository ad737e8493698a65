import pytest
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.sources import landing


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_lap_text_to_seconds(spark):
    assert one(spark, rules.lap_seconds, "1:23.456", "bad", None) == [pytest.approx(83.456), None, None]


def test_gap_text(spark):
    got = one(spark, rules.gap_seconds, "12.5", "3.2", "+1 LAP", "+2 LAPS", "LAP", "x", None)
    assert got == [12.5, 3.2, 90.0, 180.0, 999.0, None, None]


def test_weather_codes(spark):
    got = one(spark, rules.weather_condition, 0, 3, 45, 61, 75, 95, 120, None, kind="int")
    assert got == ["dry", "dry", "cloudy", "rain", "snow", "storm", "unknown", "unknown"]


def test_safe_int(spark):
    assert one(spark, rules.safe_int, "3", " 3 ", "3.0", "x", None) == [3, 3, None, None, None]


def test_finished(spark):
    assert one(spark, rules.finished, "Finished", "+1 Lap", "Engine", "", None) == [True, True, False, False, False]


def test_codes_and_steps(spark):
    assert one(spark, rules.compound_code, "soft", "HARD", "WET", "other", None) == [0, 2, 4, 1, 1]
    assert one(spark, rules.circuit_type_code, "street", "high_speed", None) == [0, 2, 1]
    assert one(spark, rules.position_probability, 1, 2, 3, 5, 8, 12, 13, kind="int") == [
        0.85, 0.75, 0.65, 0.30, 0.10, 0.03, 0.01]
    assert one(spark, rules.confidence_level, 0.11, 0.1, 0.06, 0.01, kind="double") == ["high", "high", "medium", "low"]


def test_labels(spark):
    assert one(spark, rules.lap_text, 83.456, 60.0, kind="double") == ["1:23.456", "1:00.000"]
    assert one(spark, rules.title, "max_power") == ["Max Power"]
    assert one(spark, rules.match_marks, 0, 2, 3, kind="int") == ["❌", "✅✅", "✅✅✅"]
    assert one(spark, lambda x: rules.dnf_note(F.lit("red_team"), x), 0.97, 0.9, 0.5, kind="double") == [
        "Low — Red Team reliability 97%", "Moderate — Red Team reliability 90%", "Elevated — Red Team reliability 50%"]


def test_circuits(spark):
    assert one(spark, landing.circuit_key, "villeneuve", "monza", "new") == ["montreal", "monza", "new"]
    known = {r.circuit_id: r for r in landing.known_circuits(spark).collect()}
    assert len(known) == 24 and known["monaco"].type == "street" and known["monaco"].overtake_difficulty == 0.95
    assert "nowhere" not in known and len(C.FEATURES) == 23


def test_interval_seconds(spark):
    df = spark.sql("SELECT INTERVAL '1 02:03:04.5' DAY TO SECOND AS i")
    assert df.select(rules.interval_seconds(F.col("i"))).first()[0] == pytest.approx(86400 + 7384.5)

"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions import constants as C


def lap_seconds(text: Column) -> Column:
    """``M:SS.mmm`` prefix to seconds, else null."""
    pattern = r"^(\d+):(\d+\.\d+)"
    minutes = F.regexp_extract(text, pattern, 1).try_cast("double")
    seconds = F.regexp_extract(text, pattern, 2).try_cast("double")
    return minutes * 60 + seconds


def safe_int(text: Column) -> Column:
    return text.try_cast("long")


def safe_float(text: Column) -> Column:
    return text.try_cast("double")


def interval_seconds(interval: Column) -> Column:
    """Day-time interval to fractional seconds."""
    return (
        F.extract(F.lit("DAY"), interval) * 86400
        + F.extract(F.lit("HOUR"), interval) * 3600
        + F.extract(F.lit("MINUTE"), interval) * 60
        + F.extract(F.lit("SECOND"), interval)
    ).cast("double")


def race_id(year: Column, round_: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), round_.cast("string"))


def race_order(year: Column, round_: Column) -> Column:
    """Integer that sorts races by time (race ids as text do not)."""
    return (year * 100 + round_).cast("long")


def year_of(race: Column) -> Column:
    return F.split(race, "_")[0].cast("long")


def finished(status: Column) -> Column:
    return F.coalesce((status == "Finished") | status.startswith("+"), F.lit(False))


def podium_flag(position: Column) -> Column:
    return F.when(position.between(1, 3), 1).otherwise(0).cast("long")


def gap_seconds(gap: Column) -> Column:
    """Number, numeric text or ``+k LAP`` to seconds."""
    lapped = F.upper(gap).contains("LAP")
    laps = F.regexp_replace(F.split(F.trim(gap), r"\s+")[0], r"\+", "").try_cast("int")
    return F.when(lapped, F.coalesce(laps * C.LAP_GAP_SECONDS, F.lit(C.DEFAULT_GAP))).otherwise(gap.try_cast("double"))


def _coded(value: Column, codes: dict[str, int], default: int) -> Column:
    out = None
    for name, code in codes.items():
        out = F.when(value == name, code) if out is None else out.when(value == name, code)
    return out.otherwise(default).cast("long")


def compound_code(compound: Column) -> Column:
    return _coded(F.upper(compound), C.COMPOUNDS, 1)


def circuit_type_code(kind: Column) -> Column:
    return _coded(kind, C.CIRCUIT_TYPES, 1)


def _banded(value: Column, bands: list[tuple], rest) -> Column:
    """First band whose upper edge holds ``value``; ``rest`` above the last (null included)."""
    out = None
    for edge, label in bands:
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out.otherwise(rest)


def weather_condition(code: Column) -> Column:
    return _banded(code, C.WEATHER_BANDS, "unknown")


def position_probability(position: Column) -> Column:
    return _banded(position, C.POSITION_PROBABILITY, C.POSITION_PROBABILITY_REST)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence_level(margin: Column, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    return F.when(margin >= 2 * threshold, "high").when(margin >= threshold, "medium").otherwise("low")


def probability_band(prob: Column) -> Column:
    return F.when(prob > 0.5, "favourite").when(prob > 0.2, "contender").otherwise("outsider")


def estimated_lap(position: Column) -> Column:
    return C.BASE_LAP_SECONDS + C.LAP_SECONDS_PER_PLACE * (position - 1)


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def lap_text(seconds: Column) -> Column:
    """Seconds to ``m:ss.mmm``; null without a time."""
    millis = F.round(seconds * 1000).cast("long")
    text = F.format_string("%d:%02d.%03d", F.floor(millis / 60000), F.floor(millis % 60000 / 1000), millis % 1000)
    return F.when(seconds.isNotNull(), text)


def dnf_note(team: Column, reliability: Column) -> Column:
    band = None
    for edge, label in C.DNF_BANDS:
        band = F.when(reliability >= edge, label) if band is None else band.when(reliability >= edge, label)
    band = band.otherwise(C.DNF_BAND_REST)
    return F.format_string("%s — %s reliability %s%%", band, title(team), F.round(reliability * 100).cast("int"))


def match_marks(correct: Column) -> Column:
    return F.when(correct.between(1, 3), F.repeat(F.lit("✅"), correct.cast("int"))).otherwise("❌")


def tidy(value: Column, digits: int = 6) -> Column:
    """Round for reports; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)

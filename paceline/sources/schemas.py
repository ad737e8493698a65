"""Explicit schemas of landed documents (every scalar of the history feed is text)."""

NAMED_DRIVER = "struct<driverId:string, code:string, givenName:string, familyName:string, nationality:string>"
NAMED_TEAM = "struct<constructorId:string, name:string, nationality:string>"
CIRCUIT = "struct<circuitId:string, circuitName:string, Location:struct<country:string>>"
RACE_HEAD = f"season:string, round:string, raceName:string, date:string, Circuit:{CIRCUIT}"
RESULT = (
    "struct<position:string, positionText:string, grid:string, points:string, laps:string, status:string, "
    f"FastestLap:struct<rank:string>, Driver:{NAMED_DRIVER}, Constructor:{NAMED_TEAM}>"
)
QUALIFYING = f"struct<position:string, Q1:string, Q2:string, Q3:string, Driver:{NAMED_DRIVER}, Constructor:{NAMED_TEAM}>"
PIT_STOP = "struct<driverId:string, stop:string, lap:string, duration:string>"
STANDING = f"struct<points:string, position:string, Driver:{NAMED_DRIVER}, Constructors:array<{NAMED_TEAM}>>"
TEAM_STANDING = f"struct<points:string, position:string, Constructor:{NAMED_TEAM}>"


def race_document(*lists: str) -> str:
    fields = ", ".join([RACE_HEAD, *lists])
    return f"MRData struct<RaceTable:struct<Races:array<struct<{fields}>>>>"


RESULTS_DOC = race_document(f"Results:array<{RESULT}>")
QUALIFYING_DOC = race_document(f"QualifyingResults:array<{QUALIFYING}>")
PIT_STOPS_DOC = race_document(f"PitStops:array<{PIT_STOP}>")
CALENDAR_DOC = race_document()
STANDINGS_DOC = (
    "MRData struct<StandingsTable:struct<StandingsLists:array<struct<season:string, round:string, "
    f"DriverStandings:array<{STANDING}>, ConstructorStandings:array<{TEAM_STANDING}>>>>>"
)
DRIVERS_DOC = f"MRData struct<DriverTable:struct<Drivers:array<{NAMED_DRIVER}>>>"
TEAMS_DOC = f"MRData struct<ConstructorTable:struct<Constructors:array<{NAMED_TEAM}>>>"
CIRCUITS_DOC = "circuits map<string, struct<lat:double, lon:double, type:string, overtake_difficulty:double>>"
FORECAST_DOC = (
    "race_id string, circuit_id string, daily struct<temperature_2m_max:array<double>, "
    "precipitation_probability_max:array<double>, windspeed_10m_max:array<double>, "
    "relative_humidity_2m_max:array<double>, weathercode:array<bigint>>"
)

# one schema per live feed; a gap is a variant because it is a number, numeric text or "+1 LAP"
LIVE_FEEDS = {
    "sessions": "session_key bigint, year bigint, country_name string, meeting_name string, session_type string, "
    "date_start timestamp",
    "drivers": "session_key bigint, driver_number bigint, name_acronym string, team_name string",
    "laps": "session_key bigint, driver_number bigint, lap_number bigint, lap_duration double, date_start timestamp",
    "intervals": "session_key bigint, driver_number bigint, gap_to_leader variant, interval variant, date timestamp",
    "position": "session_key bigint, driver_number bigint, position bigint, date timestamp",
    "car_data": "session_key bigint, driver_number bigint, speed double, throttle double, brake double, rpm double, "
    "n_gear bigint, drs bigint, date timestamp",
    "pit": "session_key bigint, driver_number bigint, lap_number bigint, pit_duration double, date timestamp",
    "stints": "session_key bigint, driver_number bigint, stint_number bigint, compound string, "
    "tyre_age_at_start bigint, lap_start bigint, lap_end bigint",
    "race_control": "session_key bigint, category string, message string, lap_number bigint, date timestamp",
    "weather": "session_key bigint, air_temperature double, track_temperature double, humidity double, "
    "rainfall double, wind_speed double, date timestamp",
}

# stored tables; race tables carry the sortable race order and the year they are partitioned by
_RACE_KEYS = "race_id string, ro bigint, year bigint"
TABLES = {
    "races": f"{_RACE_KEYS}, round bigint, circuit_id string, circuit_name string, country string, race_date date, "
    "total_laps bigint",
    "drivers": "driver_id string, code string, full_name string, nationality string, bucket bigint",
    "constructors": "constructor_id string, name string, nationality string, bucket bigint",
    "results": f"{_RACE_KEYS}, driver_id string, constructor_id string, grid bigint, position bigint, "
    "position_text string, status string, points double, laps_completed bigint, fastest_lap_rank bigint, is_podium bigint",
    "qualifying": f"{_RACE_KEYS}, driver_id string, constructor_id string, position bigint, q1_sec double, q2_sec double, "
    "q3_sec double",
    "practice_sessions": f"{_RACE_KEYS}, driver_id string, session_type string, best_lap_sec double, avg_lap_sec double, "
    "laps_completed bigint",
    "pit_stops": f"{_RACE_KEYS}, driver_id string, stop_number bigint, lap bigint, duration_sec double",
    "weather": f"{_RACE_KEYS}, temperature double, precipitation_prob double, wind_speed double, humidity double, "
    "condition string",
    "standings_snapshot": f"{_RACE_KEYS}, driver_id string, points double, position bigint, constructor_id string, "
    "constructor_pts double, constructor_pos bigint",
}

import json

import pytest
from pyspark.sql import functions as F

from checks import landing as documents_of
from paceline.plans.store import Store
from paceline.sources import landing, merge, schemas, tables
from paceline.sources.feeds import Feeds


def write(path, *documents):
    path.mkdir()
    text = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    (path / "part.json").write_text("\n".join(text) + "\n")
    return str(path)


def race(**lists):
    head = {"season": "2024", "round": "3", "raceName": "X GP", "date": "2024-03-24",
            "Circuit": {"circuitId": "villeneuve", "circuitName": "V", "Location": {"country": "Canada"}}}
    return {"MRData": {"RaceTable": {"Races": [{**head, **lists}]}}}


RESULTS = [
    {"position": "1", "positionText": "1", "grid": "2", "points": "25", "laps": "50", "status": "Finished",
     "FastestLap": {"rank": "1"}, "Driver": {"driverId": "a", "code": "AAA", "givenName": "A", "familyName": "B", "nationality": "N"},
     "Constructor": {"constructorId": "t", "name": "T", "nationality": "N"}},
    {"position": "3.0", "positionText": "R", "grid": "x", "points": None, "status": None, "Driver": {"driverId": "b", "givenName": "C"}},
]


def test_results(spark, tmp_path):
    docs = landing.read_documents(spark, write(tmp_path / "r", race(Results=RESULTS)), schemas.RESULTS_DOC)
    rows = {r.driver_id: r for r in landing.results(docs).collect()}
    assert (rows["a"].position, rows["a"].is_podium, rows["a"].points, rows["a"].fastest_lap_rank) == (1, 1, 25.0, 1)
    assert (rows["b"].position, rows["b"].is_podium, rows["b"].grid, rows["b"].status) == (None, 0, None, "")
    found = landing.races(docs).first()
    assert (found.race_id, found.ro, found.circuit_id, found.country) == ("2024_3", 202403, "montreal", "Canada")
    people = {r.driver_id: r.full_name for r in landing.drivers(docs).collect()}
    assert people == {"a": "A B", "b": "C"}


def test_broken_documents_are_counted(spark, tmp_path):
    path = write(tmp_path / "b", race(Results=RESULTS), json.dumps(race(Results=RESULTS))[:-9])
    docs = landing.read_documents(spark, path, schemas.RESULTS_DOC)
    report = landing.ingest_report(docs).first()
    assert (report.year, report.ingested, report.failed) == (2024, 1, 1)
    assert landing.results(docs).count() == 2


def test_whole_file_documents(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.json").write_text(json.dumps(race(Results=RESULTS), indent=2))
    docs = landing.read_documents(spark, str(tmp_path / "w"), schemas.RESULTS_DOC, whole_file=True)
    assert landing.results(docs).count() == 2


def test_qualifying_and_pit_stops(spark, tmp_path):
    quali = [{"position": "1", "Q1": "1:23.456", "Q2": "bad", "Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}}]
    docs = landing.read_documents(spark, write(tmp_path / "q", race(QualifyingResults=quali)), schemas.QUALIFYING_DOC)
    row = landing.qualifying(docs).first()
    assert (row.q1_sec, row.q2_sec, row.q3_sec) == (pytest.approx(83.456), None, None)
    stops = [{"driverId": "a", "stop": "1", "lap": "20", "duration": "22.5"}, {"driverId": "a", "stop": "2", "lap": "40", "duration": "1:02.1"}]
    docs = landing.read_documents(spark, write(tmp_path / "p", race(PitStops=stops)), schemas.PIT_STOPS_DOC)
    got = {r.stop_number: r.duration_sec for r in landing.pit_stops(docs).collect()}
    assert got == {1: 22.5, 2: None}


def test_standings_shift_and_lookup(spark, tmp_path):
    lists = {"season": "2024", "round": "3",
             "DriverStandings": [{"points": "10", "position": "1", "Driver": {"driverId": "a"}, "Constructors": [{"constructorId": "t"}, {"constructorId": "u"}]},
                                 {"points": "5", "position": "2", "Driver": {"driverId": "b"}, "Constructors": []}],
             "ConstructorStandings": [{"points": "12", "position": "1", "Constructor": {"constructorId": "t"}}]}
    doc = {"MRData": {"StandingsTable": {"StandingsLists": [lists]}}}
    docs = landing.read_documents(spark, write(tmp_path / "s", doc), schemas.STANDINGS_DOC)
    got = {r.driver_id: (r.race_id, r.constructor_id, r.constructor_pts) for r in landing.standings(docs).collect()}
    assert got == {"a": ("2024_4", "t", 12.0), "b": ("2024_4", "", None)}


def test_standings_sent_again(spark, tmp_path):
    """Both lists corrected, then either alone; the store keeps the last of both."""

    def doc(name, drivers=(), teams=()):
        lists = {"season": "2024", "round": "3",
                 "DriverStandings": [{"points": p, "position": "1", "Driver": {"driverId": d}, "Constructors": [{"constructorId": t}]} for d, t, p in drivers],
                 "ConstructorStandings": [{"points": p, "position": "1", "Constructor": {"constructorId": t}} for t, p in teams]}
        return write(tmp_path / name, {"MRData": {"StandingsTable": {"StandingsLists": [lists]}}})

    loads = [
        doc("1", [("a", "t", "10"), ("b", "t", "4")], [("t", "100"), ("u", "9")]),
        doc("2", [("a", "t", "20")], [("t", "200")]),
        doc("3", teams=[("t", "300")]),
        doc("4", drivers=[("a", "u", "30")]),
    ]
    want = [
        {"a": ("t", 10.0, 100.0), "b": ("t", 4.0, 100.0)},
        {"a": ("t", 20.0, 200.0), "b": ("t", 4.0, 200.0)},
        {"a": ("t", 20.0, 300.0), "b": ("t", 4.0, 300.0)},
        # the points of a team that no stored driver was in are not known any more
        {"a": ("u", 30.0, None), "b": ("t", 4.0, 300.0)},
    ]
    store = Store(spark, str(tmp_path / "tables"))
    for load, expected in zip(loads, want, strict=True):
        store.ingest(standings=load)
        rows = store.table("standings_snapshot").collect()
        assert {r.driver_id: (r.constructor_id, r.points, r.constructor_pts) for r in rows} == expected and len(rows) == 2
    docs = landing.read_documents(spark, str(tmp_path / "[12]"), schemas.STANDINGS_DOC, ordered=True)
    rows = landing.standings(docs).collect()
    assert {r.driver_id: (r.constructor_id, r.points, r.constructor_pts) for r in rows} == want[1] and len(rows) == 2


def test_forecast(spark, tmp_path):
    daily = {"temperature_2m_max": [21.5, 30.0], "precipitation_probability_max": [], "weathercode": [61]}
    path = write(tmp_path / "f", {"race_id": "x", "circuit_id": "monza", "daily": daily},
                 {"race_id": "y", "circuit_id": "nowhere", "daily": daily})
    docs = spark.read.schema(schemas.FORECAST_DOC).json(path)
    got = {r.race_id: r for r in landing.forecasts(docs, landing.known_circuits(spark)).collect()}
    assert (got["x"].temperature, got["x"].precipitation_prob, got["x"].condition) == (21.5, None, "rain")
    assert (got["y"].temperature, got["y"].condition) == (None, "unknown")


def test_session_search(spark):
    races = spark.createDataFrame([("r1", 2024, "italy", "x"), ("r2", 2024, "", "Imola"), ("r3", 2024, "Mars", "x")],
                                  "race_id string, year long, country string, circuit_name string")
    sessions = spark.createDataFrame(
        [(9, 2024, "Italy", "Monza", "Race"), (7, 2024, "Italy", "GP of Imola", "Race"), (1, 2024, "Italy", "Imola", "Practice 1")],
        "session_key long, year long, country_name string, meeting_name string, session_type string")
    got = {r.race_id: r.session_key for r in landing.find_session(races, sessions).collect()}
    assert got == {"r1": 7, "r2": 7}


def test_upsert_is_repeatable_and_partitioned(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1)], "p long, k string, v long")
    rows.write.partitionBy("p").parquet(path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=2").iterdir()}
    new = spark.createDataFrame([(1, "b", 5), (1, "c", 6)], "p long, k string, v long")
    for _ in range(2):
        merge.upsert(spark, path, new, ["p", "k"], "p")
        got = {(r.p, r.k): r.v for r in spark.read.parquet(path).collect()}
        assert got == {(1, "a"): 1, (1, "b"): 5, (1, "c"): 6, (2, "a"): 1}
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=2").iterdir()}


def test_upsert_of_null_keys_doubled_rows_and_new_partitions(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "p long, k string, v long"
    spark.createDataFrame([(1, None, 1), (1, "a", 1), (2, "a", 1)], kinds).write.partitionBy("p").parquet(path)
    new = spark.createDataFrame([(1, None, 7, 1), (1, "b", 8, 2), (1, "b", 9, 1), (3, "a", 4, 1)], kinds + ", at long")
    merge.upsert(spark, path, new, ["p", "k"], "p", ["at"])
    got = sorted((r.p, r.k or "", r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "", 7), (1, "a", 1), (1, "b", 8), (2, "a", 1), (3, "a", 4)]
    merge.upsert(spark, path, new.limit(0), ["p", "k"], "p", ["at"])
    assert spark.read.parquet(path).count() == 5


def test_upsert_moves_stored_rows_only_where_files_are_many(spark, tmp_path, monkeypatch):
    path, kinds, seen = str(tmp_path / "t"), "p long, k long, v long", []
    spark.range(40).selectExpr("id % 2 AS p", "id AS k", "0L AS v").coalesce(1).write.partitionBy("p").parquet(path)
    replace = merge._replace

    def watched(spark, path, new, partition, combine, leave=()):
        def keep(old, rows, n):
            merged = combine(old, rows, n)
            seen.append(merged._jdf.queryExecution().executedPlan().toString())
            return merged

        replace(spark, path, new, partition, keep, leave)

    monkeypatch.setattr(merge, "_replace", watched)
    for number in range(1, 13):
        merge.upsert(spark, path, spark.createDataFrame([(1, 1, number), (1, 100 + number, number)], kinds), ["p", "k"], "p")
        assert len(list((tmp_path / "t" / "p=1").glob("*.parquet"))) <= merge.FILES + 2
    rows = {r.k: r.v for r in spark.read.parquet(path).filter("p = 1").collect()}
    assert rows == {k: 0 for k in range(3, 40, 2)} | {1: 12} | {100 + n: n for n in range(1, 13)}
    # the only exchange below the stored side is that of new keys
    stored = [plan.split("Union")[1].split("LeftAnti")[0] for plan in seen]
    assert all("Exchange" not in part and "BroadcastHashJoin" in part for part in stored)


def test_known_columns_and_query(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert tables.known_columns(df, ["b", "z"]).columns == ["b"]
    assert tables.query(spark, "SELECT a + :x AS c FROM {t}", {"t": df}, {"x": 4}).first().c == 5


def test_key_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (3, 4)], "k long, v long")
    assert [tuple(r) for r in merge.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert merge.missing_values(df, ["v"]).first().v == 1
    assert merge.orphans(df, df.filter(F.col("k") == 1), "k").first().k == 3


def test_store_ingests_twice_without_copies(spark, tmp_path):
    from paceline.plans.store import Store

    quali = [{"position": "1", "Q1": "1:23.456", "Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}},
             {"position": "2", "Q1": "1:24.000", "Driver": {"driverId": "z"}, "Constructor": {"constructorId": "t"}}]
    paths = {
        "results": write(tmp_path / "r", race(Results=RESULTS), '{"MRData": {"season": "2024"'),
        "qualifying": write(tmp_path / "q", race(QualifyingResults=quali)),
        "standings": write(tmp_path / "s", {"MRData": {"StandingsTable": {"StandingsLists": [
            {"season": "2024", "round": "2", "DriverStandings": [{"points": "7", "position": "1", "Driver": {"driverId": "a"},
             "Constructors": [{"constructorId": "t"}]}], "ConstructorStandings": []}]}}}),
    }
    store = Store(spark, str(tmp_path / "tables"))
    for _ in range(2):
        report = store.ingest(**paths).orderBy("ingested").collect()
        assert sum(r.ingested for r in report) == 3 and sum(r.failed for r in report) == 1
        assert {r.kind for r in report if r.failed} == {"results"}
    assert store.table("results").count() == 2 and store.table("drivers").count() == 2
    store.save("weather", spark.createDataFrame([("2024_3", 20.5, "dry")], "race_id string, temperature double, condition string"))
    assert store.table("weather", 2024, 2024).first().temperature == 20.5
    rows = {r.driver_id: r for r in store.matrix().collect()}
    assert set(rows) == {"a", "b", "z"}
    assert (rows["a"].driver_championship_pts, rows["a"].grid_position, rows["z"].is_podium) == (7.0, 1, 0)
    assert (rows["b"].grid_position, rows["a"].circuit_overtake_difficulty) == (20, 0.35)
    assert {r.duplicates for r in store.quality().collect()} == {0}


def test_first_session_by_start_then_number(spark):
    races = spark.createDataFrame([("r", 2024, "Italy", "Monza")], "race_id string, year long, country string, circuit_name string")
    schema = "session_key long, year long, country_name string, meeting_name string, session_type string, date_start string"
    rows = [(10014, 2024, "Italy", "A", "Race", None), (9998, 2024, "Italy", "B", "Race", None)]
    sessions = spark.createDataFrame(rows, schema).withColumn("date_start", F.to_timestamp("date_start"))
    assert landing.find_session(races, sessions).first().session_key == 9998
    earlier = spark.createDataFrame([(20000, 2024, "Italy", "C", "Race", "2024-05-01")], schema)
    earlier = earlier.withColumn("date_start", F.to_timestamp("date_start"))
    assert landing.find_session(races, sessions.union(earlier)).first().session_key == 20000


def test_several_rows_per_lap(spark):
    """Start and current place are by time, whatever order the rows come in."""
    from paceline.operators.live import interval_state

    rows = [("s", 1, 1, p, str(p), None, i, i) for i, p in enumerate([9, 8, 7, 3])] + [("s", 1, None, 20, "0", None, 9, 9)]
    points = spark.createDataFrame([("s", "last", 5)], "session string, checkpoint string, lap long")
    schema = "session string, driver_number long, lap_number long, position long, gap_to_leader string, interval string, ts long, event_id long"
    for given in (rows, rows[::-1]):
        state = interval_state(spark.createDataFrame(given, schema), points).first()
        assert (state.current_position, state.positions_gained, state.gap_to_leader) == (3, 6, 3.0)


def test_upcoming_race_has_features(spark, tmp_path):
    """A race known from the calendar and qualifying only is in the matrix."""
    from paceline.plans.store import Store

    quali = [{"position": "1", "Q1": "1:23.456", "Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}}]
    upcoming = json.loads(json.dumps(race(QualifyingResults=quali)))
    upcoming["MRData"]["RaceTable"]["Races"][0]["round"] = "9"
    store = Store(spark, str(tmp_path / "tables"))
    store.ingest(
        results=write(tmp_path / "r", race(Results=RESULTS)), qualifying=write(tmp_path / "q", upcoming),
        standings=write(tmp_path / "s", {"MRData": {"StandingsTable": {"StandingsLists": []}}}),
    )
    assert {r.race_id for r in store.matrix().collect()} == {"2024_3", "2024_9"}
    quality = {r.table_name: r for r in store.quality().collect()}
    assert len(quality) == 9 and quality["qualifying"].orphans == 0


def result_document(points, season="2024"):
    entry = {"position": "1", "points": points, "Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}}
    return {"MRData": {"RaceTable": {"Races": [{"season": season, "round": "1", "Results": [entry]}]}}}


def test_only_new_files_are_read(spark, tmp_path):
    root, folder = str(tmp_path / "tables"), tmp_path / "in"
    folder.mkdir()
    store = Store(spark, root)
    assert store.report().collect() == []
    write(folder / "1", result_document("10"), '{"MRData": {"RaceTable": {"Races": [{"season": "2024", bro')
    store.follow(results=f"{folder}/*")
    assert store.table("results").first().points == 10.0
    # a new process on the same store: the old file is not read again
    write(folder / "2", result_document("25"), result_document("7", "2025"))
    later = Store(spark, root)
    report = {r.year: (r.ingested, r.failed) for r in later.follow(results=f"{folder}/*").collect()}
    assert report == {2024: (2, 1), 2025: (1, 0)}
    assert sum(p["numInputRows"] for p in later.progress["results"]) == 2
    assert {r.year: r.points for r in later.table("results").collect()} == {2024: 25.0, 2025: 7.0}
    again = Store(spark, root)
    again.follow(results=f"{folder}/*")
    assert not sum(p["numInputRows"] for p in again.progress["results"]) and again.report().count() == 2
    with pytest.raises(ValueError, match="news"):
        again.follow(news=str(folder))


def test_failed_load_is_run_again(spark, tmp_path, monkeypatch):
    """A load that fails between its tables is taken up by the next call and counted once."""
    root, folder = str(tmp_path / "tables"), tmp_path / "in"
    folder.mkdir()
    write(folder / "1", result_document("10"))
    save = Store.save

    def broken(self, name, rows):
        if name == "results":
            raise RuntimeError("lost")
        save(self, name, rows)

    monkeypatch.setattr(Store, "save", broken)
    with pytest.raises(Exception, match="lost"):
        Store(spark, root).follow(results=f"{folder}/*")
    monkeypatch.setattr(Store, "save", save)
    store = Store(spark, root)
    assert [(r.year, r.ingested, r.failed) for r in store.follow(results=f"{folder}/*").collect()] == [(2024, 1, 0)]
    assert store.table("results").first().points == 10.0 and store.table("drivers").count() == 1


def test_landed_feeds_take_little_room(spark, small, tmp_path, monkeypatch):
    """Lines of a feed are landed compressed, a bounded number to a file, and read back as they were."""
    monkeypatch.setattr(documents_of, "FILE_LINES", 50, raising=False)
    feeds, path = Feeds(spark, small), str(tmp_path / "feed")
    rows = documents_of.live_frame(feeds, "position")
    documents_of.write_live(feeds, "position", rows, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    files = list((tmp_path / "feed").glob("part-*"))
    assert len(lines) == rows.count() + feeds.session_count
    assert all(spark.read.text(str(f)).count() <= 50 for f in files[:5]) and len(files) >= len(lines) / 50
    whole = str(tmp_path / "whole")
    monkeypatch.setattr(documents_of, "FILE_LINES", 1_000_000, raising=False)
    documents_of.write_live(feeds, "position", rows.coalesce(1), whole)
    assert 3 * sum(f.stat().st_size for f in (tmp_path / "whole").glob("part-*")) < sum(map(len, lines))
    names = ["session_key", "driver_number", "position"]
    got = sorted(map(tuple, landing.live_feed(spark, path, "position").select(*names).collect()))
    assert got == sorted(map(tuple, rows.select(*names).collect()))

"""Live features, updates, scenarios and convergence over the timing feeds."""

from pyspark.sql import functions as F

from checks.ctes import LEAGUE, TIMING, with_ctes
from checks.landing import landed_feeds, live_drops, session_number
from checks.registry import check
from paceline.functions.rules import tidy
from paceline.operators import laps as lp
from paceline.operators import live as lv
from paceline.operators import update as up
from paceline.plans import convergence as cv
from paceline.session import fixed, new_path, staged
from paceline.sources.feeds import Feeds
from paceline.sources.league import League
from paceline.streaming.landed import LandedStream

LIVE = TIMING + """,
sessions AS (SELECT session, max(lap_number) AS total_laps FROM timing GROUP BY session),
points AS (
  SELECT session, total_laps, checkpoint, lap FROM (
    SELECT session, total_laps, 'lap_5' AS checkpoint, 5::BIGINT AS lap FROM sessions
    UNION ALL SELECT session, total_laps, 'lap_10', 10 FROM sessions
    UNION ALL SELECT session, total_laps, 'last_1', total_laps - 1 FROM sessions
    UNION ALL SELECT session, total_laps, 'last', total_laps FROM sessions) WHERE lap <= total_laps
),
cut AS (SELECT p.total_laps, p.checkpoint, p.lap, t.* FROM timing t JOIN points p ON p.session = t.session
        AND t.lap_number <= p.lap),
state AS (
  SELECT session, driver_number, checkpoint, lap, total_laps, arg_max(position, lap_number) AS current_position,
         arg_max(gap, lap_number) AS gap_to_leader,
         arg_max(coalesce(interval, 'none'), lap_number) AS ahead_text,
         arg_min(position, lap_number) AS start_position, min(lap_duration) AS best_lap_time,
         count(*) FILTER (event_type = 'purchase') AS pit_stops_made,
         max(lap_number) FILTER (event_type = 'purchase') AS last_pit,
         arg_max(k, lap_number) FILTER (event_type = 'purchase') AS pit_k
  FROM cut GROUP BY session, driver_number, checkpoint, lap, total_laps
),
last5 AS (
  SELECT session, driver_number, checkpoint, lap_duration,
         row_number() OVER (PARTITION BY session, driver_number, checkpoint ORDER BY lap_number) - 1 AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY session, driver_number, checkpoint ORDER BY lap_number DESC) AS r FROM cut)
  WHERE r <= 5 AND lap_duration IS NOT NULL
),
pace AS (
  SELECT session, driver_number, checkpoint, avg(lap_duration) AS avg_lap_time_last5,
         CASE WHEN count(*) >= 3 THEN regr_slope(lap_duration, i) ELSE 0 END AS lap_time_trend
  FROM last5 GROUP BY ALL
),
messages AS (
  SELECT session, lap_number, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS flag,
         row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS seq
  FROM timing WHERE event_type IN ('signup', 'error')
),
stops AS (
  SELECT p.session, p.checkpoint, p.lap, min(m.seq) FILTER (m.lap_number > p.lap) AS stop
  FROM points p JOIN messages m ON m.session = p.session GROUP BY ALL
),
regime AS (
  SELECT s.session, s.checkpoint, coalesce(arg_max(m.flag, m.seq) FILTER (s.stop IS NULL OR m.seq < s.stop), 0) AS active,
         count(*) FILTER (m.lap_number <= s.lap) AS n
  FROM stops s JOIN messages m ON m.session = s.session GROUP BY ALL
),
live AS (
  SELECT s.session, s.driver_number, s.checkpoint, s.lap, s.total_laps, current_position, gap_to_leader,
         TRY_CAST(ahead_text AS DOUBLE) AS gap_to_driver_ahead, start_position - current_position AS positions_gained,
         avg_lap_time_last5, coalesce(lap_time_trend, 0.0) AS lap_time_trend, best_lap_time, pit_stops_made,
         coalesce(abs(s.lap - last_pit) <= 1, false)::INT::BIGINT AS is_pit_phase,
         coalesce(pit_k % 4 + s.lap - last_pit, 0) AS compound_age,
         coalesce([0, 1, 2, 3, 4, 1][pit_k % 6 + 1], 1)::BIGINT AS current_compound,
         s.total_laps - s.lap AS laps_remaining, s.lap / s.total_laps AS race_progress,
         CASE WHEN s.total_laps - s.lap > 30 AND coalesce(pit_k % 4 + s.lap - last_pit, 0) > 15 THEN 1
              WHEN s.total_laps - s.lap > 50 THEN 2 ELSE 0 END::BIGINT AS estimated_stops_remaining,
         coalesce(r.active, 0)::BIGINT AS safety_car_active, coalesce(r.n, 0) AS safety_car_count
  FROM state s LEFT JOIN pace p ON p.session = s.session AND p.driver_number = s.driver_number
    AND p.checkpoint = s.checkpoint
  LEFT JOIN regime r ON r.session = s.session AND r.checkpoint = s.checkpoint
),
primed AS (
  SELECT *, CASE WHEN driver_number % 2 = 0 THEN (1 + driver_number % 9) / 10.0 ELSE 0.05 END::DOUBLE AS prior FROM live
)"""

WEAR = "CASE current_compound WHEN 0 THEN 0.015 WHEN 2 THEN 0.005 ELSE 0.01 END"


def likelihood(alpha="NULL", multiplier="1.0"):
    """Softened likelihood in SQL, with optional overrides."""
    return f"""(1 + (exp(-coalesce({alpha}, CASE WHEN is_pit_phase = 1 THEN 0 WHEN safety_car_active = 1 THEN 0.005
        ELSE 0.02 END) * gap_to_leader - {multiplier} * CASE WHEN is_pit_phase = 1 THEN 0
        WHEN safety_car_active = 1 THEN 2 * ({WEAR}) ELSE {WEAR} END * compound_age)
      * CASE WHEN current_position <= 3 AND safety_car_active = 0 AND is_pit_phase = 0 THEN 1.2 ELSE 1 END - 1)
      * least(1.0, race_progress * 3))"""


UPDATED = LIVE + f""",
raw_update AS (SELECT *, prior * {likelihood()} AS posterior FROM primed),
updated AS (
  SELECT *, least(posterior * least(3, count(*) OVER g) / sum(posterior) OVER g, 0.99) AS prob
  FROM raw_update WINDOW g AS (PARTITION BY session, checkpoint)
)"""

V, U = with_ctes(LIVE), with_ctes(UPDATED)
RACE = ["session", "checkpoint"]
CHECKPOINTS = ["lap_0", "lap_5", "lap_10", "last_1"]


def live_rows(feeds):
    """Live features of all sessions at laps 5, 10, N - 1 and N, staged."""

    def build():
        points = lv.checkpoints(feeds.sessions, [5, 10], [1, 0])
        return lv.feed_features(feeds, points, 4)

    return staged(feeds.spark, ("live", feeds.sf_dir), build)


def updated_rows(feeds, name="last"):
    rows = live_rows(feeds)
    rows = rows if name is None else rows.filter(F.col("checkpoint") == name)
    return up.bayesian_update(up.with_prior(rows, feeds.priors, ["driver_number"]), RACE, 4 * feeds.session_count)


def plain(df, *rounded):
    """Session as text and doubles rounded, for comparison."""
    df = df.withColumn("session", F.col("session").cast("string"))
    return df.withColumns({c: tidy(F.col(c)) for c in rounded})


DOUBLES = ["gap_to_leader", "gap_to_driver_ahead", "avg_lap_time_last5", "lap_time_trend", "best_lap_time", "race_progress"]


@check(
    V + f"""SELECT session::VARCHAR AS session, * EXCLUDE (session, {', '.join(DOUBLES)}),
      {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in DOUBLES)} FROM live"""
)
def live_features(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    points = lv.checkpoints(feeds.sessions, [5, 10], [1, 0])
    return plain(lv.feed_features(feeds, points, 4), *DOUBLES)


@check(V + "SELECT session::VARCHAR AS session, checkpoint, active::BIGINT AS safety_car_active, n AS safety_car_count FROM regime")
def safety_car_regime(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    points = lv.checkpoints(feeds.sessions, [5, 10], [1, 0])
    return plain(lv.safety_car_state(feeds.race_control, points, 4 * feeds.session_count))


@check(
    U + """SELECT session::VARCHAR AS session, driver_number, checkpoint, round(prior, 6) AS prior,
      round(posterior, 6) AS posterior, round(prob, 6) AS prob FROM updated"""
)
def bayesian_update(spark, sf_dir):
    rows = updated_rows(Feeds(spark, sf_dir), None)
    return plain(rows.select("session", "driver_number", "checkpoint", "prior", "posterior", "prob"), "prior", "posterior", "prob")


@check(
    V + """, mixed AS (SELECT *, 1 / (1 + exp(-(lap - total_laps / 2) / 10)) AS weight,
      CASE WHEN current_position <= 1 THEN 0.85 WHEN current_position <= 2 THEN 0.75 WHEN current_position <= 3 THEN 0.65
           WHEN current_position <= 5 THEN 0.30 WHEN current_position <= 8 THEN 0.10 WHEN current_position <= 12 THEN 0.03
           ELSE 0.01 END AS estimate FROM primed)
    SELECT session::VARCHAR AS session, driver_number, checkpoint, round(weight, 6) AS live_weight,
      round(greatest(0.01, least(0.99, (1 - weight) * prior + weight * estimate)), 6) AS prob FROM mixed"""
)
def blended_update(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    rows = up.blended_update(up.with_prior(live_rows(feeds), feeds.priors, ["driver_number"]))
    return plain(rows.select("session", "driver_number", "checkpoint", "live_weight", "prob"), "live_weight", "prob")


@check(
    with_ctes(LEAGUE, TIMING)
    + """SELECT DISTINCT t.session::VARCHAR AS session, t.driver_number, d.driver_id
      FROM timing t JOIN drivers d ON d.code = 'S' || t.driver_number::VARCHAR WHERE t.driver_number % 10 <> 0"""
)
def car_driver_mapping(spark, sf_dir):
    return plain(lv.map_cars(Feeds(spark, sf_dir).cars, League(spark, sf_dir).drivers))


ENTRY_LIST = """
entry_list AS (
  SELECT DISTINCT session, driver_number AS driver_id, (1 + driver_number % 9) / 10.0 AS prior FROM (
    SELECT session, driver_number FROM timing
    UNION ALL SELECT session + 7, driver_number FROM timing WHERE session + 7 IN (SELECT session FROM timing))
  WHERE driver_number % 2 = 0 AND driver_number IN (SELECT driver_id FROM drivers)
)"""


def entry_list(feeds, league):
    """Prior per session and driver: entrants of this session or the one before, where a prior exists."""
    cars = feeds.cars.select("session", "driver_number")
    sessions = cars.select("session").distinct()
    carried = cars.withColumn("session", F.date_add("session", 7)).join(sessions, "session", "left_semi")
    listed = cars.union(carried).distinct().filter("driver_number % 2 = 0")
    known = listed.withColumnRenamed("driver_number", "driver_id").join(league.drivers.select("driver_id"), "driver_id")
    return known.withColumn("prior", (1 + F.col("driver_id") % 9) / F.lit(10.0))


PODIUM_SQL = f"""{{ctes}}, mapped AS (SELECT l.*, d.driver_id, coalesce(e.prior, 0.05)::DOUBLE AS prior
      FROM live l JOIN drivers d ON d.code = 'S' || l.driver_number::VARCHAR AND l.driver_number % 10 <> 0
      LEFT JOIN entry_list e ON e.session = l.session AND e.driver_id = d.driver_id WHERE checkpoint = 'last'),
    post AS (SELECT *, prior * {likelihood()} AS posterior FROM mapped),
    upd AS (SELECT session, driver_id, least(posterior * least(3, count(*) OVER g) / sum(posterior) OVER g, 0.99) AS prob
            FROM post WINDOW g AS (PARTITION BY session)),
    filled AS (SELECT coalesce(u.session, e.session) AS session, coalesce(u.driver_id, e.driver_id) AS driver_id,
            coalesce(u.prob, e.prior) AS prob FROM upd u FULL JOIN entry_list e
            ON e.session = u.session AND e.driver_id = u.driver_id),
    ranked AS (SELECT *, prob / (sum(prob) OVER (PARTITION BY session) + 1e-9) AS score,
            row_number() OVER (PARTITION BY session ORDER BY prob DESC, driver_id) AS place FROM filled)
    SELECT {{session}} AS session, driver_id, place AS predicted_position, round(prob, 6) AS probability,
      round(max(CASE WHEN place = 3 THEN score END) OVER (PARTITION BY session)
        - max(CASE WHEN place = 4 THEN score END) OVER (PARTITION BY session), 6) + 0.0 AS confidence
    FROM ranked QUALIFY place <= 3"""


@check(PODIUM_SQL.format(ctes=with_ctes(LEAGUE, LIVE, ENTRY_LIST), session="session::VARCHAR"))
def live_podium(spark, sf_dir):
    feeds, league = Feeds(spark, sf_dir), League(spark, sf_dir)
    live = lv.feed_features(feeds, lv.latest_checkpoint(feeds.sessions), 1)
    answer = up.live_podium(live, lv.map_cars(feeds.cars, league.drivers), entry_list(feeds, league), ["session"], feeds.session_count)
    return plain(answer.drop("confidence_level"), "probability", "confidence")


LANDED = LIVE.replace(
    "state AS (",
    """laps_begun AS (SELECT session, driver_number, ts, max(lap_number) AS lap FROM timing GROUP BY ALL),
places AS (
  SELECT p.*, l.lap FROM (
    SELECT session, driver_number, ts  AS tm, position FROM timing
    UNION ALL SELECT session, driver_number, ts + INTERVAL 1 SECOND, position + k % 3 FROM timing WHERE k IS NOT NULL) p
  ASOF JOIN laps_begun l ON l.session = p.session AND l.driver_number = p.driver_number AND p.tm >= l.ts
),
gaps AS (
  SELECT g.*, l.lap FROM (
    SELECT session, driver_number, ts  AS tm, gap_text, interval FROM timing
    UNION ALL SELECT session, driver_number, ts + INTERVAL 2 SECOND, (k % 5)::VARCHAR, interval FROM timing) g
  ASOF JOIN laps_begun l ON l.session = g.session AND l.driver_number = g.driver_number AND g.tm >= l.ts
),
place_state AS (
  SELECT a.session, driver_number, checkpoint, last(a.position ORDER BY tm, a.position) AS now_place,
         first(a.position ORDER BY tm, a.position) AS start_place
  FROM places a JOIN points p ON p.session = a.session AND a.lap <= p.lap GROUP BY ALL
),
gap_state AS (
  SELECT a.session, driver_number, checkpoint, last(gap_text ORDER BY tm, gap_text NULLS FIRST, interval NULLS FIRST) AS gap_text,
         last(interval ORDER BY tm, gap_text NULLS FIRST, interval NULLS FIRST) AS interval
  FROM gaps a JOIN points p ON p.session = a.session AND a.lap <= p.lap GROUP BY ALL
),
state AS (SELECT s.* REPLACE (now_place AS current_position, TRY_CAST(gap_text AS DOUBLE) AS gap_to_leader,
         coalesce(g.interval, 'none') AS ahead_text, start_place AS start_position)
  FROM lap_rows s JOIN place_state p USING (session, driver_number, checkpoint)
  JOIN gap_state g USING (session, driver_number, checkpoint)),
lap_rows AS (""",
)
# the rows by lap come first, then the states that replace their places and gaps
_state = LANDED[LANDED.index("state AS (SELECT s.* REPLACE") : LANDED.index("lap_rows AS (")]
LANDED = LANDED.replace(_state, "").replace("last5 AS (", _state + "last5 AS (", 1)
D = with_ctes(LANDED)
DAY = "strftime(session, '%Y%m%d')"


@check(
    D + f"""SELECT {DAY} AS session, * EXCLUDE (session, {', '.join(DOUBLES)}),
      {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in DOUBLES)} FROM live"""
)
def landed_live_features(spark, sf_dir):
    """Live features from landed feeds with several place and gap rows per lap."""
    feeds = landed_feeds(Feeds(spark, sf_dir))
    points = lv.checkpoints(feeds.sessions, [5, 10], [1, 0])
    return plain(lv.feed_features(feeds, points, 4), *DOUBLES)


@check(PODIUM_SQL.format(ctes=with_ctes(LEAGUE, LANDED, ENTRY_LIST), session=DAY))
def landed_live_podium(spark, sf_dir):
    """From landed documents to the live answer."""
    synthetic, league = Feeds(spark, sf_dir), League(spark, sf_dir)
    feeds = landed_feeds(synthetic)
    priors = entry_list(synthetic, league).withColumn("session", session_number(F.col("session")))
    live = lv.feed_features(feeds, lv.latest_checkpoint(feeds.sessions), 1)
    answer = up.live_podium(live, lv.map_cars(feeds.cars, league.drivers), priors, ["session"], feeds.session_count)
    return plain(answer.drop("confidence_level"), "probability", "confidence")


def at_every_lap(ctes):
    """The same CTEs with all laps of a session as its checkpoints."""
    start, end = ctes.index("points AS ("), ctes.index("cut AS (")
    points = """points AS (SELECT session, total_laps, 'lap_' || lap AS checkpoint, lap FROM (
      SELECT session, total_laps, unnest(generate_series(1, total_laps)) AS lap FROM sessions)),
"""
    return ctes[:start] + points + ctes[end:]


LAP_DOUBLES = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in DOUBLES)


@check(
    with_ctes(at_every_lap(LIVE)) + f"""SELECT session::VARCHAR AS session, * EXCLUDE (session, checkpoint, {', '.join(DOUBLES)}),
      {LAP_DOUBLES} FROM live"""
)
def live_every_lap(spark, sf_dir):
    """Live features at every lap of every session, in one pass over the feeds."""
    return plain(lp.feed_features_by_lap(Feeds(spark, sf_dir)), *DOUBLES)


@check(
    with_ctes(at_every_lap(LANDED)) + f"""SELECT {DAY} AS session, * EXCLUDE (session, checkpoint, {', '.join(DOUBLES)}),
      {LAP_DOUBLES} FROM live"""
)
def landed_every_lap(spark, sf_dir):
    return plain(lp.feed_features_by_lap(landed_feeds(Feeds(spark, sf_dir))), *DOUBLES)


def landed_stream(feeds, after):
    """The feeds landed in drops and followed by a new reader after each; ``after`` is called with it every time."""
    paths, land = live_drops(feeds)
    root = new_path(feeds.spark, "followed")
    out = None
    while land():
        follower = LandedStream(feeds.spark, paths, root, longest="1 hour", delay="2 days")
        out = after(follower)
    return follower, out


@check(PODIUM_SQL.format(ctes=with_ctes(LEAGUE, LANDED, ENTRY_LIST), session=DAY))
def stream_landed_podium(spark, sf_dir):
    """The live answer from feeds landed in drops, with late and repeated lines, by streams that start anew each time."""
    synthetic, league = Feeds(spark, sf_dir), League(spark, sf_dir)
    priors = entry_list(synthetic, league).withColumn("session", session_number(F.col("session")))
    _, answers = landed_stream(synthetic, lambda follower: follower.answer(league.drivers, priors))
    return plain(answers.drop("confidence_level"), "probability", "confidence")


@check(
    with_ctes(at_every_lap(LANDED)) + f"""SELECT {DAY} AS session, * EXCLUDE (session, checkpoint, {', '.join(DOUBLES)}),
      {LAP_DOUBLES} FROM live"""
)
def stream_landed_laps(spark, sf_dir):
    """Features at every lap from the streamed feeds: each reading was put on its lap by a join of streams."""
    follower, _ = landed_stream(Feeds(spark, sf_dir), lambda f: f.poll())
    return plain(follower.features(every=True), *DOUBLES)


SCENARIOS = f""",
sweep AS (
  SELECT 'baseline' AS scenario, session, driver_number, prior * {likelihood()} AS v, true AS active
    FROM primed WHERE checkpoint = 'last'
  UNION ALL SELECT 'gaps_count_more', session, driver_number, prior * {likelihood('0.05')}, true
    FROM primed WHERE checkpoint = 'last'
  UNION ALL SELECT 'double_wear', session, driver_number, prior * {likelihood('NULL', '2.0')}, true
    FROM primed WHERE checkpoint = 'last'
  UNION ALL SELECT 'safety_car', session, driver_number, prior * {likelihood()}, true
    FROM (SELECT * REPLACE (1 AS safety_car_active) FROM primed WHERE checkpoint = 'last')
  UNION ALL SELECT 'leader_pits', session, driver_number, prior * {likelihood()}, true
    FROM (SELECT * REPLACE (CASE WHEN current_position = 1 THEN gap_to_leader + 20 ELSE gap_to_leader END AS gap_to_leader,
      CASE WHEN current_position = 1 THEN 0 ELSE compound_age END AS compound_age) FROM primed WHERE checkpoint = 'last')
  UNION ALL SELECT 'leader_retires', session, driver_number,
    CASE WHEN current_position = 1 THEN 0 ELSE prior * {likelihood()} END, current_position <> 1
    FROM primed WHERE checkpoint = 'last'
),
swept AS (
  SELECT scenario, session, driver_number,
         least(v * least(3, count(*) FILTER (active) OVER g) / sum(v) OVER g, 0.99) AS prob
  FROM sweep WINDOW g AS (PARTITION BY scenario, session)
),
deltas AS (
  SELECT s.session, s.scenario, s.driver_number, b.prob AS baseline_prob, s.prob AS scenario_prob, s.prob - b.prob AS delta_prob
  FROM swept s JOIN swept b ON b.session = s.session AND b.driver_number = s.driver_number AND b.scenario = 'baseline'
  WHERE s.scenario <> 'baseline'
)"""


def scenario_rows(feeds):
    rows = live_rows(feeds).filter("checkpoint = 'last'")
    rows = up.apply_scenarios(up.with_prior(rows, feeds.priors, ["driver_number"]))
    return up.scenario_deltas(up.bayesian_update(rows, ["session", "scenario"], len(up.SCENARIOS) * feeds.session_count), ["session"])


@check(
    V + SCENARIOS + """SELECT session::VARCHAR AS session, scenario, driver_number, round(baseline_prob, 6) AS baseline_prob,
      round(scenario_prob, 6) AS scenario_prob, round(delta_prob, 6) + 0.0 AS delta_prob FROM deltas"""
)
def scenario_sweep(spark, sf_dir):
    return plain(scenario_rows(Feeds(spark, sf_dir)), "baseline_prob", "scenario_prob", "delta_prob")


@check(
    V + SCENARIOS + """SELECT session::VARCHAR AS session, scenario,
      arg_max(driver_number, (round(delta_prob, 9), -driver_number)) AS most_helped, round(max(delta_prob), 6) + 0.0 AS best_delta,
      arg_min(driver_number, (round(delta_prob, 9), driver_number)) AS most_hurt, round(min(delta_prob), 6) + 0.0 AS worst_delta
    FROM deltas GROUP BY session, scenario"""
)
def scenario_effects(spark, sf_dir):
    return plain(up.scenario_effects(scenario_rows(Feeds(spark, sf_dir)), ["session"]), "best_delta", "worst_delta")


PROJECTION = f""",
aged AS (
  SELECT *, ({WEAR})::DOUBLE AS wear, total_laps - lap AS n, greatest(1, 30 - compound_age + 1) AS m FROM updated
),
latent AS (
  SELECT *, CASE WHEN n < m THEN compound_age + n ELSE (n - m) % 31 END AS final_age,
    prob / (1 + (exp(-CASE WHEN safety_car_active = 1 THEN 0.005 ELSE 0.02 END * gap_to_leader
      - wear * CASE WHEN safety_car_active = 1 THEN 2 ELSE 1 END * compound_age) - 1) * least(1.0, race_progress * 3)) AS base
  FROM aged
),
flag AS (
  SELECT *, CASE WHEN n = 0 THEN prob WHEN n >= m AND final_age = 0 THEN base
            ELSE base * exp(-0.02 * gap_to_leader - wear * final_age) END AS v FROM latent
),
projected AS (
  SELECT session, checkpoint, driver_number, prob,
    CASE WHEN n = 0 THEN prob ELSE least(v * least(3, count(*) OVER g) / sum(v) OVER g, 0.99) END AS projected
  FROM flag WINDOW g AS (PARTITION BY session, checkpoint)
)"""


@check(
    U + PROJECTION + """SELECT session::VARCHAR AS session, checkpoint, driver_number, round(prob, 6) AS prob,
      round(projected, 6) AS projected, round(projected - prob, 6) + 0.0 AS drift FROM projected"""
)
def projection_to_flag(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    rows = up.project_to_flag(updated_rows(feeds, None), RACE, 4 * feeds.session_count)
    return plain(rows.select(*RACE, "driver_number", "prob", "projected", "drift"), "prob", "projected", "drift")


@check(
    U + PROJECTION + """SELECT session::VARCHAR AS session, checkpoint,
      round(arg_max(projected - prob, (round(abs(projected - prob), 9), -driver_number)), 6) + 0.0 AS max_drift,
      (max(abs(projected - prob)) < 0.1)::INT::BIGINT AS within_tolerance FROM projected GROUP BY session, checkpoint"""
)
def drift_verdict(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    rows = up.project_to_flag(updated_rows(feeds, None), RACE, 4 * feeds.session_count)
    return plain(up.drift_verdict(rows, RACE), "max_drift")


CONVERGENCE = """,
finishers AS (
  SELECT session, driver_number, row_number() OVER (PARTITION BY session ORDER BY max(lap_number) DESC,
    arg_max(total, lap_number), driver_number) AS place FROM timing GROUP BY session, driver_number
),
checked AS (
  SELECT session, driver_number, checkpoint, prob FROM updated WHERE checkpoint <> 'last'
  UNION ALL SELECT session, driver_number, 'lap_0', prior FROM primed WHERE checkpoint = 'last'
),
briers AS (
  SELECT c.session, c.checkpoint, avg((c.prob - CASE WHEN f.place <= 3 THEN 1 ELSE 0 END) ** 2) AS brier
  FROM checked c JOIN finishers f ON f.session = c.session AND f.driver_number = c.driver_number GROUP BY ALL
),
convergence AS (
  SELECT session, max(brier) FILTER (checkpoint = 'lap_0') AS lap_0, max(brier) FILTER (checkpoint = 'lap_5') AS lap_5,
         max(brier) FILTER (checkpoint = 'lap_10') AS lap_10, max(brier) FILTER (checkpoint = 'last_1') AS last_1
  FROM briers GROUP BY session
)"""


def convergence_of(feeds):
    rows = updated_rows(feeds, None)
    prior = rows.filter("checkpoint = 'last'").select(
        "session", "driver_number", F.lit("lap_0").alias("checkpoint"), F.col("prior").alias("prob")
    )
    probs = rows.filter("checkpoint <> 'last'").select("session", "driver_number", "checkpoint", "prob").unionByName(prior)
    return cv.convergence_table(cv.checkpoint_briers(probs, cv.final_podium(feeds.timing)), CHECKPOINTS)


@check(
    U + CONVERGENCE + """SELECT session::VARCHAR AS session, round(lap_0, 6) AS lap_0, round(lap_5, 6) AS lap_5,
      round(lap_10, 6) AS lap_10, round(last_1, 6) AS last_1 FROM convergence"""
)
def lap_convergence(spark, sf_dir):
    return plain(convergence_of(Feeds(spark, sf_dir)), *CHECKPOINTS)


@check(
    U + CONVERGENCE + """SELECT year(session) AS year, round(avg(lap_0), 6) AS lap_0, round(avg(lap_5), 6) AS lap_5,
      round(avg(lap_10), 6) AS lap_10, round(avg(last_1), 6) AS last_1,
      (avg(last_1) < avg(lap_0) AND avg(lap_10) < avg(lap_5))::INT::BIGINT AS converges FROM convergence GROUP BY 1"""
)
def convergence_verdict(spark, sf_dir):
    out = cv.convergence_verdict(convergence_of(Feeds(spark, sf_dir)), CHECKPOINTS)
    return out.withColumns({c: tidy(F.col(c)) for c in CHECKPOINTS})


@check(
    with_ctes(at_every_lap(UPDATED)) + """, """ + CONVERGENCE[CONVERGENCE.index("finishers AS") : CONVERGENCE.index("checked AS")] + """
    per_lap AS (
      SELECT u.session, u.lap, avg((u.prob - coalesce(f.place <= 3, FALSE)::INT) ** 2) AS brier, count(*) AS cars
      FROM updated u LEFT JOIN finishers f ON f.session = u.session AND f.driver_number = u.driver_number GROUP BY ALL)
    SELECT session::VARCHAR AS session, lap, cars, round(brier, 6) AS brier FROM per_lap"""
)
def brier_every_lap(spark, sf_dir):
    """How far the live probabilities are from the outcome at every lap."""
    feeds = Feeds(spark, sf_dir)
    live = up.with_prior(lp.feed_features_by_lap(feeds), feeds.priors, ["driver_number"])
    updated = up.bayesian_update(fixed(live), ["session", "lap"])
    return plain(cv.lap_briers(updated, cv.final_podium(feeds.timing)), "brier")

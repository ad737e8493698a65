"""SQL building blocks shared by the checks: the league and the timing feeds, from the raw tables."""

LEAGUE = """
entry AS (
  SELECT year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS round,
         (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS ro,
         year(o_orderdate)::VARCHAR || '_' || month(o_orderdate)::VARCHAR AS race_id,
         l_suppkey AS driver_id, any_value(n_regionkey)::BIGINT AS constructor_id,
         sum(l_extendedprice::DECIMAL(18,2)) AS rev, sum(l_quantity::DECIMAL(18,2)) AS qty,
         count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS nr, count(*) FILTER (l_linestatus = 'F') AS nf,
         round(CAST(min(l_extendedprice / l_quantity) FILTER (l_linenumber IN (1, 2)) AS DECIMAL(18,9)), 3)::DOUBLE AS q1_sec,
         round(CAST(min(l_extendedprice / l_quantity) FILTER (l_linenumber IN (3, 4)) AS DECIMAL(18,9)), 3)::DOUBLE AS q2_sec,
         round(CAST(min(l_extendedprice / l_quantity) FILTER (l_linenumber IN (5, 6, 7)) AS DECIMAL(18,9)), 3)::DOUBLE AS q3_sec
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL
),
races AS (
  SELECT DISTINCT race_id, ro, year, round, 'c' || (round % 5)::VARCHAR AS circuit_id,
         'Circuit ' || (round % 5)::VARCHAR AS circuit_name, 'Country ' || (round % 5)::VARCHAR AS country,
         make_date(year, round, 1) AS race_date
  FROM entry
),
started AS (
  SELECT *, CASE WHEN 2 * nr > n THEN 'Retired' WHEN 2 * nf > n THEN '+1 Lap' ELSE 'Finished' END AS status,
         NOT (2 * nr > n AND driver_id % 2 = 0) AS classified
  FROM entry WHERE n > 1
),
results AS (
  SELECT *, coalesce([25, 18, 15, 12, 10, 8, 6, 4, 2, 1][position], 0)::DOUBLE AS points,
         CASE WHEN position <= 3 THEN 1 ELSE 0 END::BIGINT AS is_podium
  FROM (
    SELECT race_id, ro, year, round, driver_id, constructor_id, status, n AS laps_completed,
           CASE WHEN classified THEN row_number() OVER (
             PARTITION BY ro, classified ORDER BY rev DESC, driver_id) END AS position,
           row_number() OVER (PARTITION BY ro ORDER BY qty DESC, driver_id) AS grid
    FROM started)
),
qualifying AS (
  SELECT race_id, ro, driver_id, constructor_id, q1_sec, q2_sec, q3_sec,
         row_number() OVER (PARTITION BY ro ORDER BY coalesce(q3_sec, q2_sec, q1_sec) NULLS LAST, driver_id) AS position
  FROM entry WHERE n <> 2
),
drivers AS (
  SELECT s_suppkey AS driver_id, 'S' || s_suppkey::VARCHAR AS code, s_name AS full_name, n_name AS nationality,
         'c' || (n_nationkey % 5)::VARCHAR AS home_circuit_id, n_regionkey::BIGINT AS constructor_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
constructors AS (SELECT r_regionkey::BIGINT AS constructor_id, r_name AS name FROM region),
circuits AS (
  SELECT * FROM (VALUES ('c0', 'street', 0.8::DOUBLE), ('c1', 'technical', 0.3), ('c2', 'high_speed', 0.35),
                        ('c3', 'technical', 0.45)) AS t(circuit_id, type, overtake_difficulty)
)
"""

STANDINGS = """
driver_points AS (
  SELECT r.race_id, r.ro, r.year, r.round, e.driver_id, max(e.constructor_id) AS constructor_id, sum(e.points) AS points
  FROM races r JOIN results e ON e.year = r.year AND e.round < r.round GROUP BY ALL
),
team_points AS (
  SELECT r.ro, e.constructor_id, sum(e.points) AS points
  FROM races r JOIN results e ON e.year = r.year AND e.round < r.round GROUP BY ALL
),
standings AS (
  SELECT d.race_id, d.ro, d.year, d.round, d.driver_id, d.points, d.position, d.constructor_id,
         t.points AS constructor_pts, t.position AS constructor_pos
  FROM (SELECT *, row_number() OVER (PARTITION BY ro ORDER BY points DESC, driver_id) AS position FROM driver_points) d
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ro ORDER BY points DESC, constructor_id) AS position
             FROM team_points) t ON t.ro = d.ro AND t.constructor_id = d.constructor_id
)
"""

ROSTER = """
roster AS (
  SELECT r.race_id, r.ro, r.driver_id, r.constructor_id, r.is_podium, r.position AS finish_position, r.status,
         x.year, x.round, x.circuit_id
  FROM results r JOIN races x ON r.ro = x.ro
  UNION ALL
  SELECT q.race_id, q.ro, q.driver_id, q.constructor_id, 0::BIGINT, NULL, 'Unknown', x.year, x.round, x.circuit_id
  FROM qualifying q JOIN races x ON q.ro = x.ro
  WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.ro = q.ro AND r.driver_id = q.driver_id)
)
"""

TIMING = """
laps AS (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS session, user_id AS driver_number, event_id, ts, event_type,
         CASE WHEN event_type <> 'error' THEN value END AS lap_duration,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         row_number() OVER w AS lap_number, sum(value::DECIMAL(18,2)) OVER w AS total
  FROM events WINDOW w AS (PARTITION BY date_trunc('week', ts), user_id ORDER BY ts, event_id)
),
timing AS (
  SELECT *, CASE WHEN k % 17 = 0 THEN '+1 LAP' ELSE (total - min(total) OVER g)::DECIMAL(18,2)::VARCHAR END AS gap_text,
         CASE WHEN k % 17 = 0 THEN 90.0 ELSE (total - min(total) OVER g)::DOUBLE END AS gap,
         row_number() OVER p AS position, (total - lag(total) OVER p)::DECIMAL(18,2)::VARCHAR AS interval
  FROM laps
  WINDOW g AS (PARTITION BY session, lap_number), p AS (PARTITION BY session, lap_number ORDER BY total, driver_number)
)
"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


L = with_ctes(LEAGUE)
LS = with_ctes(LEAGUE, STANDINGS)
LR = with_ctes(LEAGUE, ROSTER)
T = with_ctes(TIMING)

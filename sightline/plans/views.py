"""Fixture views as DuckDB SQL, written independently of the Spark builders."""

from __future__ import annotations

from sightline.plans.registry import view
from sightline.sources.fixtures import AREA_RING, FERRY_LINES

view("sightings", """
    SELECT id, mark_level, age_class, gender, sdate, observed,
           CAST(count(*) OVER (PARTITION BY id) AS BIGINT) AS tot
    FROM (SELECT DISTINCT o_custkey AS id,
                 CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY','FURNITURE') THEN 'WM'
                      WHEN c_mktsegment = 'AUTOMOBILE' THEN 'FM' ELSE 'UM' END AS mark_level,
                 CASE c_nationkey % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'juvenile' ELSE 'calf' END AS age_class,
                 CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'U' END AS gender,
                 CAST(o_orderdate AS DATE) AS sdate, 1 AS observed
          FROM orders JOIN customer ON o_custkey = c_custkey) s""")

view("id_group", """
    SELECT id, min(CASE age_class WHEN 'adult' THEN 1 WHEN 'juvenile' THEN 2 ELSE 3 END) AS grp
    FROM sightings GROUP BY id""", "sightings")

view("captures", """
    SELECT DISTINCT id, CAST((year(sdate) - 1995) * 4 + quarter(sdate) AS INT) AS t FROM sightings""", "sightings")

view("captures_wm", """
    SELECT DISTINCT s.id, g.grp, CAST((year(sdate) - 1995) * 4 + quarter(sdate) AS INT) AS t
    FROM sightings s JOIN id_group g ON s.id = g.id WHERE mark_level = 'WM'""", "sightings id_group")

view("captures_wm_month", """
    SELECT DISTINCT s.id, g.grp, CAST((year(sdate) - 1995) * 12 + month(sdate) AS INT) AS t
    FROM sightings s JOIN id_group g ON s.id = g.id WHERE mark_level = 'WM'""", "sightings id_group")

view("effort_days", """
    SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           count(DISTINCT CAST(o_orderdate AS DATE)) AS n
    FROM orders GROUP BY 1, 2""")

view("occs", """
    SELECT sdate, CAST(row_number() OVER (ORDER BY sdate) AS INT) AS occ,
           CAST(sdate - min(sdate) OVER () AS INT) AS time
    FROM (SELECT DISTINCT sdate FROM sightings) d""", "sightings")

view("features", """
    SELECT s.id,
           CAST(max(o.time) - min(o.time) AS DOUBLE) / any_value(c.max_time) AS span_time_rel,
           CASE WHEN max(o.time) > min(o.time)
                THEN CAST(count(*) - 1 AS DOUBLE) / (max(o.time) - min(o.time)) ELSE 0.0 END AS periodicity,
           CASE WHEN any_value(c.n_occ) > min(o.occ)
                THEN CAST(count(*) - 1 AS DOUBLE) / (any_value(c.n_occ) - min(o.occ)) ELSE 0.0 END AS resight,
           CAST(count(*) AS DOUBLE) / any_value(c.n_occ) AS sights,
           CAST(count(DISTINCT date_trunc('month', s.sdate)) AS DOUBLE) / any_value(c.n_months) AS m_rate,
           CAST(count(DISTINCT year(s.sdate)) AS DOUBLE) / any_value(c.n_years) AS y_rate
    FROM sightings s JOIN occs o ON s.sdate = o.sdate
         CROSS JOIN (SELECT count(*) AS n_occ, max(time) AS max_time,
                            count(DISTINCT date_trunc('month', sdate)) AS n_months,
                            count(DISTINCT year(sdate)) AS n_years FROM occs) c
    GROUP BY s.id""", "sightings occs")

view("dense_months", """
    SELECT i.id, m.month, CAST(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS INT) AS observed
    FROM (SELECT DISTINCT id FROM sightings) i
         CROSS JOIN (SELECT DISTINCT CAST(date_trunc('month', sdate) AS DATE) AS month FROM sightings) m
         LEFT JOIN (SELECT DISTINCT id, CAST(date_trunc('month', sdate) AS DATE) AS month FROM sightings) s
           ON i.id = s.id AND m.month = s.month""", "sightings")

view("dense_days", """
    SELECT i.id, d.sdate, CAST(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS INT) AS observed
    FROM (SELECT DISTINCT id FROM sightings) i
         CROSS JOIN (SELECT DISTINCT sdate FROM sightings) d
         LEFT JOIN (SELECT DISTINCT id, sdate FROM sightings) s ON i.id = s.id AND d.sdate = s.sdate""", "sightings")

view("points", """
    SELECT event_id, CAST(ts AS DATE) AS pdate,
           (hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT)) / CAST(864 AS DOUBLE) AS x,
           value / CAST(5 AS DOUBLE) AS y,
           CASE WHEN event_type IN ('view','click') THEN 'Social'
                WHEN event_type IN ('purchase','signup') THEN 'FERRY' ELSE 'UNIRM' END AS stype,
           CASE WHEN user_id % 2 = 0 THEN 'Stenella coeruleoalba' ELSE 'Tursiops truncatus' END AS species,
           CAST((event_id * 1103515245 + 12345) % 2147483648 AS DOUBLE) / CAST(2147483648 AS DOUBLE) AS u1,
           CAST((event_id * 22695477 + 1) % 2147483648 AS DOUBLE) / CAST(2147483648 AS DOUBLE) AS u2
    FROM events""")

view("track_vertices", """
    SELECT event_id // 50 AS line_id, CAST(event_id % 50 + 1 AS INT) AS seq, x, y FROM points""", "points")

view("track_segments", """
    SELECT * FROM (
      SELECT line_id, seq, x AS x1, y AS y1,
             lead(x) OVER (PARTITION BY line_id ORDER BY seq) AS x2,
             lead(y) OVER (PARTITION BY line_id ORDER BY seq) AS y2
      FROM track_vertices) WHERE x2 IS NOT NULL""", "track_vertices")


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)


view("area_vertices", f"""
    SELECT seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES {_rows(AREA_RING)}) AS v(seq, x, y)""")

view("area_edges", """
    SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM area_vertices a JOIN area_vertices b ON b.seq = a.seq % (SELECT max(seq) FROM area_vertices) + 1""",
     "area_vertices")

view("ferry_segments", f"""
    SELECT a.line_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM (SELECT line_id, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
          FROM (VALUES {_rows(FERRY_LINES)}) AS v(line_id, seq, x, y)) a
    JOIN (SELECT line_id, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
          FROM (VALUES {_rows(FERRY_LINES)}) AS v(line_id, seq, x, y)) b
      ON a.line_id = b.line_id AND b.seq = a.seq + 1""")

view("depth_grid", """
    SELECT CAST(id % 50 AS INT) AS ix, CAST(floor(id / 50) AS INT) AS iy,
           CAST(2 * (id % 50) + 1 AS DOUBLE) AS x, CAST(2 * floor(id / 50) + 1 AS DOUBLE) AS y,
           1 + sin((2 * (id % 50) + 1) / CAST(15 AS DOUBLE)) * cos((2 * floor(id / 50) + 1) / CAST(20 AS DOUBLE)) AS z
    FROM (SELECT range AS id FROM range(2500)) r""")

view("social_grid", """
    SELECT ix, iy, x, y,
           2 * exp(-((x - 30) * (x - 30) + (y - 10) * (y - 10)) / 800) - CAST(0.5 AS DOUBLE) AS z
    FROM depth_grid WHERE (ix + iy) % 17 <> 0""", "depth_grid")

view("draws", """
    SELECT vec_id AS draw,
           4 * CAST(embedding[1] AS DOUBLE) AS theta_scale, CAST(embedding[2] AS DOUBLE) AS loc,
           4 * CAST(embedding[3] AS DOUBLE) AS theta_sig, -4 + CAST(embedding[4] AS DOUBLE) AS b0,
           -1 + CAST(embedding[5] AS DOUBLE) AS b1
    FROM embeddings""")

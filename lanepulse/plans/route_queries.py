"""Queries of the route geometry and spatial operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..functions.kept import kept
from ..functions.levels import level
from ..functions.presets import TOWNS, gazetteer
from ..functions.text import normalise_place, parse_route
from ..operators import metrics as M
from ..operators import routes as R
from .models import cameras, directions, samples, with_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def hav_sql(a, b, c, d):
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def bearing_sql(a, b, c, d):
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def _names(spark, d):
    return cameras(spark, d).selectExpr("id", "CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN concat('[ ] ', name) ELSE concat('[', route, '] ', name) END AS name")


@query("r1_parse_route", with_sql("cameras") + " SELECT id, CASE WHEN id % 4 IN (0, 1) THEN NULL ELSE route END AS route FROM cameras")
def r1(spark, d):
    return _names(spark, d).select("id", parse_route(F.col("name")).alias("route"))


_PAIR = with_sql("cameras") + ", p AS (SELECT a.id, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob FROM cameras a JOIN cameras b ON b.id = a.id + 1)"


def _pairs(spark, d):
    c = cameras(spark, d)
    a = c.select("id", F.col("lat").alias("la"), F.col("lon").alias("oa"))
    return a.join(c.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), "id")


def _ends():
    return F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")


@query("r2_haversine", _PAIR + f" SELECT id, round({hav_sql('la', 'oa', 'lb', 'ob')}, 5) AS metres FROM p")
def r2(spark, d):
    return _pairs(spark, d).select("id", F.round(geo.haversine(*_ends()), 5).alias("metres"))


@query("r3_bearing", _PAIR + f" SELECT id, round({bearing_sql('la', 'oa', 'lb', 'ob')}, 8) AS heading FROM p")
def r3(spark, d):
    return _pairs(spark, d).select("id", F.round(geo.bearing(*_ends()), 8).alias("heading"))


@query("r4_destination", with_sql("directions", "cameras") + """ SELECT id, index, round(degrees(asin(s)), 9) AS lat, round(lon + degrees(atan2(sin(h) * sin(k) * cos(p), cos(k) - sin(p) * s)), 9) AS lon
  FROM (SELECT *, sin(p) * cos(k) + cos(p) * sin(k) * cos(h) AS s FROM (SELECT id, index, lon, radians(lat) AS p, radians(heading_deg) AS h, 1500.0::DOUBLE / 6371000.0::DOUBLE AS k FROM cameras JOIN directions ON id = camera_id))""")
def r4(spark, d):
    rows = cameras(spark, d).join(directions(spark, d).drop("name"), F.col("id") == F.col("camera_id"))
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("heading_deg"), F.lit(1500.0))
    return rows.select("id", "index", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


#: The line a camera stands on: route, region and a run of ids, so that lines grow in number, not in length.
_LINE_SQL = ", lines AS (SELECT *, concat(route, '/', region, '/', id // 1500) AS line, lat + 0.01::DOUBLE * (id % 9 - 4) AS plat, lon + 0.003::DOUBLE * (id % 7 - 3) AS plon FROM cameras)"


def _lines(spark, d):
    """Cameras with their line, and a place beside it."""
    return cameras(spark, d).selectExpr("*", "concat(route, '/', region, '/', id div 1500) AS line", "lat + 0.01D * (id % 9 - 4) AS plat", "lon + 0.003D * (id % 7 - 3) AS plon")


@query("r5_r6_build_chains")
def r56(spark, d):
    return R.build_chains(_lines(spark, d).selectExpr("line AS route", "id AS ord", "lat", "lon"))


_CHAIN = with_sql("cameras") + _LINE_SQL + f""", pts AS (SELECT line AS chain_id, CAST(row_number() OVER (PARTITION BY line ORDER BY lat, id) - 1 AS INT) AS seq, lat, lon FROM lines),
  stp AS (SELECT *, coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM pts WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
  ch AS (SELECT chain_id, seq, lat, lon, sum(step) OVER (PARTITION BY chain_id ORDER BY seq) AS cum_m FROM stp),
  sg AS (SELECT *, coalesce(lead(lat) OVER w, lat) AS lat2, coalesce(lead(lon) OVER w, lon) AS lon2, coalesce(lead(cum_m) OVER w, cum_m) AS cum2, max(cum_m) OVER (PARTITION BY chain_id) AS length_m FROM ch WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
  seg AS (SELECT * FROM sg WHERE cum2 > cum_m OR length_m = 0 AND seq = 0)"""


def _chains(spark, d):
    pts = _lines(spark, d).selectExpr("line AS chain_id", "CAST(row_number() OVER (PARTITION BY line ORDER BY lat, id) - 1 AS INT) AS seq", "lat", "lon")
    return R.chain_distance(pts)


def _at_sql(rows: str, s: str, name: str) -> str:
    """SQL: the point of each row of ``rows`` at the distance ``s`` along its chain, as ``name`` lat and lon."""
    at = f"least(greatest({s}, 0), length_m)"
    h = f"CASE WHEN cum2 > cum_m THEN ({at} - cum_m) / (cum2 - cum_m) ELSE 0 END"
    return f"""(SELECT r.*, lat + {h} * (lat2 - lat) AS {name}_lat, lon + {h} * (lon2 - lon) AS {name}_lon FROM {rows} r JOIN seg ON r.chain_id = seg.chain_id
    WHERE {at} >= cum_m AND ({at} < cum2 OR ({at} = length_m AND cum2 = length_m)))"""


@query("r7_chain_distance", _CHAIN + " SELECT chain_id, seq, round(cum_m, 4) AS cum_m FROM ch")
def r7(spark, d):
    return _chains(spark, d).select("chain_id", "seq", F.round("cum_m", 4).alias("cum_m"))


_PROJECT = _CHAIN + """, pj AS (SELECT id, s.chain_id, seq, cum_m, cum2, s.lat - plat AS y0, lat2 - plat AS y1, s.lon - plon AS x0, lon2 - plon AS x1, cos(radians(plat)) * 111320.0::DOUBLE AS kx, 110540.0::DOUBLE AS ky
    FROM seg s JOIN lines c ON c.line = s.chain_id),
  q AS (SELECT *, x0 * kx AS ax, y0 * ky AS ay, x1 * kx - x0 * kx AS dx, y1 * ky - y0 * ky AS dy FROM pj),
  u AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS h FROM q),
  z AS (SELECT *, round(sqrt(pow(ax + h * dx, 2) + pow(ay + h * dy, 2)), 6) AS off_m, round(cum_m + h * (cum2 - cum_m), 6) AS s_m FROM u),
  proj AS (SELECT id, chain_id, s_m, off_m FROM (SELECT *, row_number() OVER (PARTITION BY id, chain_id ORDER BY off_m, seq) AS r FROM z) WHERE r = 1)"""


def _projected(spark, d):
    points = _lines(spark, d).selectExpr("id", "line AS chain_id", "plat", "plon")
    return R.project(points, _chains(spark, d))


@query("r8_project", _PROJECT + " SELECT id, chain_id, round(s_m, 3) AS s_m, round(off_m, 3) AS off_m FROM proj")
def r8(spark, d):
    return _projected(spark, d).select("id", "chain_id", geo.rounded(F.col("s_m"), 3).alias("s_m"), geo.rounded(F.col("off_m"), 3).alias("off_m"))


@query("r9_point_at", _CHAIN + f""", pl AS (SELECT id, line AS chain_id, (id % 40) * 10000.0::DOUBLE AS s_m FROM lines)
  SELECT id, chain_id, round(at_lat, 8) AS at_lat, round(at_lon, 8) AS at_lon FROM {_at_sql('pl', 's_m', 'at')}""")
def r9(spark, d):
    places = _lines(spark, d).selectExpr("id", "line AS chain_id", "(id % 40) * 10000D AS s_m")
    return R.point_at(places, _chains(spark, d)).select("id", "chain_id", F.round("at_lat", 8).alias("at_lat"), F.round("at_lon", 8).alias("at_lon"))


@query("r10_slice", _CHAIN + """, e AS (SELECT chain_id, unnest([30000.0::DOUBLE, least(250000.0::DOUBLE, length_m)]) AS s_m FROM (SELECT chain_id, max(cum_m) AS length_m FROM ch GROUP BY 1) WHERE length_m >= 30000)
  SELECT chain_id, round(s_m, 3) AS s_m, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (
  SELECT chain_id, cum_m AS s_m, lat, lon FROM ch WHERE cum_m > 30000 AND cum_m < 250000
  UNION SELECT e.chain_id, s_m, lat + (s_m - cum_m) / (cum2 - cum_m) * (lat2 - lat), lon + (s_m - cum_m) / (cum2 - cum_m) * (lon2 - lon)
  FROM e JOIN seg s ON e.chain_id = s.chain_id AND s_m >= cum_m AND (s_m < cum2 OR (s_m = length_m AND cum2 = length_m)))""")
def r10(spark, d):
    return R.slice_chain(_chains(spark, d), 30_000, 250_000).select("chain_id", F.round("s_m", 3).alias("s_m"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("r11_heading_at", _PROJECT + f""", pl AS (SELECT id, chain_id, s_m, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS sign FROM proj)
  SELECT id, chain_id, sign, round(({bearing_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} + CASE WHEN sign < 0 THEN 180 ELSE 0 END) % 360, 5) AS heading
  FROM {_at_sql(_at_sql('pl', 's_m - 400', 'a'), 's_m + 400', 'b')}""")
def r11(spark, d):
    places = _projected(spark, d).select("id", "chain_id", "s_m").withColumn("sign", F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    return R.heading_at(places, _chains(spark, d)).select("id", "chain_id", "sign", F.round("heading", 5).alias("heading"))


#: Whole routes: a line for each half degree of latitude through all places of its cameras, west to east; odd lines are
#: motorways. A line is longer the more places there are, and a place beside one meets those of its route nearby.
_ROUTE_LINES = with_sql("cameras", "directions") + _CHAIN.split(", pts AS")[0].removeprefix(with_sql("cameras")) + """, places AS (SELECT DISTINCT route, lat, lon FROM cameras), pts AS (SELECT concat(route, '/', CAST(floor(lat * 2) AS BIGINT)) AS chain_id, CAST(row_number() OVER (PARTITION BY route, floor(lat * 2) ORDER BY lon, lat) - 1 AS INT) AS seq, lat, lon FROM places),""" + _CHAIN.split("FROM lines),", 1)[1] + """,
  kind AS (SELECT DISTINCT chain_id, split_part(chain_id, '/', 1) AS route, CASE WHEN CAST(split_part(chain_id, '/', 2) AS BIGINT) % 2 = 1 THEN 'ex' ELSE 'its' END AS road_type FROM ch)"""


def _route_chains(spark, d):
    places = cameras(spark, d).select("route", "lat", "lon").distinct()
    pts = places.selectExpr("route", "concat(route, '/', CAST(floor(lat * 2) AS BIGINT)) AS chain_id", "CASE WHEN floor(lat * 2) % 2 = 1 THEN 'ex' ELSE 'its' END AS road_type", "CAST(row_number() OVER (PARTITION BY route, floor(lat * 2) ORDER BY lon, lat) - 1 AS INT) AS seq", "lat", "lon")
    return kept(R.chain_distance(pts), "chains")


def _on_chains_sql(rows: str, name: str, keys: str, join: str) -> str:
    """SQL: ``rows`` (with plat, plon) projected on each chain that ``join`` gives: ``name`` with ``keys``, chain_id, s_m, off_m."""
    return f"""{name}_p AS (SELECT {keys}, s.chain_id, seq, cum_m, cum2, (s.lat - plat) * 110540.0::DOUBLE AS ay, (lat2 - s.lat) * 110540.0::DOUBLE AS dy, (s.lon - plon) * cos(radians(plat)) * 111320.0::DOUBLE AS ax, (lon2 - s.lon) * cos(radians(plat)) * 111320.0::DOUBLE AS dx FROM {rows} r {join}),
  {name}_u AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS h FROM {name}_p),
  {name}_z AS (SELECT *, round(sqrt(pow(ax + h * dx, 2) + pow(ay + h * dy, 2)), 6) AS off_m, round(cum_m + h * (cum2 - cum_m), 6) AS s_m FROM {name}_u),
  {name} AS (SELECT * FROM {name}_z QUALIFY row_number() OVER (PARTITION BY {keys}, chain_id ORDER BY off_m, seq) = 1)"""


_BESIDE = "beside AS (SELECT id, route, CASE id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS prefer, lat + 0.01::DOUBLE * (id % 9 - 4) AS plat, lon + 0.003::DOUBLE * (id % 7 - 3) AS plon FROM cameras)"
_FIRST = "CASE WHEN road_type = prefer THEN 0 WHEN road_type = 'ex' THEN 1 ELSE 2 END"


@query("r12_find_chain", _ROUTE_LINES + f""", {_BESIDE}, {_on_chains_sql('beside', 'pr', 'id, prefer', 'JOIN kind USING (route) JOIN seg s ON s.chain_id = kind.chain_id')}
  SELECT id, chain_id, road_type, round(s_m, 3) AS s_m, round(off_m, 3) AS off_m FROM pr JOIN kind USING (chain_id) WHERE off_m <= 3000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_FIRST}, off_m, chain_id) = 1""")
def r12(spark, d):
    points = cameras(spark, d).selectExpr("id", "route", "CASE id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS prefer", "lat + 0.01D * (id % 9 - 4) AS plat", "lon + 0.003D * (id % 7 - 3) AS plon")
    found = R.nearest_chain(points, _route_chains(spark, d))
    return found.select("id", "chain_id", "road_type", geo.rounded(F.col("s_m"), 3).alias("s_m"), geo.rounded(F.col("off_m"), 3).alias("off_m"))


_RESOLVE = _PROJECT + """, pr AS (SELECT a.id, a.s_m AS camera_s, b.s_m AS dest_s, b.off_m AS dest_off, l.length_m FROM (SELECT *, lead(id) OVER (PARTITION BY chain_id ORDER BY id) AS dest FROM proj) a LEFT JOIN proj b ON b.id = a.dest AND a.chain_id = b.chain_id
    JOIN (SELECT chain_id, max(cum_m) AS length_m FROM ch GROUP BY 1) l ON l.chain_id = a.chain_id)"""


def _resolved(spark, d):
    p = _projected(spark, d)
    length = _chains(spark, d).groupBy("chain_id").agg(F.max("cum_m").alias("length_m"))
    nxt = W.partitionBy("chain_id").orderBy("id")
    pairs = p.select("id", "chain_id", F.col("s_m").alias("camera_s"), F.lead("s_m").over(nxt).alias("dest_s"), F.lead("off_m").over(nxt).alias("dest_off"))
    return R.resolve_sign(pairs.join(length, "chain_id"))


@query("r13_resolve", _RESOLVE + """ SELECT id, CASE WHEN near AND beyond AND dest_s <= length_m / 2 THEN -1 WHEN near AND beyond THEN 1 WHEN NOT near THEN CAST(sign(dest_s - camera_s) AS INT) END AS sign,
    CASE WHEN dest_s IS NULL OR (near AND NOT beyond) THEN NULL WHEN near OR (dest_off >= 15000 AND edge) THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN dest_s IS NULL THEN 'unknown place' WHEN near AND NOT beyond THEN 'too close' END AS reason
  FROM (SELECT *, abs(dest_s - camera_s) < 300 AS near, dest_s <= 1 OR dest_s >= length_m - 1 AS edge, (dest_s <= 1 OR dest_s >= length_m - 1) AND dest_off > 2000 AS beyond FROM pr)""")
def r13(spark, d):
    return _resolved(spark, d).select("id", "sign", "confidence", "reason")


@query("r14_fill_opposite", with_sql("directions") + """, h AS (SELECT camera_id, index, CASE WHEN camera_id % 3 = 0 AND index = 2 OR camera_id % 5 = 0 THEN NULL ELSE heading_deg END AS heading FROM directions),
  k AS (SELECT *, count(*) OVER w AS n, count(heading) OVER w AS m, max(heading) OVER w AS o FROM h WINDOW w AS (PARTITION BY camera_id))
  SELECT camera_id, index, CASE WHEN heading IS NULL AND n = 2 AND m = 1 THEN (o + 180) % 360 ELSE heading END AS heading, CASE WHEN heading IS NULL AND n = 2 AND m = 1 THEN 'medium' ELSE 'high' END AS confidence FROM k""")
def r14(spark, d):
    gone = ((F.col("camera_id") % 3 == 0) & (F.col("index") == 2)) | (F.col("camera_id") % 5 == 0)
    rows = directions(spark, d).select("camera_id", "index", F.when(~gone, F.col("heading_deg")).alias("heading"), F.lit("high").alias("confidence"))
    return R.fill_opposite(rows).select("camera_id", "index", "heading", "confidence")


@query("r15_axial_mean", with_sql("directions") + " SELECT road, round((degrees(atan2(sum(sin(radians(heading_deg * 2))), sum(cos(radians(heading_deg * 2))))) / 2 + 180) % 180, 6) AS axis FROM directions GROUP BY road")
def r15(spark, d):
    return directions(spark, d).groupBy("road").agg(F.round(geo.axial_mean(F.col("heading_deg")), 6).alias("axis"))


@query("r16_angles", with_sql("directions") + """ SELECT camera_id, index, least((heading_deg - 77 + 360) % 360, 360 - (heading_deg - 77 + 360) % 360) AS diff,
  ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(heading_deg / 45 + 0.5) AS BIGINT) % 8 + 1] AS sector FROM directions""")
def r16(spark, d):
    return directions(spark, d).select("camera_id", "index", geo.angle_diff(F.col("heading_deg"), F.lit(77.0)).alias("diff"), geo.compass(F.col("heading_deg")).alias("sector"))


_N = "(SELECT count(*) FROM cameras)"
_AIMED = f"""aimed AS (SELECT c.id AS camera_id, index, c.lat AS plat, c.lon AS plon, CASE c.id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS prefer, route, heading_deg, CASE WHEN c.id % 7 = 0 THEN 'manual' END AS heading_source,
    CASE WHEN (c.id + index) % 11 = 0 THEN '' WHEN (c.id + index) % 13 = 0 THEN 'nowhere' ELSE concat('P', (c.id * 31 + index * 17) % {_N}) END AS destination FROM cameras c JOIN directions ON c.id = camera_id)"""


def _aimed(spark, d):
    """Cameras, directions with destinations that are other cameras' places, and those places."""
    cams = cameras(spark, d).selectExpr("id", "route", "CASE id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS road_type", "lat", "lon")
    n = cams.count()
    rows = directions(spark, d).selectExpr(
        "camera_id", "index", "'' AS road", "heading_deg", "CASE WHEN camera_id % 7 = 0 THEN 'manual' END AS heading_source", "1.5D AS lat", "2.5D AS lon",
        f"CASE WHEN (camera_id + index) % 11 = 0 THEN '' WHEN (camera_id + index) % 13 = 0 THEN 'nowhere' ELSE concat('P', (camera_id * 31 + index * 17) % {n}) END AS destination",
    )
    return cams, rows, cams.selectExpr("concat('P', id) AS name", "lat", "lon")


_RESOLVED = _ROUTE_LINES + f""", {_AIMED}, todo AS (SELECT * FROM aimed WHERE heading_source IS NULL AND destination <> ''),
  {_on_chains_sql('(SELECT DISTINCT camera_id, route, prefer, plat, plon FROM todo)', 'pr', 'camera_id, prefer', 'JOIN kind USING (route) JOIN seg s ON s.chain_id = kind.chain_id')},
  onl AS (SELECT camera_id, chain_id, s_m AS camera_s FROM pr JOIN kind USING (chain_id) WHERE off_m <= 3000 QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY {_FIRST}, off_m, chain_id) = 1),
  goal AS (SELECT todo.camera_id, index, destination, chain_id, camera_s, c.lat AS dlat, c.lon AS dlon FROM todo LEFT JOIN onl USING (camera_id) LEFT JOIN cameras c ON destination = concat('P', c.id)),
  {_on_chains_sql('(SELECT DISTINCT destination, chain_id AS on_chain, dlat AS plat, dlon AS plon FROM goal WHERE dlat IS NOT NULL AND chain_id IS NOT NULL)', 'de', 'destination', 'JOIN seg s ON s.chain_id = on_chain')},
  pairs AS (SELECT goal.*, de.s_m AS dest_s, de.off_m AS dest_off, length_m FROM goal LEFT JOIN de ON de.destination = goal.destination AND de.chain_id = goal.chain_id LEFT JOIN (SELECT chain_id, max(cum_m) AS length_m FROM ch GROUP BY 1) l ON l.chain_id = goal.chain_id),
  judged AS (SELECT *, abs(dest_s - camera_s) < 300 AS near, (dest_s <= 1 OR dest_s >= length_m - 1) AND dest_off > 2000 AS beyond, dest_off >= 15000 AND (dest_s <= 1 OR dest_s >= length_m - 1) AS far FROM pairs),
  signs AS (SELECT camera_id, index, chain_id, camera_s AS s_m, CASE WHEN NOT near THEN CAST(sign(dest_s - camera_s) AS INT) WHEN near AND beyond AND dest_s <= length_m / 2 THEN -1 WHEN near AND beyond THEN 1 END AS sign,
    CASE WHEN dest_s IS NULL OR near AND NOT beyond THEN NULL WHEN near OR far THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN chain_id IS NULL THEN 'no line' WHEN dest_s IS NULL THEN 'unknown place' WHEN near AND NOT beyond THEN 'too close' END AS reason FROM judged),
  hd AS (SELECT camera_id, index, round(({bearing_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} + CASE WHEN sign < 0 THEN 180 ELSE 0 END) % 360, 1) AS heading FROM {_at_sql(_at_sql('(SELECT * FROM signs WHERE sign IS NOT NULL)', 's_m - 400', 'a'), 's_m + 400', 'b')}),
  all_ AS (SELECT camera_id, index, heading, confidence, reason, count(*) OVER w AS n, count(heading) OVER w AS m, max(heading) OVER w AS o FROM signs LEFT JOIN hd USING (camera_id, index) WINDOW w AS (PARTITION BY camera_id)),
  resolved AS (SELECT camera_id, index, CASE WHEN heading IS NULL AND n = 2 AND m = 1 THEN (o + 180) % 360 ELSE heading END AS heading, CASE WHEN heading IS NULL AND n = 2 AND m = 1 THEN 'medium' ELSE confidence END AS confidence, reason FROM all_)"""


@query("r17_resolve_directions", _RESOLVED + " SELECT camera_id, index, round(heading, 1) AS heading, confidence, reason FROM resolved")
def r17r(spark, d):
    cams, rows, places = _aimed(spark, d)
    return R.resolve_directions(cams, rows, _route_chains(spark, d), places).withColumn("heading", F.round("heading", 1))


@query("r17_auto_headings", _RESOLVED + """ SELECT camera_id, index, round(coalesce(heading, heading_deg), 1) AS heading_deg, CASE WHEN heading IS NOT NULL THEN 'auto' ELSE heading_source END AS heading_source,
  CASE WHEN heading IS NULL THEN 1.5::DOUBLE END AS lat, CASE WHEN heading IS NULL THEN 2.5::DOUBLE END AS lon FROM aimed LEFT JOIN resolved USING (camera_id, index)""")
def r17(spark, d):
    cams, rows, places = _aimed(spark, d)
    return R.auto_headings(rows, R.resolve_directions(cams, rows, _route_chains(spark, d), places)).withColumn("heading_deg", F.round("heading_deg", 1))


_PAINT = _ROUTE_LINES + f""", ds AS (SELECT c.id * 2 + index AS id, c.id AS camera_id, index, heading_deg, route, CASE c.id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS prefer, CASE WHEN c.id % 5 = 0 THEN c.lat + 0.004::DOUBLE * index ELSE c.lat END AS plat, c.lon AS plon
    FROM cameras c JOIN directions ON c.id = camera_id WHERE (c.id + index) % 9 > 0),
  {_on_chains_sql('ds', 'pr', 'id, prefer, heading_deg', 'JOIN kind USING (route) JOIN seg s ON s.chain_id = kind.chain_id')},
  onl AS (SELECT id, heading_deg, chain_id, s_m FROM pr JOIN kind USING (chain_id) WHERE off_m <= 3000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_FIRST}, off_m, chain_id) = 1),
  tg AS (SELECT id, chain_id, s_m, heading_deg, {bearing_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} % 360 AS tangent FROM {_at_sql(_at_sql('onl', 's_m - 400', 'a'), 's_m + 400', 'b')}),
  pl AS (SELECT id, chain_id, s_m, CASE WHEN least((heading_deg - tangent + 720) % 360, 360 - (heading_deg - tangent + 720) % 360) <= 90 THEN 1 ELSE -1 END AS sign FROM tg),
  nb AS (SELECT *, lag(s_m) OVER w AS b, lead(s_m) OVER w AS a FROM (SELECT DISTINCT chain_id, sign, s_m FROM pl) WINDOW w AS (PARTITION BY chain_id, sign ORDER BY s_m)),
  ex AS (SELECT pl.*, pl.s_m - greatest(800.0::DOUBLE, least(8000.0::DOUBLE, coalesce(abs(b - pl.s_m) / 2, 8000))) AS from_m, pl.s_m + greatest(800.0::DOUBLE, least(8000.0::DOUBLE, coalesce(abs(a - pl.s_m) / 2, 8000))) AS to_m FROM pl JOIN nb ON pl.chain_id = nb.chain_id AND pl.sign = nb.sign AND pl.s_m = nb.s_m),
  hl AS (SELECT ex.*, least(greatest(from_m, 0), length_m) AS lo, least(greatest(to_m, 0), length_m) AS hi FROM ex JOIN (SELECT chain_id, max(cum_m) AS length_m FROM ch GROUP BY 1) l ON l.chain_id = ex.chain_id),
  cut AS (SELECT id, m, at_lat AS lat, at_lon AS lon FROM {_at_sql('(SELECT DISTINCT id, chain_id, unnest([lo, hi]) AS m FROM hl)', 'm', 'at')} UNION ALL SELECT id, cum_m, ch.lat, ch.lon FROM hl JOIN ch ON ch.chain_id = hl.chain_id AND cum_m > lo AND cum_m < hi)"""


def _painted(spark, d):
    cams = cameras(spark, d).selectExpr("id", "route", "CASE id % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'its' END AS road_type", "lat", "lon")
    own = cams.select(F.col("id").alias("camera_id"), F.col("lat").alias("y"))
    rows = directions(spark, d).join(own, "camera_id").selectExpr("camera_id", "index", "'' AS road", "heading_deg", "CASE WHEN camera_id % 5 = 0 THEN y + 0.004D * index END AS lat", "CAST(NULL AS DOUBLE) AS lon", "(camera_id + index) % 9 > 0 AS measured")
    return R.painted_segments(cams, rows, _route_chains(spark, d))


@query("r18_painted_segments", _PAINT + """ SELECT (id - index) // 2 AS camera_id, index, chain_id, sign, round(from_m, 2) AS from_m, round(to_m, 2) AS to_m, points, round(CASE WHEN sign < 0 THEN last_lat ELSE first_lat END + 1e-7, 5) AS start_lat, round(CASE WHEN sign < 0 THEN last_lon ELSE first_lon END + 1e-7, 5) AS start_lon
  FROM (SELECT *, CAST(2 - id % 2 AS INT) AS index FROM ex) JOIN (SELECT id, count(*) AS points, arg_min(round(lat, 6), m) AS first_lat, arg_max(round(lat, 6), m) AS last_lat, arg_min(round(lon, 6), m) AS first_lon, arg_max(round(lon, 6), m) AS last_lon FROM cut GROUP BY id) USING (id)""")
def r18p(spark, d):
    rows = _painted(spark, d)
    return rows.select("camera_id", "index", "chain_id", "sign", geo.rounded(F.col("from_m"), 2).alias("from_m"), geo.rounded(F.col("to_m"), 2).alias("to_m"), F.size("coords").cast("long").alias("points"), F.round(F.col("coords")[0]["lat"] + 1e-7, 5).alias("start_lat"), F.round(F.col("coords")[0]["lon"] + 1e-7, 5).alias("start_lon"))


@query("r18_camera_segments", _PROJECT + """, pl AS (SELECT id, chain_id, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS sign, s_m FROM proj),
  nb AS (SELECT *, lag(s_m) OVER w AS b, lead(s_m) OVER w AS a FROM (SELECT DISTINCT chain_id, sign, s_m FROM pl) WINDOW w AS (PARTITION BY chain_id, sign ORDER BY s_m))
  SELECT id, pl.chain_id, pl.sign, round(pl.s_m - greatest(800.0::DOUBLE, least(8000.0::DOUBLE, coalesce(abs(b - pl.s_m) / 2, 8000))), 2) AS from_m,
    round(pl.s_m + greatest(800.0::DOUBLE, least(8000.0::DOUBLE, coalesce(abs(a - pl.s_m) / 2, 8000))), 2) AS to_m
  FROM pl JOIN nb ON pl.chain_id = nb.chain_id AND pl.sign = nb.sign AND pl.s_m = nb.s_m""")
def r18(spark, d):
    places = _projected(spark, d).select("id", "chain_id", F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("sign"), "s_m")
    return R.camera_segments(places).select("id", "chain_id", "sign", geo.rounded(F.col("from_m"), 2).alias("from_m"), geo.rounded(F.col("to_m"), 2).alias("to_m"))


@query("r19_route_lines", _CHAIN + " SELECT chain_id AS route, chain_id, count(*) AS points FROM ch GROUP BY 1 HAVING count(*) >= 2")
def r19(spark, d):
    return R.route_lines(_chains(spark, d).withColumn("route", F.col("chain_id")).withColumn("road_type", F.lit("its")))


@query("r20_line_near", _PROJECT + """, f AS (SELECT id, p.chain_id, off_m, greatest(s_m - 60000, 0) AS a, least(s_m + 60000, length_m) AS b FROM proj p JOIN (SELECT chain_id, max(cum_m) AS length_m FROM ch GROUP BY 1) l ON l.chain_id = p.chain_id WHERE off_m <= 3000),
  e AS (SELECT id, chain_id, off_m, unnest([a, b]) AS s_m FROM f)
  SELECT id, chain_id, round(off_m, 3) AS off_m, round(s_m, 3) AS s_m, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (
  SELECT f.id, f.chain_id, off_m, cum_m AS s_m, lat, lon FROM f JOIN ch ON ch.chain_id = f.chain_id AND cum_m > a AND cum_m < b
  UNION SELECT e.id, e.chain_id, off_m, s_m, lat + h * (lat2 - lat), lon + h * (lon2 - lon)
  FROM (SELECT e.*, s.* EXCLUDE (chain_id), CASE WHEN cum2 > cum_m THEN (s_m - cum_m) / (cum2 - cum_m) ELSE 0 END AS h FROM e JOIN seg s ON e.chain_id = s.chain_id AND s_m >= cum_m AND (s_m < cum2 OR (s_m = length_m AND cum2 = length_m))) e)""")
def r20(spark, d):
    chains = _chains(spark, d)
    points = _lines(spark, d).selectExpr("id", "line AS route", "plat", "plon", "'its' AS prefer")
    found = R.nearest_chain(points, chains.withColumns({"road_type": F.lit("its"), "route": F.col("chain_id")}))
    out = R.line_near(found, chains, 60_000.0)
    return out.select("id", "chain_id", *(geo.rounded(F.col(c), n).alias(c) for c, n in (("off_m", 3), ("s_m", 3), ("lat", 7), ("lon", 7))))


@query("r21_offset_line", _CHAIN + """, o AS (SELECT chain_id, seq, lat, lon, (coalesce(lead(lon) OVER w, lon) - coalesce(lag(lon) OVER w, lon)) * cos(radians(lat)) * 111320.0::DOUBLE AS dx,
    (coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat)) * 110540.0::DOUBLE AS dy FROM ch WINDOW w AS (PARTITION BY chain_id ORDER BY seq))
  SELECT chain_id, seq, round(lat - CASE WHEN dx * dx + dy * dy > 0 THEN dx / sqrt(dx * dx + dy * dy) * 30 / (110540.0::DOUBLE) ELSE 0 END, 8) AS lat,
    round(lon + CASE WHEN dx * dx + dy * dy > 0 THEN dy / sqrt(dx * dx + dy * dy) * 30 / (cos(radians(lat)) * 111320.0::DOUBLE) ELSE 0 END, 8) AS lon FROM o""")
def r21(spark, d):
    return R.offset_line(_chains(spark, d), 30.0).select("chain_id", "seq", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


_NEAR = with_sql("cameras") + """, bx AS (SELECT a.id, b.id AS other, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2, CASE WHEN a.route = b.route THEN 0 ELSE 1 END AS other_route,
    round(pow(b.lat - a.lat, 2) + pow((b.lon - a.lon) * cos(radians(a.lat)), 2), 12) AS d2
    FROM cameras a JOIN cameras b ON abs(b.lat - a.lat) <= 0.3 AND abs(b.lon - a.lon) <= 0.3),
  pool AS (SELECT * FROM (SELECT *, min(other_route) OVER (PARTITION BY id) AS best FROM bx WHERE d2 > 1e-10) WHERE other_route = best),
  nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS place FROM pool) WHERE place <= 4)"""


@query("r22_suggest_axis", _NEAR + """, xy AS (SELECT id, (lon2 - lon) * cos(radians(lat)) * 111320.0::DOUBLE AS x, (lat2 - lat) * 110540.0::DOUBLE AS y FROM nr),
  s AS (SELECT id, count(*) + 1 AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM xy GROUP BY id),
  c AS (SELECT id, xx / n - pow(sx / n, 2) AS cxx, yy / n - pow(sy / n, 2) AS cyy, xy / n - sx * sy / n / n AS cxy FROM s)
  SELECT id, round((90 - degrees(atan2(2 * cxy, cxx - cyy)) / 2 + 180) % 180, 6) AS axis, round((cxx + cyy + sqrt(pow(cxx - cyy, 2) + 4 * cxy * cxy)) / 2 / (cxx + cyy), 9) AS linearity FROM c""")
def r22(spark, d):
    return R.suggest_axis(R.neighbours(cameras(spark, d), 4, 0.3))


@query("r23_bbox_search", with_sql("cameras") + """ SELECT id, name, round(pow(lat - 35.5, 2) + pow(lon - 127.5, 2), 12) AS d2 FROM cameras WHERE lat BETWEEN 34 AND 37 AND lon BETWEEN 126 AND 129 AND lower(name) LIKE '%1%' ORDER BY d2, id LIMIT 400""")
def r23(spark, d):
    return R.bbox_search(cameras(spark, d), 34.0, 126.0, 37.0, 129.0, 400, "1")


@query("r24_registered", with_sql("cameras") + " SELECT id, name, id % 3 = 0 AS registered FROM cameras")
def r24(spark, d):
    c = cameras(spark, d)
    return R.registered(c.select("id", "name"), c.filter("id % 3 = 0")).select("id", "name", "registered")


_PLACES = " SELECT id, CASE id % 5 WHEN 0 THEN concat('서울', id, ' 방향') WHEN 1 THEN concat('(', 'P', ') 대전IC') WHEN 2 THEN '마포대교' WHEN 3 THEN '서울·톨게이트 방면' ELSE '부산행' END AS name FROM cameras"


@query("r25_normalise_place", with_sql("cameras") + " SELECT id, CASE id % 5 WHEN 0 THEN '서울' WHEN 1 THEN 'P대전' WHEN 2 THEN '마포대교' WHEN 3 THEN '서울' ELSE '부산' END AS place FROM cameras")
def r25(spark, d):
    names = cameras(spark, d).selectExpr("id", _PLACES.split("id, ", 1)[1].rsplit(" FROM", 1)[0])
    return names.select("id", normalise_place(F.col("name")).alias("place"))


_TOWNS = ", ".join(f"('{n}', {y}::DOUBLE, {x}::DOUBLE)" for n, y, x in TOWNS)
_NAMED = f"CASE id % 4 WHEN 0 THEN concat('P', id % 6) WHEN 1 THEN '대전 방면' ELSE [{', '.join(repr(n) for n, _, _ in TOWNS)}][CAST(id % {len(TOWNS)} AS INT) + 1] || ' IC' END"


@query("r26_geocode", with_sql("cameras") + f""", g(place, lat, lon) AS (VALUES {_TOWNS}), n AS (SELECT id, {_NAMED} AS name FROM cameras), k AS (SELECT id, name, regexp_replace(regexp_replace(name, '[ 0-9]+', '', 'g'), '(방면|방향|쪽|행|시|군|IC|JC|나들목|분기점|톨게이트|TG)+$', '') AS place FROM n)
  SELECT id, name, place, coalesce(lat, CASE WHEN place = 'P' THEN 35.0::DOUBLE END) AS lat, coalesce(lon, CASE WHEN place = 'P' THEN 128.0::DOUBLE END) AS lon FROM k LEFT JOIN g USING (place)""")
def r26(spark, d):
    """Names with kinds of places at their ends, in the gazetteer, in the cache, or in neither."""
    towns = F.array(*(F.lit(n) for n, _, _ in TOWNS))
    name = F.when(F.col("id") % 4 == 0, F.concat(F.lit("P"), (F.col("id") % 6).cast("string"))).when(F.col("id") % 4 == 1, "대전 방면")
    name = name.otherwise(F.concat(F.get(towns, (F.col("id") % len(TOWNS)).cast("int")), F.lit(" IC")))
    names = cameras(spark, d).select("id", name.alias("name")).withColumn("place", normalise_place(F.col("name")))
    cached = names.filter("place = 'P'").select("place").distinct().withColumn("lat", F.lit(35.0)).withColumn("lon", F.lit(128.0))
    return R.geocode(names, gazetteer(spark), cached)


@query("r27_fill_positions", with_sql("cameras") + " SELECT id, CASE WHEN id % 3 = 0 THEN round((lat + lat + 0.5) / 2, 9) ELSE round(lat, 9) END AS lat, CASE WHEN id % 3 = 0 THEN round((lon + lon + 0.25) / 2, 9) ELSE round(lon, 9) END AS lon FROM cameras")
def r27(spark, d):
    c = cameras(spark, d)
    dirs = c.select(F.col("id").alias("camera_id"), "lat", "lon").union(c.select("id", F.col("lat") + 0.5, F.col("lon") + 0.25))
    hide = lambda x: F.when(F.col("id") % 3 != 0, F.col(x)).alias(x)
    return R.fill_positions(c.select("id", hide("lat"), hide("lon")), dirs).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("w7_stale_urls", with_sql("cameras") + " SELECT id FROM cameras WHERE enabled AND (id % 4 = 0 OR id % 30 >= 23)")
def w7(spark, d):
    from ..streaming.samples import stale_urls

    age = F.when(F.col("id") % 4 != 0, (F.col("id") % 30) * 3600.0)
    rows = cameras(spark, d).select("id", F.when(F.col("enabled"), "its").otherwise("upload").alias("source_type"), (1e9 - age).alias("fetched_t"))
    return stale_urls(rows, 1e9).select("id")


@query("w8_refresh_match", with_sql("cameras") + """, it AS (SELECT id AS item, CASE WHEN id % 2 = 0 THEN name ELSE 'other' END AS name, lat + (id % 3) * 0.0005::DOUBLE AS lat, lon FROM cameras),
  j AS (SELECT c.id, i.item, c.name = i.name AS same, pow(i.lat - c.lat, 2) + pow(i.lon - c.lon, 2) AS d2 FROM cameras c JOIN it i ON abs(i.lat - c.lat) <= 0.02 AND abs(i.lon - c.lon) <= 0.02)
  SELECT id, item FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same DESC, CASE WHEN same THEN 0 ELSE d2 END, item) AS r FROM j WHERE same OR d2 < 1e-6) WHERE r = 1""")
def w8(spark, d):
    c = cameras(spark, d)
    items = c.selectExpr("id AS item", "CASE WHEN id % 2 = 0 THEN name ELSE 'other' END AS name", "lat + (id % 3) * 0.0005D AS lat", "lon")
    return R.refresh_match(c, items)


_ST = """, st AS (SELECT s.camera_id, direction_index, occupancy, n_car + n_bus + n_truck AS nv, route, region, lat, lon FROM samples s JOIN cameras c ON s.camera_id = c.id)"""


@query("m22_bundle_points", with_sql("samples", "cameras") + _ST + " SELECT route AS bundle, round(avg(occupancy), 10) AS occupancy, CAST(sum(nv) AS BIGINT) AS nv, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, count(*) AS cameras FROM st WHERE direction_index = 0 GROUP BY 1")
def m22(spark, d):
    rows = samples(spark, d).filter("direction_index = 0").withColumn("nv", M.vehicles()).join(cameras(spark, d), F.col("camera_id") == F.col("id"))
    return R.bundle(rows, "route")


@query("m22_bundle_directions", with_sql("samples", "cameras", "directions") + """, r AS (SELECT route, s.occupancy, d.heading_deg FROM samples s JOIN cameras c ON s.camera_id = c.id JOIN directions d ON d.camera_id = s.camera_id AND d.index = s.direction_index),
  ax AS (SELECT route, (degrees(atan2(sum(sin(radians(heading_deg * 2))), sum(cos(radians(heading_deg * 2))))) / 2 + 180) % 180 AS axis FROM r GROUP BY 1)
  SELECT r.route AS bundle, CASE WHEN least((heading_deg - axis + 360) % 360, 360 - (heading_deg - axis + 360) % 360) <= 90 THEN 'forward' ELSE 'backward' END AS side, round(avg(occupancy), 10) AS occupancy, count(*) AS directions
  FROM r JOIN ax ON r.route = ax.route GROUP BY 1, 2""")
def m22b(spark, d):
    rows = samples(spark, d).join(cameras(spark, d).select(F.col("id").alias("camera_id"), "route"), "camera_id")
    rows = rows.join(directions(spark, d).select("camera_id", F.col("index").alias("direction_index"), "heading_deg"), ["camera_id", "direction_index"])
    return R.bundle_directions(rows, "route")

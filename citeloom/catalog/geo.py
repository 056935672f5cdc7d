"""Registered map queries. Years, points and lines are derived from orders, embeddings and the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import Tables, query
from citeloom.functions import geo as GF
from citeloom.operators import geo as G
from citeloom.plans import map_state as map_states
from citeloom.session import scratch_path
from citeloom.sources import readers as S, sinks as K

# An order is a feature that exists from its year to the year of its last shipment (every fifth is open-ended).
LIFE_SQL = """
life AS (
  SELECT o_orderkey AS id, o_orderpriority AS category, CAST(year(o_orderdate) AS INTEGER) AS "from",
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(max(year(l_shipdate)) AS INTEGER) END AS "to"
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)"""


def lifetimes(t: Tables):
    last = t.lineitem.groupBy("l_orderkey").agg(F.max(F.year("l_shipdate")).alias("ship"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("from"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("ship")).alias("to"))


@query("active_at", f"""
WITH {LIFE_SQL} SELECT id, category, "from", "to" FROM life
WHERE "from" <= 1997 AND ("to" IS NULL OR 1997 <= "to") AND category IN ('1-URGENT', '5-LOW')""")
def active_at(t: Tables):
    return G.visible(lifetimes(t), 1997, ["1-URGENT", "5-LOW"])


@query("retired_at", f"""
WITH {LIFE_SQL} SELECT id, "to" IS NOT NULL AND 1998 > "to" AS retired FROM life""")
def retired_at(t: Tables):
    return lifetimes(t).select("id", GF.retired_at(F.lit(1998), F.col("to")).alias("retired"))


@query("active_over_years", f"""
WITH {LIFE_SQL}, years AS (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS year)
SELECT id, category, year FROM life JOIN years ON "from" <= year AND ("to" IS NULL OR year <= "to")""")
def active_over_years(t: Tables):
    return G.active_over_years(lifetimes(t), 1995, 2001).select("id", "category", "year")


@query("active_counts", f"""
WITH {LIFE_SQL}, years AS (SELECT CAST(unnest(generate_series(1990, 2005)) AS INTEGER) AS year)
SELECT category, year, count(*) AS active FROM life JOIN years ON "from" <= year AND ("to" IS NULL OR year <= "to") GROUP BY ALL""")
def active_counts(t: Tables):
    return G.active_counts(lifetimes(t), "category", 1990, 2005)


_TYPES = ("crib", "reservoir", "lock", "dam", "wrp", "solids", "external-ps", "barrier", "", "industrial-intake", "water-ps")
_KINDS = ("river", "lake", "lake-tunnel", "conduit", "tarp", "water-supply", "interceptor", "intake", "sludge", "effluent", "marsh")
_GROUPS = ("historic", "shaft", "facility", "waterway", "tunnel", "connection", "connection")
_IDS = ("bp-", "citgo-", "north-tunnel-", "river-crossing-", "plain-")


def _pick(names, n):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def _pick_sql(names, n):
    return "([" + ", ".join(f"'{x}'" for x in names) + f"])[{n} % {len(names)} + 1]"


FEATURES_SQL = f"""
features AS (
  SELECT p_partkey AS id, {_pick_sql(_GROUPS, 'p_partkey')} AS grp,
    CASE WHEN p_partkey % 2 = 0 THEN {_pick_sql(_TYPES, 'p_size')} ELSE '' END AS type, {_pick_sql(_KINDS, 'p_partkey')} AS kind,
    {_pick_sql(_IDS, 'p_size')} || p_partkey AS fid FROM part),
categorised AS (
  SELECT id, CASE WHEN grp = 'historic' THEN 'historic' WHEN grp = 'shaft' THEN 'shafts'
    WHEN type <> '' THEN CASE WHEN type IN ('external-water', 'external-ps', 'external-wrp', 'industrial-intake') THEN 'external'
      WHEN type = 'reservoir' THEN 'reservoirs' WHEN type IN ('lock', 'dam', 'controlling-works', 'barrier') THEN 'control'
      WHEN type IN ('sewage-ps', 'wrp', 'solids') THEN 'fsewage' ELSE 'fwater' END
    WHEN kind IN ('river', 'canal', 'channel', 'lake-outline', 'lake', 'marsh') THEN 'waterways'
    WHEN kind IN ('lake-tunnel', 'land-tunnel') THEN 'watertun' WHEN kind IN ('conduit', 'tarp', 'diversion') THEN 'sewertun'
    WHEN kind = 'water-supply' THEN 'watersup'
    WHEN kind = 'interceptor' THEN CASE WHEN regexp_matches(fid, 'tunnel|crossing') THEN 'sewertun' ELSE 'sewerconn' END
    WHEN kind IN ('intake', 'stormwater') OR starts_with(fid, 'bp-') OR starts_with(fid, 'citgo-') THEN 'external' ELSE 'sewerconn' END AS category
  FROM features)"""


def categorised(t: Tables):
    n, size = F.col("p_partkey"), F.col("p_size")
    kind_of_point = F.when(n % 2 == 0, _pick(_TYPES, size)).otherwise("")
    fid = F.concat(_pick(_IDS, size), n.cast("string"))
    return t.part.select(n.alias("id"), GF.layer_category(_pick(_GROUPS, n), kind_of_point, _pick(_KINDS, n), fid).alias("category"))


@query("layer_category", f"WITH {FEATURES_SQL} SELECT id, category FROM categorised")
def layer_category(t: Tables):
    return categorised(t)


@query("layer_counts", f"""
WITH {FEATURES_SQL}
SELECT category, count(*) AS features, CAST(list_position([{', '.join(f"'{c}'" for c in GF.CATEGORIES)}], category) AS INTEGER) AS place
FROM categorised GROUP BY category""")
def layer_counts(t: Tables):
    return G.layer_counts(categorised(t))


# Lines: the first values of a vector are offsets of up to five points round a centre.
LINES_SQL = """
lines AS (
  SELECT vec_id AS id, vec_id % 7 = 0 AS traced, vec_id % 3 <> 0 AS approx, CAST(vec_id % 5 + 1 AS INTEGER) AS n,
    list_transform(range(0, vec_id % 5 + 1), lambda i: [41.8 + CAST(embedding[2 * i + 1] AS DOUBLE) / 10, -87.6 + CAST(embedding[2 * i + 2] AS DOUBLE) / 10]) AS g
  FROM embeddings)"""


def lines(t: Tables):
    n = (F.col("vec_id") % 5 + 1).cast("int")
    at = lambda i: F.element_at("embedding", i).cast("double")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(
        F.lit(41.8) + at(2 * i + 1) / 10, F.lit(-87.6) + at(2 * i + 2) / 10))
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7 == 0).alias("traced"),
                               (F.col("vec_id") % 3 != 0).alias("approx"), n.alias("n"), points.alias("geometry"))


@query("schematic_filter", f"""
WITH {LINES_SQL}
SELECT id, n FROM lines WHERE NOT traced AND approx AND n BETWEEN 2 AND 4
  AND sqrt(pow((g[-1][1] - g[1][1]) * 111, 2) + pow((g[-1][2] - g[1][2]) * 85, 2)) >= 3.0""")
def schematic_filter(t: Tables):
    return lines(t).filter(GF.is_schematic(F.col("traced"), F.col("approx"), F.col("geometry"))).select("id", "n")


@query("planar_km", f"""
WITH {LINES_SQL}
SELECT id, round(sqrt(pow((g[-1][1] - g[1][1]) * 111, 2) + pow((g[-1][2] - g[1][2]) * 85, 2)), 5) AS planar,
  round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(g[-1][1] - g[1][1]) / 2), 2)
    + cos(radians(g[1][1])) * cos(radians(g[-1][1])) * pow(sin(radians(g[-1][2] - g[1][2]) / 2), 2))), 5) AS great_circle FROM lines""")
def planar_km(t: Tables):
    a, b = GF._ends(F.col("geometry"))
    return lines(t).select("id", F.round(GF.planar_km(a[0], a[1], b[0], b[1]), 5).alias("planar"),
                           F.round(GF.haversine_km(a[0], a[1], b[0], b[1]), 5).alias("great_circle"))


@query("flow_direction", f"""
WITH {LINES_SQL}
SELECT id, pow(g[-1][1] - 41.81, 2) + pow(g[-1][2] + 87.59, 2) < pow(g[1][1] - 41.81, 2) + pow(g[1][2] + 87.59, 2) AS forward FROM lines""")
def flow_direction(t: Tables):
    return lines(t).select("id", GF.flows_forward(F.col("geometry"), F.lit(41.81), F.lit(-87.59)).alias("forward"))


@query("flow_at", f"""
WITH {LINES_SQL},
f AS (SELECT id, id % 25 AS k, CAST(1880 + id % 60 AS INTEGER) AS year, g FROM lines),
s AS (SELECT n_nationkey AS k, 0 AS ordinal, 1850 AS a, 1899 AS b, 41.8 + n_regionkey / 100.0 AS la, -87.6 AS ln FROM nation WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT n_nationkey, 1, 1890, NULL, 41.7, -87.6 + n_regionkey / 100.0 FROM nation WHERE n_nationkey % 3 <> 0)
SELECT id, k, year, ordinal, pow(g[-1][1] - CAST(la AS DOUBLE), 2) + pow(g[-1][2] - CAST(ln AS DOUBLE), 2) < pow(g[1][1] - CAST(la AS DOUBLE), 2) + pow(g[1][2] - CAST(ln AS DOUBLE), 2) AS forward
FROM f JOIN s USING (k) WHERE a <= year AND (b IS NULL OR year <= b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1""")
def flow_at(t: Tables):
    feats = lines(t).select(F.col("id").alias("fid"), (F.col("id") % 25).cast("int").alias("id"),
                            (F.col("id") % 60 + 1880).cast("int").alias("year"), "geometry")
    region = F.col("n_regionkey") / 100.0
    early = t.nation.filter("n_nationkey % 4 <> 0").select(
        F.col("n_nationkey").alias("id"), F.lit(0).alias("ordinal"), F.lit(1850).alias("from"), F.lit(1899).alias("to"),
        (F.lit(41.8) + region).alias("dest_lat"), F.lit(-87.6).alias("dest_lng"))
    late = t.nation.filter("n_nationkey % 3 <> 0").select(
        F.col("n_nationkey").alias("id"), F.lit(1).alias("ordinal"), F.lit(1890).alias("from"), F.lit(None).cast("int").alias("to"),
        F.lit(41.7).alias("dest_lat"), (F.lit(-87.6) + region).alias("dest_lng"))
    out = G.flow_at(feats, early.unionByName(late), F.col("year"))
    return out.select(F.col("fid").alias("id"), F.col("id").cast("bigint").alias("k"), "year", "ordinal", "forward")


@query("milestone_asof", """
WITH m AS (SELECT CAST(1900 + day(ts) * 3 AS INTEGER) AS year, event_id AS ordinal, event_type || event_id AS text FROM events WHERE day(ts) % 4 = 0),
q AS (SELECT o_orderkey AS id, CAST(1890 + o_orderkey % 120 AS INTEGER) AS year FROM orders),
d AS (SELECT year, arg_max(text, ordinal) AS text FROM m GROUP BY year)
SELECT id, q.year, coalesce(text, '') AS milestone FROM q ASOF LEFT JOIN d ON q.year >= d.year""")
def milestone_asof(t: Tables):
    day = F.dayofmonth("ts")
    marks = t.events.filter(day % 4 == 0).select((day * 3 + 1900).alias("year"), F.col("event_id").alias("ordinal"),
                                                 F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    asked = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 120 + 1890).cast("int").alias("year"))
    return G.milestone_asof(asked, marks).select("id", "year", "milestone")


@query("map_state", f"""
WITH {LINES_SQL},
f AS (
  SELECT 'historic' AS layer, 'p' || p_partkey AS id, 1850 + p_size AS a, CASE WHEN p_partkey % 5 <> 0 THEN 1890 + p_size END AS b, 'historic' AS category, NULL AS forward FROM part
  UNION ALL SELECT 'tunnel', CAST(id AS VARCHAR), 1860 + id % 70, CASE WHEN id % 6 = 0 THEN 1915 END, CASE WHEN id % 2 = 0 THEN 'sewertun' ELSE 'watertun' END,
    CASE WHEN id % 4 <> 0 THEN pow(g[-1][1] - 41.81, 2) + pow(g[-1][2] + 87.59, 2) < pow(g[1][1] - 41.81, 2) + pow(g[1][2] + 87.59, 2) END FROM lines),
m AS (SELECT 1900 + day(ts) * 3 AS year, event_id, event_type || event_id AS text FROM events WHERE day(ts) % 4 = 0)
SELECT layer, id, category, forward, (SELECT text FROM m WHERE year <= 1920 ORDER BY year DESC, event_id DESC LIMIT 1) AS milestone
FROM f WHERE a <= 1920 AND (b IS NULL OR 1920 <= b)""")
def map_state(t: Tables):
    """The map in 1920: what stands, of which category, which way it flows, and the milestone shown."""
    n, v = F.col("p_partkey"), F.col("id")
    historic = t.part.select(F.concat(F.lit("p"), n.cast("string")).alias("id"), (F.col("p_size") + 1850).alias("from"),
                             F.when(n % 5 != 0, F.col("p_size") + 1890).alias("to"))
    tunnels = lines(t).select(v.cast("string").alias("id"), (v % 70 + 1860).cast("int").alias("from"), F.when(v % 6 == 0, 1915).alias("to"),
                              F.when(v % 2 == 0, "tarp").otherwise("lake-tunnel").alias("kind"), "geometry")
    flows = lines(t).filter(v % 4 != 0).select(
        v.cast("string").alias("id"), F.lit(0).alias("ordinal"), F.lit(1850).alias("from"), F.lit(1930).alias("to"),
        F.lit(41.81).alias("dest_lat"), F.lit(-87.59).alias("dest_lng"))
    day = F.dayofmonth("ts")
    marks = t.events.filter(day % 4 == 0).select((day * 3 + 1900).alias("year"), F.col("event_id").alias("ordinal"),
                                                 F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    standing, shown = map_states.state_at(map_states.feature_table({"historic": historic, "tunnel": tunnels}), flows, marks, 1920)
    return standing.select("layer", "id", "category", "forward", shown.select("milestone").scalar().alias("milestone"))


@query("override_map", """
SELECT c_custkey AS id, CASE WHEN n_regionkey = 2 THEN 1850 ELSE c_nationkey + 1900 END AS year
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def override_map(t: Tables):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), (F.col("c_nationkey") + 1900).alias("year"))
    fixed = t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k"), F.lit(1850).alias("year"))
    return G.override(rows, fixed, "k", "year").select("id", "year")


@query("clamp_floor", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(greatest(year(o_orderdate) - 145, 1850) AS INTEGER) END AS "from" FROM orders""")
def clamp_floor(t: Tables):
    year = F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate") - 145)
    return t.orders.select(F.col("o_orderkey").alias("id"), G.clamp_floor(year).alias("from"))


SHAFTS_SQL = """
pts AS (SELECT vec_id, 41.8 + CAST(CAST(round(embedding[1] * 40) AS INTEGER) AS DOUBLE) / 400 + 0.0001 AS lat, -87.6 + CAST(CAST(round(embedding[2] * 40) AS INTEGER) AS DOUBLE) / 400 + 0.0001 AS lng, label FROM embeddings),
firsts AS (SELECT * FROM pts WHERE vec_id % 3 = 0), seconds AS (SELECT * FROM pts WHERE vec_id % 3 = 1), vents AS (SELECT * FROM pts WHERE vec_id % 3 = 2),
shafts AS (
  SELECT 'S' || vec_id AS id, 'Shaft No ' || vec_id AS name, lat, lng, 'drop-shaft' AS type, CAST(CASE WHEN vec_id % 2 = 0 THEN 1990 ELSE 1985 END AS INTEGER) AS "from",
    vec_id % 2 = 0 AS approx, 'from ' || label AS note FROM firsts
  UNION ALL SELECT 'news-shaft-no-' || vec_id, 'Shaft No ' || vec_id, lat, lng, 'drop-shaft', 1985, true, '' FROM seconds s
    WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE round(f.lat, 3) = round(s.lat, 3) AND round(f.lng, 3) = round(s.lng, 3))
  UNION ALL SELECT 'vent-shaft-no-' || vec_id, 'Shaft No ' || vec_id, lat, lng, 'air-vent', 1985, true, '' FROM vents)"""


def shaft_sources(t: Tables):
    def axis(i: int, base: float):
        steps = F.round(F.element_at("embedding", i) * 40).cast("int")
        return F.lit(base) + steps.cast("double") / 400 + 0.0001

    n = F.col("vec_id")
    pts = t.embeddings.select(n, axis(1, 41.8).alias("lat"), axis(2, -87.6).alias("lng"),
                              F.concat(F.lit("Shaft No "), n.cast("string")).alias("name"), "label")
    first = pts.filter(n % 3 == 0).select(
        F.concat(F.lit("S"), n.cast("string")).alias("id"), "name", "lat", "lng", F.when(n % 2 == 0, 1990).alias("from"),
        F.when(n % 2 == 0, True).alias("approx"), F.concat(F.lit("from "), F.col("label").cast("string")).alias("source"))
    other = pts.withColumn("source", F.lit(None).cast("string"))
    return first, other.filter(n % 3 == 1), other.filter(n % 3 == 2)


@query("spatial_cell_dedupe", f"WITH {SHAFTS_SQL} SELECT id, round(lat, 4) AS lat, round(lng, 4) AS lng FROM shafts")
def spatial_cell_dedupe(t: Tables):
    return G.merge_shafts(*shaft_sources(t)).select("id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


@query("normalise_shaft", f"""WITH {SHAFTS_SQL} SELECT id, name, type, "from", approx, note FROM shafts""")
def normalise_shaft(t: Tables):
    return G.merge_shafts(*shaft_sources(t)).select("id", "name", "type", "from", "approx", "note")


@query("cell_key", f"""
WITH {SHAFTS_SQL} SELECT round(lat, 3) AS lat, round(lng, 3) AS lng, count(*) AS points FROM pts GROUP BY ALL""")
def cell_key(t: Tables):
    a, b, c = shaft_sources(t)
    pts = a.select("lat", "lng").unionByName(b.select("lat", "lng")).unionByName(c.select("lat", "lng"))
    return pts.groupBy(GF.cell_key(F.col("lat"), F.col("lng")).alias("k")).agg(F.count(F.lit(1)).alias("points")).select("k.*", "points")


_XCHK = """
a AS (SELECT vec_id AS name, 41.8 + CAST(embedding[1] AS DOUBLE) / 50 AS lat, -87.6 + CAST(embedding[2] AS DOUBLE) / 50 AS lng,
  41.8 + CAST(embedding[3] AS DOUBLE) / 50 AS lat2, -87.6 + CAST(embedding[4] AS DOUBLE) / 50 AS lng2 FROM embeddings)"""
_HAV = """2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2)))"""


def _near(i: int, base: float):
    return F.lit(base) + F.element_at("embedding", i).cast("double") / 50


@query("geo_crosscheck", f"""
WITH {_XCHK}, d AS (SELECT name, {_HAV} AS km FROM a)
SELECT name, round(km, 5) AS km, CASE WHEN km < 0.1 THEN 'matches' WHEN km < 0.5 THEN 'close' ELSE 'off' END AS agreement FROM d""")
def geo_crosscheck(t: Tables):
    ours = t.embeddings.select(F.col("vec_id").alias("name"), _near(1, 41.8).alias("lat"), _near(2, -87.6).alias("lng"))
    theirs = t.embeddings.select(F.col("vec_id").alias("name"), _near(3, 41.8).alias("lat"), _near(4, -87.6).alias("lng"))
    return G.geo_crosscheck(ours, theirs).select("name", F.round("km", 5).alias("km"), "agreement")


@query("coordinate_sanity", f"""
WITH {_XCHK}, b AS (SELECT name, CASE WHEN name % 11 = 0 THEN 0.0 ELSE lat END AS lat, lng, CASE WHEN name % 13 = 0 THEN lat ELSE lat END AS lat2,
   CASE WHEN name % 13 = 0 THEN lat WHEN name % 2 = 0 THEN lng ELSE lng2 END AS lng2 FROM a)
SELECT name AS id, concat_ws(',', CASE WHEN lat2 = lng2 THEN 'lat-equals-lng' END, CASE WHEN NOT (lat BETWEEN 41 AND 43 AND lng BETWEEN -89 AND -87) THEN 'outside-box' END,
  CASE WHEN {_HAV} > 0.01 THEN 'attribute-drift' END) AS flags FROM b""")
def coordinate_sanity(t: Tables):
    n, lat, lng = F.col("vec_id"), _near(1, 41.8), _near(2, -87.6)
    pts = t.embeddings.select(
        n.alias("id"), F.when(n % 11 == 0, 0.0).otherwise(lat).alias("lat"), lng.alias("lng"), lat.alias("attr_lat"),
        F.when(n % 13 == 0, lat).when(n % 2 == 0, lng).otherwise(_near(4, -87.6)).alias("attr_lng"))
    return G.coordinate_sanity(pts).select("id", F.array_join("flags", ",").alias("flags"))


@query("patch_corrections", """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 41.5 ELSE CAST(s_nationkey AS DOUBLE) END AS lat,
  CASE WHEN s_suppkey % 8 = 0 THEN -87.5 ELSE -CAST(s_nationkey AS DOUBLE) END AS lng FROM supplier""")
def patch_corrections(t: Tables):
    n, k = F.col("s_suppkey"), F.col("s_nationkey").cast("double")
    stations = t.supplier.select(n.alias("id"), k.alias("lat"), (-k).alias("lng"))
    fixes = t.supplier.filter(n % 4 == 0).select(n.alias("id"), F.struct(
        F.lit(41.5).alias("lat"), F.when(n % 8 == 0, -87.5).alias("lng")).alias("corrections"))
    return G.patch_corrections(stations, fixes)


_LAYERS_SQL = """
layers AS (SELECT 'customers' AS layer, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'suppliers', s_name, s_nationkey, NULL FROM supplier UNION ALL SELECT 'nations', n_name, n_nationkey, NULL FROM nation)"""


def layers(t: Tables):
    return G.union_layers({
        "customers": t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
        "suppliers": t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        "nations": t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")),
    })


@query("union_layers", f"WITH {_LAYERS_SQL} SELECT layer, name, nation, segment FROM layers")
def union_layers(t: Tables):
    return layers(t).select("layer", "name", "nation", "segment")


@query("bundle_counts", f"WITH {_LAYERS_SQL} SELECT layer, count(*) AS features FROM layers GROUP BY layer")
def bundle_counts(t: Tables):
    return G.bundle_counts(layers(t))


@query("sink_layers", f"WITH {_LAYERS_SQL} SELECT layer, count(*) AS features FROM layers GROUP BY layer")
def sink_layers(t: Tables):
    """Counts of the layers after they were written, one folder each."""
    path = scratch_path(t.spark, "layers")
    K.write_layers(layers(t), path)
    return G.bundle_counts(t.spark.read.parquet(path))


_CODES_SQL = """
codes AS (SELECT p_partkey AS id, p_brand AS owner, p_size, CASE p_partkey % 6 WHEN 0 THEN 'DS-M' || p_size || ' & DS-M' || (p_size + 1) || ' (NBPS)' WHEN 1 THEN 'Indirect (DS-M' || p_size || ')'
  WHEN 2 THEN 'I-' || p_size WHEN 3 THEN 'CDS-' || p_size || ' (E)' WHEN 4 THEN 'Wilmette Gate' ELSE 'TG-' || p_size END AS code FROM part)"""


def codes(t: Tables):
    n, s = F.col("p_partkey"), F.col("p_size").cast("string")
    code = (
        F.when(n % 6 == 0, F.concat(F.lit("DS-M"), s, F.lit(" & DS-M"), (F.col("p_size") + 1).cast("string"), F.lit(" (NBPS)")))
        .when(n % 6 == 1, F.concat(F.lit("Indirect (DS-M"), s, F.lit(")"))).when(n % 6 == 2, F.concat(F.lit("I-"), s))
        .when(n % 6 == 3, F.concat(F.lit("CDS-"), s, F.lit(" (E)"))).when(n % 6 == 4, "Wilmette Gate").otherwise(F.concat(F.lit("TG-"), s)))
    return t.part.select(n.alias("id"), F.col("p_brand").alias("owner"), "p_size", code.alias("raw"))


_SPLIT_SQL = """
split AS (
  SELECT id, owner, p_size, 'DS-M' || p_size AS code, '' AS qualifier FROM codes WHERE id % 6 = 0
  UNION ALL SELECT id, owner, p_size, 'DS-M' || (p_size + 1), 'NBPS' FROM codes WHERE id % 6 = 0
  UNION ALL SELECT id, owner, p_size, 'DS-M' || p_size, 'Indirect' FROM codes WHERE id % 6 = 1
  UNION ALL SELECT id, owner, p_size, 'CDS-' || p_size, 'E' FROM codes WHERE id % 6 = 3
  UNION ALL SELECT id, owner, p_size, code, '' FROM codes WHERE id % 6 IN (2, 4, 5))"""


@query("code_list_split", f"WITH {_CODES_SQL}, {_SPLIT_SQL} SELECT id, code, qualifier FROM split")
def code_list_split(t: Tables):
    return G.split_codes(codes(t), "raw").select("id", "code", "qualifier")


@query("code_prefix_breakdown", f"""
WITH {_CODES_SQL}, {_SPLIT_SQL}
SELECT CASE WHEN code = 'Wilmette Gate' THEN code ELSE split_part(code, '-', 1) END AS prefix, owner, count(*) AS features,
  count(*) FILTER (WHERE p_size % 2 = 0) AS monitored FROM split GROUP BY ALL""")
def code_prefix_breakdown(t: Tables):
    return G.code_breakdown(G.split_codes(codes(t), "raw"), "code", "owner", F.col("p_size") % 2 == 0)


@query("normalise_connection", """
SELECT 'c' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey ELSE s_name END AS name, 'sludge' AS kind,
  CASE WHEN s_suppkey % 2 = 0 THEN 1850 ELSE CAST(1900 + s_nationkey AS INTEGER) END AS "from",
  CASE WHEN s_nationkey = 0 THEN NULL ELSE CAST(s_nationkey AS INTEGER) END AS "to",
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'note ' END || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '(' || s_name || ')' END AS note FROM supplier""")
def normalise_connection(t: Tables):
    """Connection records as JSON, read as a layer, then normalised."""
    n = F.col("s_suppkey")
    record = F.struct(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.lit("sludge").alias("kind"),
        F.when(n % 2 == 1, F.col("s_nationkey") + 1900).when(n % 4 == 0, 0).alias("from"), F.col("s_nationkey").alias("to"), F.lit(True).alias("approx"),
        F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("waypoints"), F.when(n % 3 == 0, "").otherwise(F.col("s_name")).alias("label"),
        F.when(n % 7 == 0, "").otherwise(F.col("s_name")).alias("source"), F.when(n % 5 != 0, "note").alias("note"))
    rows = _layer_files(t, t.supplier.select(F.floor(n / 500).alias("part"), record.alias("f")), "connections")
    return G.normalise_connections(rows).select("id", "name", "kind", "from", "to", "note")


def _layer_files(t: Tables, features, member: str):
    """Features as layer files of one object each: one file per part, read back with the layer reader."""
    from citeloom import schemas

    path = scratch_path(t.spark, "layer")
    docs = features.groupBy("part").agg(F.concat(F.lit(f'{{"{member}":'), F.to_json(F.collect_list("f")), F.lit("}")).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)
    return S.scan_json_layer(t.spark, path, member, schemas.CONNECTION)


@query("scan_json_layers", """
SELECT 'c' || s_suppkey AS id, s_name AS label, CAST(s_nationkey AS INTEGER) AS "from", CAST(s_suppkey % 2 AS INTEGER) AS points FROM supplier""")
def scan_json_layers(t: Tables):
    """Half of the features as a bare array, half under a member, and one layer that does not exist."""
    from citeloom import schemas

    n = F.col("s_suppkey")
    point = F.array(F.lit(41.0), F.lit(-87.0))
    rows = t.supplier.select(n, F.struct(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("from"),
        F.when(n % 2 == 1, F.array(point)).otherwise(F.array().cast("array<array<double>>")).alias("waypoints")).alias("f"))
    bare_path, held_path = scratch_path(t.spark, "bare"), scratch_path(t.spark, "held")
    part = F.floor(n / 500).alias("part")
    listed = F.to_json(F.collect_list("f"))
    rows.filter(n % 3 == 0).groupBy(part).agg(listed.alias("value")).repartition("part").write.partitionBy("part").text(bare_path)
    rows.filter(n % 3 != 0).groupBy(part).agg(F.concat(F.lit('{"connections":'), listed, F.lit("}")).alias("value")) \
        .repartition("part").write.partitionBy("part").text(held_path)
    all_rows = S.scan_json_layer(t.spark, bare_path, "connections", schemas.CONNECTION).unionByName(
        S.scan_json_layer(t.spark, held_path, "connections", schemas.CONNECTION)).unionByName(
        S.scan_json_layer(t.spark, held_path + "-missing", "connections", schemas.CONNECTION))
    return all_rows.select("id", "label", "from", F.size("waypoints").alias("points"))


@query("scan_geojson", """
SELECT round(41.8 + CAST(embedding[2] AS DOUBLE), 5) AS lat, round(-87.6 + CAST(embedding[1] AS DOUBLE), 5) AS lng, 'at ' || vec_id AS location,
  CASE WHEN label % 2 = 0 THEN 'DS-' || vec_id ELSE '' END AS tarp, 'o' || label AS owner, '' AS reach FROM embeddings""")
def scan_geojson(t: Tables):
    """Feature collections written per label, coordinates as [lng, lat]."""
    at = lambda i, base: F.lit(base) + F.element_at("embedding", i).cast("double")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("vec_id").alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array(at(1, -87.6), at(2, 41.8)).alias("coordinates")).alias("geometry"),
        F.struct(F.concat(F.lit("at "), F.col("vec_id").cast("string")).alias("LOCATION"),
                 F.when(F.col("label") % 2 == 0, F.concat(F.lit("DS-"), F.col("vec_id").cast("string"))).alias("TARP_CONNECTION"),
                 F.concat(F.lit("o"), F.col("label").cast("string")).alias("OWNER")).alias("properties"))
    path = scratch_path(t.spark, "geojson")
    docs = t.embeddings.select(F.floor(F.col("vec_id") / 500).alias("part"), feature.alias("f")).groupBy("part").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":'), F.to_json(F.collect_list("f")), F.lit("}")).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)
    return S.scan_geojson_outfalls(t.spark, path)

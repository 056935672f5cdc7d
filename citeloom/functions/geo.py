"""Expressions over map features: validity, category, geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Feature types and kinds per category, in the order in which the rules apply.
EXTERNAL_TYPES = ("external-water", "external-ps", "external-wrp", "industrial-intake")
CONTROL_TYPES = ("lock", "dam", "controlling-works", "barrier")
SEWAGE_TYPES = ("sewage-ps", "wrp", "solids")
WATERWAY_KINDS = ("river", "canal", "channel", "lake-outline", "lake", "marsh")
WATER_TUNNEL_KINDS = ("lake-tunnel", "land-tunnel")
SEWER_TUNNEL_KINDS = ("conduit", "tarp", "diversion")
OUTSIDE_KINDS = ("intake", "stormwater")
OUTSIDE_ID_PREFIXES = ("wilmette-lake", "wilmette-village", "nswrd-", "bp-", "hammond-", "citgo-", "state-line-")

# Categories in display order.
CATEGORIES = (
    "waterways", "historic", "watertun", "watersup", "sewertun", "shafts", "sewerconn", "fwater", "fsewage",
    "reservoirs", "control", "external",
)

# Km per degree near the archive's latitude, least length of a schematic line, earth radius, floor year.
KM_PER_LAT, KM_PER_LNG, SCHEMATIC_KM, EARTH_KM, FLOOR_YEAR = 111.0, 85.0, 3.0, 6371.0088, 1850


def active_at(year: Column, start: Column, end: Column) -> Column:
    """Closed interval; an open end means still there."""
    return (start <= year) & (end.isNull() | (year <= end))


def retired_at(year: Column, active_to: Column) -> Column:
    """Standing but out of use. A missing (or zero) year never retires."""
    return F.coalesce((active_to != 0) & (year > active_to), F.lit(False))


def layer_category(group: Column, kind_of_point: Column, kind: Column, feature_id: Column) -> Column:
    """Display category. Group comes first, then the point type, then the line kind; order is meaning."""
    t, k, fid = F.coalesce(kind_of_point, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(feature_id, F.lit(""))
    outside = k.isin(*OUTSIDE_KINDS)
    for prefix in OUTSIDE_ID_PREFIXES:
        outside = outside | fid.startswith(prefix)
    tunnel_like = (fid == "") | fid.rlike("tunnel|crossing")
    point = (
        F.when(t.isin(*EXTERNAL_TYPES), "external").when(t == "reservoir", "reservoirs")
        .when(t.isin(*CONTROL_TYPES), "control").when(t.isin(*SEWAGE_TYPES), "fsewage").otherwise("fwater")
    )
    line = (
        F.when(k.isin(*WATERWAY_KINDS), "waterways").when(k.isin(*WATER_TUNNEL_KINDS), "watertun")
        .when(k.isin(*SEWER_TUNNEL_KINDS), "sewertun").when(k == "water-supply", "watersup")
        .when(k == "interceptor", F.when(tunnel_like, "sewertun").otherwise("sewerconn"))
        .when(outside, "external").otherwise("sewerconn")
    )
    return F.when(group == "historic", "historic").when(group == "shaft", "shafts").when(t != "", point).otherwise(line)


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("int")


def planar_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.hypot((lat2 - lat1) * KM_PER_LAT, (lng2 - lng1) * KM_PER_LNG)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(chord))


def _ends(geometry: Column) -> tuple[Column, Column]:
    return F.get(geometry, F.lit(0)), F.get(geometry, F.size(geometry) - 1)


def is_schematic(traced: Column, approx: Column, geometry: Column) -> Column:
    """An approximate, untraced line of 2 to 4 points whose ends are far apart."""
    a, b = _ends(geometry)
    far = planar_km(a[0], a[1], b[0], b[1]) >= SCHEMATIC_KM
    no = F.lit(False)
    return (~F.coalesce(traced, no)) & F.coalesce(approx, no) & F.coalesce(F.size(geometry).between(2, 4) & far, no)


def flows_forward(geometry: Column, dest_lat: Column, dest_lng: Column) -> Column:
    """Whether the last point is strictly nearer to the destination than the first (squared degrees)."""
    a, b = _ends(geometry)

    def squared(p: Column) -> Column:
        return (p[0] - dest_lat) * (p[0] - dest_lat) + (p[1] - dest_lng) * (p[1] - dest_lng)

    return squared(b) < squared(a)


def cell_key(lat: Column, lng: Column, digits: int = 3) -> Column:
    """Grid cell of a point: both coordinates rounded."""
    return F.struct(F.round(lat, digits).alias("lat"), F.round(lng, digits).alias("lng"))


def code_parts(code: Column) -> Column:
    """``A & B (X)`` and ``Indirect (A)`` → array of struct(code, qualifier).

    A bracket qualifies the code before it, except after the word Indirect, which qualifies the code in it.
    """
    parts = F.filter(F.split(F.btrim(code), r"\s*&\s*"), lambda p: p != "")

    def parse(part: Column) -> Column:
        inside = F.regexp_extract(part, r"\(([^)]*)\)", 1)
        before = F.btrim(F.regexp_replace(part, r"\([^)]*\)", ""))
        indirect = F.lower(before) == "indirect"
        return F.struct(F.when(indirect & (inside != ""), inside).otherwise(before).alias("code"),
                        F.when(indirect, F.lit("Indirect")).otherwise(inside).alias("qualifier"))

    return F.transform(parts, parse)


def code_prefix(code: Column) -> Column:
    """Letters before the first hyphen and digit of a structure code; the whole code when it has no such shape."""
    head = F.regexp_extract(code, r"^([A-Z]+)(?:-|$)", 1)
    return F.when(head != "", head).otherwise(code)

"""Scalar column functions: text keys, missing values, rounding, forestry formulas, terrain and hexagon geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tariff line constants and the height-diameter tariff, fixed values of the method.
TARIFF_E, TARIFF_K, TARIFF_C, TARIFF_D = 0.0360541, 0.315049301, 0.138763302, 0.118288
HEIGHT_TARIFF = (8.292030, 1.771173, -0.416509)

#: Form factor of each species code and the spellings that mean it, fixed values of the method.
FORM_FACTORS = {"SS": 0.42, "NS": 0.42, "SP": 0.43, "DF": 0.44, "LP": 0.41, "EL": 0.40, "JL": 0.40, "HL": 0.40}
SPELLINGS = {
    "SS": ("ss", "sitka", "sitka spruce"),
    "NS": ("ns", "norway", "norway spruce"),
    "SP": ("sp", "scots", "scots pine", "scotspine"),
    "DF": ("df", "douglas", "douglas fir"),
    "LP": ("lp", "lodgepole", "lodgepole pine"),
    "EL": ("el", "european larch"),
    "JL": ("jl", "japanese larch", "larch"),
    "HL": ("hl", "hybrid larch"),
}

# --- text and missing values


def unquote(text: Column) -> Column:
    """Trimmed text without one pair of quotes around it."""
    return F.trim(F.regexp_replace(F.trim(text), "^['\"]|['\"]$", ""))


def match_key(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.\-]+", "_")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def first_filled(*texts: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def number_or_null(text: Column) -> Column:
    """A double; blanks and the usual words for missing are null, NaN too."""
    clean = F.lower(F.trim(text))
    value = F.when(~clean.isin("", "na", "nan", "none", "null"), clean).try_cast("double")
    return F.when(~F.isnan(value), value)


def feed_file_parts(name: Column) -> dict[str, Column]:
    """Machine, time and type from names like ``123_20240131_120000.hpr``; null parts if the name has another form."""
    pattern = r"^(\d+)_(\d{8})_(\d{6})\.(\w+)$"
    group = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return {"machine": group(1), "file_time": F.try_to_timestamp(F.concat(group(2), group(3)), F.lit("yyyyMMddHHmmss")), "file_type": F.nullif(extension(name), F.lit(""))}


def folded_species(name: Column) -> Column:
    """Spruces fold into one name; other species stay as they are."""
    low = F.lower(F.trim(name))
    return F.when(low.contains("spruce") | low.isin("ss", "ns"), F.lit("spruce")).otherwise(low)


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _looked_up(key: Column, values: dict) -> Column:
    """The value of a key in a small table of constants; null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def species_code(label: Column) -> Column:
    """Code of a species by any of its spellings; null for other labels."""
    return _looked_up(F.lower(stripped(label)), {name: code for code, names in SPELLINGS.items() for name in names})


def form_factor(label: Column, default: float = 0.42) -> Column:
    """Form factor of a species by its label; ``default`` for labels that are unknown or null."""
    return F.coalesce(_looked_up(species_code(label), FORM_FACTORS), F.lit(default))


def path_key(path: Column, host: str = "amazonaws.com/") -> Column:
    """Key of a stored object from a bare key, a bucket path or a URL of ``host``; null if there is none."""
    text = stripped(path)
    bucket = F.when(F.locate("/", text, 6) > 0, F.substr(text, F.locate("/", text, 6) + 1))
    hosted = F.when(F.instr(text, host) > 0, F.substr(text, F.instr(text, host) + len(host)))
    return F.when(text.startswith("s3://"), bucket).otherwise(F.coalesce(hosted, F.nullif(F.ltrim(text, F.lit("/")), F.lit(""))))


def last_line_json(text: Column, schema: str) -> Column:
    """The last line of a log as a record; null if it is none."""
    return F.from_json(F.element_at(F.split(stripped(text), "\n"), -1), schema)


def appended(values: Column, value: Column) -> Column:
    """A list with a value at its end unless the list has it or the value is null or empty; a null list counts as empty."""
    known = F.coalesce(values, F.array().cast("array<string>"))
    text = value.cast("string")
    return F.when((F.coalesce(text, F.lit("")) == "") | F.array_contains(known, F.coalesce(text, F.lit(""))), known).otherwise(F.concat(known, F.array(text)))


def addressed_to(addresses: Column, marker: str) -> Column:
    """Whether any address begins with a marker; false without addresses."""
    return F.coalesce(F.exists(addresses, lambda a: F.coalesce(a.startswith(marker), F.lit(False))), F.lit(False))


def utc_hour(time: Column) -> Column:
    """Hour of the day in UTC, whatever the session's time zone."""
    return F.pmod(F.floor(F.unix_seconds(time) / 3600), F.lit(24)).cast("int")


def machine_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("harvest"), "harvester").when(low.rlike("forward"), "forwarder").when(low.rlike("skid"), "skidder").otherwise("other")


def truncated(text: Column, limit: int = 500) -> Column:
    return F.substring(text, 1, limit)


# --- numbers


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Ties go up, also below zero."""
    factor = 10.0**digits
    return F.floor(value * factor + 0.5) / factor


def round_half_even(value: Column, digits: int = 0) -> Column:
    factor = 10.0**digits
    return F.rint(value * factor) / factor


def cell_of(value: Column, size: float, origin: float = 0.0) -> Column:
    """Grid index by flooring, right for negative coordinates."""
    return F.floor((value - origin) / size).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def linear_score(value: Column, worst: float, best: float) -> Column:
    """0 at ``worst``, 1 at ``best``, linear between and clipped outside."""
    return clamp((value - worst) / (best - worst), 0.0, 1.0)


def bearing(dy: Column, dx: Column) -> Column:
    """Angle of a vector in degrees from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


# --- trees


def basal_area(dbh_cm: Column) -> Column:
    return dbh_cm * dbh_cm * math.pi / 40000.0


def tariff_volume(tariff: Column, area: Column) -> Column:
    """Stem volume on the tariff line at a basal area."""
    slope = (tariff - TARIFF_C) * TARIFF_K
    return tariff * TARIFF_E - slope * TARIFF_D + slope * area


def tariff_number(volume: Column, area: Column) -> Column:
    """The tariff whose line meets a volume at a basal area; null where the line is flat there."""
    gap = area - TARIFF_D
    below = gap * TARIFF_K + TARIFF_E
    return F.when(F.abs(below) >= 1e-12, F.try_divide(volume + gap * (TARIFF_K * TARIFF_C), below))


def height_tariff(height_m: Column, dbh_cm: Column) -> Column:
    a, b, c = HEIGHT_TARIFF
    return height_m * b + a + dbh_cm * c


def form_volume(dbh_cm: Column, height_m: Column, form: Column) -> Column:
    return basal_area(dbh_cm) * height_m * form


# --- terrain and hexagons


def slope_degrees(gx: Column, gy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))


def aspect_degrees(gx: Column, gy: Column) -> Column:
    """Direction of steepest descent, clockwise from north."""
    return F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0))


def hex_radius(area: float) -> float:
    return math.sqrt(area / (1.5 * math.sqrt(3.0)))


def hex_cell(x: Column, y: Column, area: float) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon that holds a point: cube rounding, ties to even."""
    radius = hex_radius(area)
    q, r = (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / radius, (y * (2.0 / 3.0)) / radius
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fixed_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fixed_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return fixed_q.cast("long"), fixed_r.cast("long")


def hex_ring(q: Column, r: Column, area: float) -> Column:
    """Closed ring of seven corners of a hexagon."""
    radius = hex_radius(area)
    cx, cy = (q + r / 2.0) * (radius * math.sqrt(3.0)), r * (radius * 1.5)
    angle = lambda i: F.radians(i * 60.0 + 30.0)
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.array(cx + F.cos(angle(i % 6)) * radius, cy + F.sin(angle(i % 6)) * radius))


def grid_reference(easting: Column, northing: Column) -> Column:
    """Two letters and two digits of a 10 km square of the national grid; null outside it."""
    e, n = F.floor(easting / 100000).cast("int"), F.floor(northing / 100000).cast("int")
    first = (19 - n) - (19 - n) % 5 + F.floor((e + 10) / 5).cast("int")
    second = (19 - n) * 5 % 25 + e % 5
    letter = lambda i: F.substr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), (i + 1).cast("int"), F.lit(1))
    inside = (easting >= 0) & (easting < 700000) & (northing >= 0) & (northing < 1300000)
    digit = lambda v: F.floor(F.pmod(v, F.lit(100000)) / 10000).cast("int").cast("string")
    return F.when(inside, F.concat(letter(first), letter(second), digit(easting), digit(northing)))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre, on a plane."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(lat0)), (lat - lat0) * 111320.0


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    radius = 6378137.0
    return F.radians(lon) * radius, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * radius


def hue_colour(hue: Column) -> Column:
    """Full-saturation colour of a hue from 0 to 1 as array<int> of red, green and blue up to 65535."""
    part = lambda centre: clamp(2.0 - F.abs(F.pmod(hue * 6.0 - centre + 3.0, F.lit(6.0)) - 3.0), 0.0, 1.0)
    return F.array(*((part(c) * 65535.0).cast("int") for c in (0.0, 2.0, 4.0)))


def hsv_colour(hue: Column, saturation: Column, value: Column) -> Column:
    """Colour of hue, saturation and value, each from 0 to 1, as array<int> up to 65535."""
    full = lambda centre: clamp(2.0 - F.abs(F.pmod(hue * 6.0 - centre + 3.0, F.lit(6.0)) - 3.0), 0.0, 1.0)
    return F.array(*((value * (1.0 - saturation + saturation * full(c)) * 65535.0).cast("int") for c in (0.0, 2.0, 4.0)))


def golden_colour(number: Column) -> Column:
    """Distinct colours for whole numbers: the hue moves on by the golden ratio."""
    return hue_colour(F.pmod(number * 0.6180339887498949, F.lit(1.0)))


def palette_colour(place: Column, size: Column) -> Column:
    """Colour at a place, from 0, of a palette of evenly spaced hues; saturation alternates, every third is darker."""
    return hsv_colour(place / F.greatest(size, F.lit(1)), F.when(place % 2 == 0, 0.9).otherwise(0.6), F.when(place % 3 != 0, 0.9).otherwise(0.7))


def diagnostic_colour(crown: Column, dense: Column, final: Column) -> Column:
    """Colour of a point by what became of it: green kept, grey too sparse, blue in no crown, red taken out later."""
    colour = lambda *parts: F.array(*map(F.lit, parts))
    return F.when(dense & (final > 0), colour(0, 65535, 0)).when(~dense, colour(32767, 32767, 32767)).when(crown == 0, colour(0, 0, 65535)).otherwise(colour(65535, 0, 0))


def bounding_box(rings: Column) -> Column:
    """Extent of a polygon's rings, array<array<array<double>>>, as a struct; null without a corner."""
    corners = F.flatten(rings)
    along = lambda i: F.transform(corners, lambda p: p[i])
    x, y = along(0), along(1)
    box = F.struct(F.array_min(x).alias("x_min"), F.array_min(y).alias("y_min"), F.array_max(x).alias("x_max"), F.array_max(y).alias("y_max"))
    return F.when(F.size(corners) > 0, box)

"""Column functions on settings, checks and the texts that name them."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.scalars import clamp, round_half_up, smoothstep, width_factor, wrap

# Bottom shapes, ranges and defaults of the terrain settings, whole-numbered settings, ranges of the grid's settings, and the simple controls' defaults.
PROFILES = ("even-slope", "smooth-basin", "broad-shelf", "stepped-benches")
RANGES = {
    "maxDepth": (0.01, 1), "bankSteepness": (0, 1), "shelfWidth": (0, 0.6), "terraceStrength": (0, 1), "terraceLevels": (2, 12), "noiseAmplitude": (0, 1), "featureScale": (0.02, 2),
    "octaves": (1, 8), "roughness": (0, 1), "ridged": (0, 1), "warpStrength": (0, 2), "grainStrength": (0, 1), "bodyScaleExponent": (0, 2), "minBodyCells": (1, 1_000_000),
}
WHOLE = ("terraceLevels", "octaves", "minBodyCells")
GRID_RANGES = {"cellMm": (0.05, 20), "minCellsLongSide": (8, 1024), "maxCellsLongSide": (8, 2048)}
SIMPLE = {"seed": 1.0, "profile": "smooth-basin", "maxDepth": 1.0, "character": 0.4, "bankSteepness": 0.5, "weave": 0.0, "weaveAngleDeg": 0.0, "terracing": 0.0}
OFFSETS = {"xfine": (1, 3, 7, 12, 19), "fine": (2, 6, 13, 22, 34), "narrow": (2.5, 7.5, 16, 27, 41), "normal": (3, 9, 20, 25, 30), "wide": (5, 14, 30, 49, 73)}
DESIGN_WIDTH = 500
TIERS = ("low", "medium", "high")
LAYERS = ("water", "transportation")
NEAR = 1e-6
#: A cap's tolerance at most, its share of the half width, and the tolerance of simplified roads at most.
ARC, SAGITTA, ROAD = 0.02, 0.019, 0.01


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def or_else(x: Column, default) -> Column:
    """A finite number, or the default."""
    return F.when(finite(x), x).otherwise(default if isinstance(default, Column) else F.lit(default))


def is_profile(name: Column) -> Column:
    return F.coalesce(name.isin(*PROFILES), F.lit(False))


def seed(x: Column) -> Column:
    """A number's whole part modulo 2^32."""
    return wrap(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"), F.lit(4294967296))


def grain_angle(degrees: Column) -> Column:
    return wrap(degrees, F.lit(180.0))


def terrain_setting(name: str, x: Column, default: float) -> Column:
    """A setting in its range; whole-numbered ones are rounded."""
    low, high = RANGES.get(name) or GRID_RANGES[name]
    value = clamp(or_else(x.cast("double"), float(default)), float(low), float(high))
    return round_half_up(value) if name in WHOLE or name.endswith("LongSide") else value


def simple_controls(controls: Column) -> dict[str, Column]:
    """The terrain settings that eight simple controls stand for, as columns by name."""
    unit = lambda k: clamp(or_else(controls[k].cast("double"), SIMPLE[k]), 0.0, 1.0)
    character, bank, weave = unit("character"), unit("bankSteepness"), unit("weave")
    made = {
        "maxDepth": or_else(controls["maxDepth"], SIMPLE["maxDepth"]), "bankSteepness": bank, "shelfWidth": 0.22 * (1 - bank), "terraceStrength": unit("terracing"), "terraceLevels": F.lit(6.0),
        "noiseAmplitude": 0.2 + 0.6 * character, "featureScale": (0.22 - 0.1 * character) * (1 - 0.4 * weave), "octaves": 3 + round_half_up(3 * character), "roughness": 0.4 + 0.2 * character,
        "ridged": 0.7 * smoothstep(clamp((character - 0.4) / 0.6, 0.0, 1.0)), "warpStrength": (0.2 + 0.8 * character) * (1 - 0.4 * weave), "grainStrength": 0.85 * weave, "bodyScaleExponent": F.lit(0.5),
    }
    out = {k: terrain_setting(k, v, 0.0) for k, v in made.items()}
    out["seed"] = seed(or_else(controls["seed"].cast("double"), SIMPLE["seed"]))
    out["profile"] = F.when(is_profile(controls["profile"]), controls["profile"]).otherwise(SIMPLE["profile"])
    out["grainAngleDeg"] = grain_angle(or_else(controls["weaveAngleDeg"].cast("double"), SIMPLE["weaveAngleDeg"]))
    return out


def depth_levels(thresholds: Column) -> Column:
    """Thresholds sorted and without repeats; null if there is none or one outside (0, 1]."""
    bad = F.exists(thresholds, lambda t: ~finite(t) | (t <= 0) | (t > 1))
    return F.when((F.size(thresholds) > 0) & ~bad, F.array_sort(F.array_distinct(thresholds)))


def even_levels(panels: Column) -> Column:
    """(j + 1.5) / (panels + 1) for each panel."""
    return F.transform(F.when(panels > 0, F.sequence(F.lit(0), panels - 1)).otherwise(F.array().cast("array<int>")), lambda j: (j + 1.5) / (panels + 1))


def preset_offsets(name: Column, custom: Column) -> Column:
    """A named preset's offsets; the custom ones for any other name."""
    out = custom
    for k, v in OFFSETS.items():
        out = F.when(name == k, F.array(*(F.lit(float(x)) for x in v))).otherwise(out)
    return out


def tier_visible(tier: Column, detail: Column) -> Column:
    order = F.array(*map(F.lit, TIERS))
    return F.array_position(order, tier) <= F.array_position(order, detail)


def missing_layers(layers: Column, needed: tuple[str, ...] = LAYERS) -> Column:
    """Needed layers that a source lacks; null if it names none."""
    return F.array_except(F.array(*map(F.lit, needed)), layers)


def same_view(a: Column, b: Column) -> Column:
    """Whether two views (lng, lat, zoom, radius, detail) agree, up to a millionth."""
    close = lambda k: F.abs(a[k] - b[k]) <= NEAR
    return close("lng") & close("lat") & close("zoom") & close("radius") & (a["detail"] == b["detail"])


def unready(snapshot: Column, now: Column, placed: Column, problems: Column, text_problems: Column) -> Column:
    """The codes of what keeps a product from export."""
    stale = snapshot.isNotNull() & ~same_view(snapshot, now)
    reasons = ((problems > 0, "geometry-invalid"), (text_problems > 0, "text-invalid"), (~placed, "no-place"), (snapshot.isNull(), "no-snapshot"), (stale, "snapshot-stale"))
    return F.array_compact(F.array(*(F.when(when, F.lit(code)) for when, code in reasons)))


def chord_half_width(y: Column, radius: Column) -> Column:
    return F.sqrt(F.greatest(radius * radius - y * y, F.lit(0.0)))


def hanging_loop(diameter: Column, outer: Column, inner: Column, overlap: Column, least: Column) -> Column:
    """Where a loop joins a disk: (centre_y, annulus, junction, meets, connected)."""
    radius, r = diameter / 2, outer / 2
    centre = -radius + overlap - r
    d = F.abs(centre)
    meets = (d < radius + r) & (d > F.abs(radius - r)) & (d > 0)
    x = (d * d + radius * radius - r * r) / F.nullif(2 * d, F.lit(0.0))
    junction = F.when(meets, 2 * chord_half_width(x, radius)).otherwise(0.0)
    annulus = r - inner / 2
    return F.struct(centre.alias("centre_y"), annulus.alias("annulus"), junction.alias("junction"), meets.alias("meets"), (meets & (junction >= least) & (annulus >= least)).alias("connected"))


def board_width_factor(width: Column, height: Column, thickness: Column) -> Column:
    """By how much a board widens its roads: as a disk of its shorter side, times the thickness."""
    return width_factor(F.least(width, height)) * F.when(thickness > 0, thickness).otherwise(1.0)


def cap_tolerance(half_width: Column) -> Column:
    return F.least(F.lit(ARC), F.greatest(F.lit(1e-4), half_width * SAGITTA))


def road_tolerance(half_width: Column) -> Column:
    return F.least(F.lit(ROAD), cap_tolerance(half_width) / 10)


def decimals(x: Column, n: int) -> Column:
    """A number rounded to n decimals, halves up."""
    return round_half_up(x * 10**n) / 10**n


def to_display(mm: Column, unit: Column) -> Column:
    return F.when(unit == "in", decimals(mm / 25.4, 9)).otherwise(mm)


def from_display(value: Column, unit: Column) -> Column:
    return F.when(unit == "in", decimals(value * 25.4, 9)).otherwise(value)


def tile_key(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))


def tile_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    out = template
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def node_key(x: Column, y: Column) -> Column:
    """A point's key to a ten thousandth."""
    return F.concat_ws(",", round_half_up(x * 1e4).cast("long").cast("string"), round_half_up(y * 1e4).cast("long").cast("string"))


def lines_path(lines: Column) -> Column:
    """Lines of (x, y) as path data with two decimals."""
    number = lambda v: F.format_string("%.2f", v.cast("double"))
    one = lambda line: F.array_join(F.transform(line, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), number(p["x"]), F.lit(" "), number(p["y"]))), "")
    return F.array_join(F.transform(lines, one), "")


def path_closed(path: Column) -> Column:
    """Whether every subpath of path data ends with a close command."""
    parts = F.filter(F.transform(F.split(path, "(?=[Mm])"), lambda p: F.trim(p)), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"[Zz]\s*$"))


def path_not_finite(path: Column) -> Column:
    return path.rlike("(?i)NaN|Infinity") | F.exists(F.regexp_extract_all(path, F.lit(r"[-+]?(?:\d*\.\d+|\d+\.?)(?:[eE][-+]?\d+)?"), F.lit(0)), lambda t: ~finite(t.cast("double")))


#: How many numbers a segment of each command of path data has.
SEGMENT = {"M": 2, "L": 2, "T": 2, "C": 6, "S": 4, "Q": 4, "A": 7, "H": 1, "V": 1, "Z": 0}


def moved_path(path: Column, dx: Column, dy: Column) -> Column:
    """Path data moved by (dx, dy), with three decimals at most.

    Points of absolute commands move, of an arc the end alone; numbers of relative ones are steps and stay, but for the pair of a relative
    `m` that opens the path. Null where numbers are too few, too many, not finite, or stand before any command. Empty data, and any that moves by nothing, stay.
    """
    return F.when((path == "") | ((dx == 0) & (dy == 0)), path).otherwise(_moved(path, dx.cast("double"), dy.cast("double")))


_TOKENS = re.compile(r"[MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d*\.\d+|\d+\.?)(?:[eE][-+]?\d+)?", re.ASCII)


@F.arrow_udf(StringType())
def _moved(path: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    rows = zip(path.to_pylist(), dx.to_pylist(), dy.to_pylist(), strict=True)
    return pa.array([None if None in row else _moved_text(*row) for row in rows], pa.string())


def _moved_text(path: str, dx: float, dy: float) -> str | None:
    command, n, out = "", 0, []
    for t in _TOKENS.findall(path):
        upper = command.upper()
        size = SEGMENT.get(upper, 0)
        if t.isalpha():
            if n % size if size else n:
                return None
            if size and not n:
                return None
            command, n = t, 0
            out.append(t)
            continue
        if not size:
            return None
        # Which number of its segment a token is tells whether it is an x, a y or neither.
        k = n % size
        shift = 0.0
        if command == upper or command == "m" and n < 2 and len(out) == n + 1:
            shift = {5: dx, 6: dy}.get(k, 0.0) if upper == "A" else dy if upper == "V" or upper != "H" and k % 2 else dx
        text = _decimals(float(t) + shift)
        if text is None:
            return None
        out.append(text)
        n += 1
    size = SEGMENT.get(command.upper(), 0)
    return " ".join(out) if (n > 0 and n % size == 0 if size else n == 0) else None


@lru_cache(4096)
def _decimals(x: float) -> str | None:
    """A number's text with three decimals at most; null unless it is finite."""
    if not isfinite(x):
        return None
    text = format(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP, _DIGITS), "f").rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


_DIGITS = Context(prec=400)


def plate_path(mode: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column, padding: Column) -> Column:
    """The path of a plate behind a text's box: sharp or round corners; null without a plate."""
    x, y, w, h = min_x - padding, min_y - padding, max_x - min_x + padding * 2, max_y - min_y + padding * 2
    r = F.least(padding, w / 2, h / 2)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else plain_number(p) for p in parts))
    sharp = text("M", x, " ", y, " L", x + w, " ", y, " L", x + w, " ", y + h, " L", x, " ", y + h, " Z")
    arc = lambda a, b: (" A", r, " ", r, " 0 0 1 ", a, " ", b)
    rounded = text("M", x + r, " ", y, " L", x + w - r, " ", y, *arc(x + w, y + r), " L", x + w, " ", y + h - r, *arc(x + w - r, y + h), " L", x + r, " ", y + h, *arc(x, y + h - r), " L", x, " ", y + r, *arc(x + r, y), " Z")
    return F.when((mode != "none") & (w > 0) & (h > 0), F.when(mode == "rectangle", sharp).otherwise(rounded))


def plain_number(x: Column) -> Column:
    """A number's text, without a fraction if it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def union_box(a: Column, b: Column) -> Column:
    """The box (min_x, min_y, max_x, max_y) of two; the first if there is no second."""
    low, high = (lambda k: F.least(a[k], b[k]).alias(k)), (lambda k: F.greatest(a[k], b[k]).alias(k))
    return F.struct(low("min_x"), low("min_y"), high("max_x"), high("max_y"))


def keep_out(x: Column, y: Column, radius: Column, padding: Column) -> Column:
    return F.struct(x.alias("cx"), y.alias("cy"), (F.greatest(F.lit(0.0), radius) + F.greatest(F.lit(0.0), padding)).alias("r"))


def road_label_place(base: Column, normal: Column, offset: Column, flip_all: Column, flipped: Column, moved: Column) -> Column:
    """(x, y, flipped) of a road's label: off the road on one side or the other, unless it was moved."""
    flip = F.coalesce(flipped, F.lit(False)) != flip_all
    sign = F.when(flip, -1.0).otherwise(1.0)
    at = lambda k: F.coalesce(moved[k], base[k] + normal[k] * offset * sign)
    return F.struct(at("x").alias("x"), at("y").alias("y"), flip.alias("flipped"))


# The sentences of the two functions below are part of what a checked design shows.
def neck_text(attached: Column, measured: Column, saturated: Column, least: Column) -> Column:
    found = F.concat(F.format_string("%.2f", measured.cast("double")), F.lit("mm"), F.when(saturated, "+").otherwise(""), F.lit(" of material joins the loop to the body (minimum "), plain_number(least), F.lit("mm)"))
    return F.when(attached, found).otherwise("the loop is not joined to the body at all")


def findings_text(errors: Column, warnings: Column, checks: Column, neck: Column) -> Column:
    """One sentence on the findings of a check."""
    some = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    also = F.when(warnings > 0, F.concat(F.lit(" (and "), some(warnings, "warning"), F.lit(")"))).otherwise("")
    return (
        F.when(errors > 0, F.concat(some(errors, "problem"), F.lit(" must be fixed before this can be exported"), also, F.lit(".")))
        .when(warnings > 0, F.concat(F.lit("Preflight passed with "), some(warnings, "warning"), F.lit(" · "), neck, F.lit(".")))
        .otherwise(F.concat(F.lit("Preflight passed all "), checks.cast("string"), F.lit(" checks · "), neck, F.lit(".")))
    )

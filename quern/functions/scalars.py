"""Scalar column functions: projections, noise, depth curves, widths, policies and strings."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.051129
# Fixed values of the lattice noise.
SEED_SALT = 0x1D4C9A36
GRAIN_STRETCH = 4
LATTICE_X, LATTICE_Y = 0x2F6B4D93, 0x51C3A8E7
MIX_A, MIX_B, MIX_C = 0x7A3D1C4B, 0x3E95B2D1, 0x58F16A0F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


# --- Web Mercator, on the unit square ---


def mercator_x(lng: Column) -> Column:
    return (lng + 180) / 360


def mercator_y(lat: Column) -> Column:
    phi = clamp(lat, -MAX_LATITUDE, MAX_LATITUDE) * pi / 180
    return (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / pi) / 2


def lng_of(x: Column) -> Column:
    return x * 360 - 180


def lat_of(y: Column) -> Column:
    return F.atan(F.sinh(pi * (1 - 2 * y))) * 180 / pi


def tile_zoom(zoom: Column) -> Column:
    return F.least(F.lit(14), F.greatest(F.lit(5), F.floor(zoom))).cast("int")


def wrap(x: Column, n: Column) -> Column:
    return F.pmod(x, n)


# --- Lattice noise on 32-bit words, held in 64-bit integers ---

_WORD = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_WORD))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, where plain columns would repeat its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def times32(a: Column, k: int) -> Column:
    """a * k modulo 2^32, in halves so that no product passes 63 bits."""
    return let(a, lambda v: _low(F.shiftleft(_low(F.shiftright(v, 16) * k), 16) + v.bitwiseAND(F.lit(0xFFFF)) * k))


def noise_hash(x: Column, y: Column, seed: Column) -> Column:
    """A hash of a lattice point and a seed; x, y and seed count modulo 2^32."""
    fold = lambda h, n: let(h, lambda v: v.bitwiseXOR(F.shiftright(v, n)))
    h = times32(_low(seed).bitwiseXOR(F.lit(SEED_SALT)), MIX_A)
    h = times32(fold(h.bitwiseXOR(times32(_low(x), LATTICE_X)), 15), MIX_B)
    h = times32(fold(h.bitwiseXOR(times32(_low(y), LATTICE_Y)), 13), MIX_C)
    return fold(times32(fold(h, 16), MIX_A), 14)


def noise_word(x: int, y: int, seed: int) -> int:
    """The same hash of plain numbers."""
    h = hash_start(seed)
    h ^= (x & _WORD) * LATTICE_X & _WORD
    h = (h ^ (h >> 15)) * MIX_B & _WORD
    h ^= (y & _WORD) * LATTICE_Y & _WORD
    h = (h ^ (h >> 13)) * MIX_C & _WORD
    h = (h ^ (h >> 16)) * MIX_A & _WORD
    return h ^ (h >> 14)


def hash_start(seed: int) -> int:
    """The lattice hash's first value, which depends on the seed alone."""
    return ((seed & _WORD) ^ SEED_SALT) * MIX_A & _WORD


def smoothstep(x: Column) -> Column:
    return x * x * (3 - 2 * x)


def value_noise(x: Column, y: Column, seed: Column) -> Column:
    """Noise in [0, 1): lattice values, blended by smoothstep."""
    def blend(p: Column) -> Column:
        at = lambda dx, dy: noise_hash(F.floor(p["x"]) + dx, F.floor(p["y"]) + dy, p["seed"]) / F.lit(4294967296.0)
        sx, sy = smoothstep(p["x"] - F.floor(p["x"])), smoothstep(p["y"] - F.floor(p["y"]))
        mix = lambda a, b, t: let(a, lambda v: v + (b - v) * t)
        return mix(mix(at(0, 0), at(1, 0), sx), mix(at(0, 1), at(1, 1), sx), sy)

    return let(F.struct(x.alias("x"), y.alias("y"), seed.alias("seed")), blend)


def noise_contrast(n: Column) -> Column:
    """Noise about a half, spread out and kept within a half of nothing."""
    return let((n - 0.5) * 3, lambda x: x / (1 + 2 * F.abs(x)))


# --- Depth curves on [0, 1] ---


def profile(name: Column, t: Column) -> Column:
    """Depth at a distance from the shore, both of 1, for a named bottom shape."""
    x = clamp(t, 0.0, 1.0)
    drop = F.when(x <= 0.3, 0.0).otherwise((x - 0.3) / (1 - 0.3))
    bench = F.least(F.floor(x * 4), F.lit(3))
    u = x * 4 - bench
    return (
        F.when(name == "even-slope", x)
        .when(name == "smooth-basin", x * (2 - x))
        .when((x == 0) | (x == 1), x)
        .when(name == "broad-shelf", 0.18 * x + (1 - 0.18) * smoothstep(drop))
        .when(name == "stepped-benches", (bench + u * u * u * (u * (6 * u - 15) + 10)) / 4)
    )


def shelf(t: Column, width: float) -> Column:
    """The first `width` of the distance reaches 0.15 of the depth only."""
    x = clamp(t, 0.0, 1.0)
    if width <= 0:
        return x
    return F.when((x == 0) | (x == 1), x).when(x < width, 0.15 * x / width).otherwise(0.15 + (1 - 0.15) * (x - width) / (1 - width))


def bank(t: Column, steepness: float) -> Column:
    """A bank that is gentler (below 0.5) or steeper (above) at the waterline."""
    x, k = clamp(t, 0.0, 1.0), -0.6 * (1 - 2 * steepness) if steepness < 0.5 else 6 * (2 * steepness - 1)
    return F.when((x == 0) | (x == 1) | F.lit(k == 0), x).otherwise(x * (1 + k) / (1 + k * x))


def terrace(v: Column, levels: int, strength: float, deepest: Column | None = None) -> Column:
    """Depths drawn towards the nearest of `levels` benches, down to the bench `deepest` at most; none is drawn to the surface."""
    level = F.greatest(F.lit(1), F.least(F.lit(levels) if deepest is None else deepest, round_half_up(v * levels))) / levels
    return F.when((v <= 0) | F.lit(strength <= 0), v).otherwise(level if strength >= 1 else v + (level - v) * strength)


# --- Units and widths ---

# Road widths in millimetres by class, at a diameter of 101.6 mm.
WIDTHS = {
    "motorway": 0.9, "trunk": 0.8, "primary": 0.7, "secondary": 0.6, "tertiary": 0.5, "minor": 0.42, "residential": 0.42,
    "unclassified": 0.42, "living_street": 0.42, "service": 0.32, "track": 0.3, "pedestrian": 0.3, "path": 0.26,
    "footway": 0.26, "cycleway": 0.26, "steps": 0.26, "bridleway": 0.26,
}
UNKNOWN_WIDTH, LEAST_WIDTH = 0.3, 0.25
# The classes that each level of detail adds.
TIERS = {
    "low": ("motorway", "trunk", "primary", "secondary"),
    "medium": ("tertiary", "minor", "residential", "unclassified", "living_street"),
    "high": ("service", "track", "path", "pedestrian", "footway", "cycleway", "steps", "bridleway"),
}


def width_factor(diameter: Column) -> Column:
    usable = diameter.isNotNull() & (diameter > 0) & ~F.isnan(diameter)
    return F.when(usable, clamp(F.sqrt(diameter / 101.6), 0.6, 2.0)).otherwise(0.6)


def to_metres(value: Column, unit: Column) -> Column:
    """A depth in metres; null for a unit that is neither metres nor feet, or a negative depth."""
    return F.when(value < 0, None).when(unit.rlike("(?i)^m(eters?)?$"), value).when(unit.rlike("(?i)^(ft|feet|foot)$"), value * 0.3048)


# --- Strings ---


def normalize_query(q: Column) -> Column:
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def has_control_characters(value: Column) -> Column:
    """Whether a text has control characters other than tab and line ends."""
    return value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")


def escape_xml(value: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(name))
    return value


def slug(value: Column, default: str, most: int = 48) -> Column:
    """Lower-case ASCII letters and digits, joined by hyphens; accents of Latin letters are dropped."""
    plain = F.translate(F.lower(value), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    joined = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(joined, 1, most), "-+$", "")
    return F.when(F.coalesce(short, F.lit("")) == "", default).otherwise(short)


def tile_of_path(path: Column) -> Column:
    """(z, x, y) of a tile's path, or null if it is malformed or out of range."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"^/api/terrain/(\d{1,2})/(\d{1,6})/(\d{1,6})\.png$", k), F.lit("")).cast("int")
    z, x, y = part(1), part(2), part(3)
    n = F.pow(F.lit(2.0), z)
    return F.when((z <= 15) & (x < n) & (y < n), F.struct(z.alias("z"), x.alias("x"), y.alias("y")))


def elevation(r: Column, g: Column, b: Column) -> Column:
    """Metres of a colour in which elevation tiles are coded."""
    return r * 256.0 + g + b / 256.0 - 32768


def key_hash(text: Column) -> Column:
    """A 32-bit hash of a text, by 31 times the hash so far plus the next UTF-16 unit."""
    points = F.transform(F.when(text != "", F.split(text, "")).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>"))), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(F.transform(points, lambda p: F.when(p > 65535, F.array(55296 + F.floor((p - 65536) / 1024), 56320 + (p - 65536) % 1024)).otherwise(F.array(p))))
    return F.aggregate(units, F.lit(0).cast("long"), lambda a, u: (a * 31 + u) % 4294967296)

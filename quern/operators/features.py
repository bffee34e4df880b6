"""Operators on captured map features: widths, groups, labels, overrides and checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import polygons as poly
from quern.operators.surveys import box_pairs

# Place classes by rank, and those that never get a label.
PLACES = ("city", "town", "village", "suburb", "quarter", "neighbourhood", "hamlet", "island", "islet", "locality", "isolated_dwelling")
EXCLUDED = ("continent", "country", "state", "province")
# Fixed value: the share of a label's box that may lie over water.
WATER_SHARE = 0.02


def lookup(column: Column, values: dict, default) -> Column:
    """A small fixed table as a column: the value of each key, or a default."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def road_width(road_class: Column, diameter: Column, scale: Column) -> Column:
    usable = F.when((scale > 0) & ~F.isnan(scale), scale).otherwise(1.0)
    return F.greatest(F.lit(sc.LEAST_WIDTH), lookup(road_class, sc.WIDTHS, sc.UNKNOWN_WIDTH) * sc.width_factor(diameter) * usable)


def classes_of(detail: str) -> list[str]:
    """The road classes that a level of detail admits."""
    tiers = list(sc.TIERS)
    return [c for t in tiers[: tiers.index(detail) + 1] for c in sc.TIERS[t]]


def road_groups(roads: DataFrame, detail: str, diameter: float, scale: float) -> DataFrame:
    """(width_class, lines, vertices, floored) per road class that the detail admits; `floored` if the width is at its least."""
    kept = roads.filter(F.col("road_class").isin(classes_of(detail))).withColumn("width", road_width(F.col("road_class"), F.lit(diameter), F.lit(scale)))
    return kept.groupBy("road_class", "width").agg(F.count("*").alias("lines"), F.sum(F.size("line")).alias("vertices")).withColumn("floored", F.col("width") <= sc.LEAST_WIDTH)


def label_order(kind: Column, label_class: Column, rank: Column, name: Column, ix: Column) -> list[Column]:
    """Sort keys by priority: places before others, place classes by rank, then rank, name and the order of capture."""
    place = F.when(kind == "place", 0).otherwise(1)
    order = F.when(kind == "place", lookup(label_class, {c: i for i, c in enumerate(PLACES)}, len(PLACES))).otherwise(0)
    return [place, order, rank, name, ix]


def _label_box(letter: int, line: int) -> dict[str, Column]:
    """The sides of the box around a label's middle: `letter` wide for each letter, `line` tall."""
    half, tall = F.floor(letter * F.length("name") / 2), line // 2
    return {"a": F.col("x") - half, "b": F.col("y") - tall, "c": F.col("x") + half, "d": F.col("y") + tall}


def over_water(labels: DataFrame, water: DataFrame, letter: int, line: int, cell: int, share: float = WATER_SHARE) -> DataFrame:
    """`labels` (board, ix, name, x, y) with `wet`: whether more than `share` of the label's box lies over water (board, rings). Pairs of boxes meet by cells."""
    boxed = labels.select("board", F.col("ix").alias("id"), *(v.alias(k) for k, v in _label_box(letter, line).items()))
    corner = lambda x, y: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    ring = F.array(corner("a", "b"), corner("c", "b"), corner("c", "d"), corner("a", "d"), corner("a", "b"))
    boxes = boxed.select("board", F.struct("board", "id").alias("id"), F.array(ring).alias("rings"), ((F.col("c") - F.col("a")) * (F.col("d") - F.col("b"))).alias("size"))
    bodies = water.select("board", F.monotonically_increasing_id().alias("id"), "rings")
    near = box_pairs(boxes, bodies, cell, ["board"]).join(boxes.select(F.col("id").alias("l"), F.col("rings").alias("own"), "size"), "l").join(bodies.select(F.col("id").alias("r"), F.col("rings").alias("body")), "r")
    shared = poly.boolean(near, "own", "body", "intersection").groupBy("l", "size").agg(F.sum("area").alias("area"))
    wet = shared.filter(F.col("area") > F.col("size") * share).select("l.board", F.col("l.id").alias("ix"), F.lit(True).alias("wet"))
    return labels.drop("wet").join(wet, ["board", "ix"], "left").withColumn("wet", F.coalesce("wet", F.lit(False)))


def place_labels(labels: DataFrame, width: int, height: int, letter: int, line: int, inset: int = 0, keep_out: DataFrame | None = None) -> DataFrame:
    """(board, ix, reason): labels placed one after the other by `place`, their order on the board.

    A label is dropped if its place's class gets none (`excluded`), its name is on the board, whatever its case and blanks (`duplicate`), its box leaves the
    board less the inset (`outside`), it overlaps a box placed before or one to keep out of (`collision`), or it is `wet` (`water`). `kind`, `label_class` and `wet` may be
    missing; `keep_out` has board, a, b, c, d. Each board is a fold over its own labels, in which boxes are looked up by cells; boards run in parallel.
    """
    none = {"kind": F.lit("poi"), "label_class": F.lit(""), "wet": F.lit(False)}
    box = _label_box(letter, line)
    given = labels.select("board", "ix", "place", "name", *(F.col(c) if c in labels.columns else v.alias(c) for c, v in none.items()), *(v.cast("long").alias(k) for k, v in box.items()))
    kept = labels.select("board", *(F.lit(None).cast("long").alias(k) for k in box)).filter(F.lit(False)) if keep_out is None else keep_out.select("board", *(F.col(k).cast("long").alias(k) for k in box))
    kept = kept.toDF("away_from", *box)
    # Boxes are listed under the squares that they cover.
    side = max(4 * line, 1)

    def fold(table: pa.Table, away: pa.Table) -> pa.Table:
        taken: dict[tuple[int, int], list[tuple]] = {}
        names: set[str] = set()
        reasons = []

        def squares(b: tuple) -> list[tuple[int, int]]:
            return [(i, j) for i in range(b[0] // side, b[2] // side + 1) for j in range(b[1] // side, b[3] // side + 1)]

        def take(b: tuple) -> None:
            for at in squares(b):
                taken.setdefault(at, []).append(b)

        for b in zip(*(away.column(k).to_pylist() for k in "abcd"), strict=True):
            take(b)
        table = table.sort_by("place")
        for name, kind, label_class, wet, *b in zip(*(table.column(k).to_pylist() for k in ("name", "kind", "label_class", "wet", "a", "b", "c", "d")), strict=True):
            key = name.strip().lower()
            if kind == "place" and label_class in EXCLUDED:
                reason = "excluded"
            elif key in names:
                reason = "duplicate"
            elif b[0] < inset or b[1] < inset or b[2] > width - inset or b[3] > height - inset:
                reason = "outside"
            elif any(b[0] < q[2] and q[0] < b[2] and b[1] < q[3] and q[1] < b[3] for at in squares(b) for q in taken.get(at, ())):
                reason = "collision"
            elif wet:
                reason = "water"
            else:
                reason = "placed"
                take(b)
                names.add(key)
            reasons.append(reason)
        return pa.table([table.column("board").cast(pa.int64()), table.column("ix").cast(pa.int64()), pa.array(reasons, pa.string())], ["board", "ix", "reason"])

    return given.groupBy("board").cogroup(kept.groupBy("away_from")).applyInArrow(fold, "board long, ix long, reason string")


def with_overrides(objects: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Objects with each field replaced by its override, where there is one."""
    names = [F.col(f).alias(f"_{f}") for f in fields]
    joined = objects.join(overrides.select(F.col("object_id").alias("_o"), *names), F.col("object_id") == F.col("_o"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in objects.columns])


def automatic_thresholds(depths: DataFrame, count: int) -> DataFrame:
    """(body, i, depth): `count` evenly indexed distinct depths of each body that has as many."""
    levels = depths.select("body", "depth").distinct()
    ranked = levels.withColumns({"k": F.row_number().over(Window.partitionBy("body").orderBy("depth")) - 1, "n": F.count("*").over(Window.partitionBy("body"))})
    wanted = ranked.filter(F.col("n") >= count).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return wanted.filter(F.col("k") == sc.round_half_up(F.col("i") * (F.col("n") - 1) / max(1, count - 1))).select("body", "i", "depth")


def capacity(features: DataFrame, most_features: int, most_vertices: int, simplify_above: int, group: str) -> DataFrame:
    """Counts per capture, and whether it is refused, simplified or taken as it is."""
    totals = features.groupBy(group).agg(F.count("*").alias("features"), F.sum(F.size("line")).alias("vertices"))
    verdict = F.when((F.col("features") > most_features) | (F.col("vertices") > most_vertices), "refuse").when(F.col("vertices") > simplify_above, "simplify").otherwise("accept")
    return totals.withColumns({"bytes": F.col("vertices") * 32, "verdict": verdict})


def road_label_candidates(roads: DataFrame, group: list[str]) -> DataFrame:
    """For each group of roads the longest segment (the first, on a tie) and its middle; `upright` tells which way its text runs."""
    from quern.functions.geometry import segments

    s = roads.select(*group, "ix", F.explode(segments(F.col("line"))).alias("s"))
    dx, dy = F.col("s.x2") - F.col("s.x"), F.col("s.y2") - F.col("s.y")
    best = s.groupBy(*group).agg(F.max(F.struct((dx * dx + dy * dy).alias("squared"), (-F.col("ix")).alias("_ix"), (-F.col("s.i")).alias("_i"), "s")).alias("m"), F.countDistinct("ix").alias("roads"))
    m = F.col("m.s")
    return best.select(*group, "roads", (-F.col("m._ix")).alias("ix"), (-F.col("m._i")).alias("segment"), F.col("m.squared").alias("squared"), (m["x"] + m["x2"]).alias("twice_x"), (m["y"] + m["y2"]).alias("twice_y"), (m["x2"] >= m["x"]).alias("upright"))


def preflight(rings: DataFrame, least_area: int) -> DataFrame:
    """(id, finding, severity) for rings that are open, too short, of missing coordinates or too small."""
    from quern.functions.geometry import double_area

    ring = F.col("ring")
    missing = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())
    closed = (F.size(ring) >= 4) & (F.get(ring, 0) == F.element_at(ring, -1))
    found = F.array(
        F.when(missing, F.struct(F.lit("non-finite").alias("finding"), F.lit("error").alias("severity"))),
        F.when(~missing & ~closed, F.struct(F.lit("open-path").alias("finding"), F.lit("error").alias("severity"))),
        F.when(~missing & closed & (F.abs(double_area(ring)) < 2 * least_area), F.struct(F.lit("tiny-piece").alias("finding"), F.lit("warning").alias("severity"))),
    )
    return rings.select("id", F.inline(F.filter(found, lambda x: x.isNotNull())))

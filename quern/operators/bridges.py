"""Bridges: roads over water that reach land on both sides keep a tab of material.

Every road is cut at the shore. A stretch over water ends on land where the road goes on over land, or where another road does
from the same end point; it ends in a node where the road ends over water, and nowhere at the board's edge. Stretches that
share a node, or of which one's node lies on another, are one crossing. A crossing with two ends on land or more is a bridge, any
other a dead end. A tunnel has no deck.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.operators import polygons as poly
from quern.operators.areas import RUN, in_groups, pieces, run_columns

#: Fixed values, in micrometres: how close a node and a stretch are one place, how near the edge is the edge, and the width below which a tab is reported.
TOUCH, EDGE, LEAST_WIDTH = 10.0, 0.001, 3000


def crossings(roads: DataFrame, water: DataFrame, width: int, height: int, cell: int = 0, group: str = "board", lined: bool = True) -> DataFrame:
    """(group, id, run, first, t0, last, t1, length, line, exits, root, bridge): the stretches of roads (group, id, line, tunnel) over water, but for tunnels'.

    `exits` counts the ends on land of the stretch, `root` is the first stretch of its crossing, and `bridge` tells whether the crossing has two or more.
    A `width` of roads is kept; `line` is left out unless `lined`. Roads and water of a group meet in one task, so neither pieces nor ends are shuffled; `cell` has no effect.
    """
    known = ["id", *(c for c in ("width",) if c in roads.columns)]
    schema = StructType([roads.schema[k] for k in (group, *known)])
    for f in StructType.fromDDL(RUN).fields:
        if f.name in ("run", "first", "t0", "last", "t1", "length") or lined and f.name == "line":
            schema = schema.add(f)
    schema = schema.add("exits", "long").add("root", StructType([roads.schema["id"], StructField("run", LongType())])).add("bridge", "boolean")

    def made(table: pa.Table, cut: dict[str, np.ndarray]) -> dict[str, pa.Array | np.ndarray]:
        runs = run_columns(cut)
        tunnel = table.column("tunnel").fill_null(False).to_numpy()
        names = table.column("id").combine_chunks()
        decks = np.flatnonzero(runs["inside"] & ~tunnel[runs["of"]])
        exits, root, bridge = _crossed(cut, runs, decks, names.to_pylist(), width, height)
        out = {k: v.take(pa.array(decks)) if isinstance(v, pa.Array) else v[decks] for k, v in runs.items()}
        at = lambda k: pa.array(runs["of"][k])
        firsts = pa.StructArray.from_arrays([names.take(at(decks[root])), pa.array(runs["run"][decks[root]])], ["id", "run"])
        return out | {c: table.column(c).combine_chunks().take(at(decks)) for c in (group, *known)} | {"exits": exits, "root": firsts, "bridge": bridge}

    return in_groups(roads.select(group, *known, "line", "tunnel"), water, group, made, schema)


def _crossed(cut: dict[str, np.ndarray], runs: dict[str, np.ndarray], decks: np.ndarray, names: list, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the decks (numbers of runs) its exits, the number of its crossing's first deck, and whether the crossing is a bridge."""
    first = runs["piece"]
    last = np.append(first[1:], len(cut["of"])) - 1
    sides = [(cut["x0"], cut["y0"], first, runs["starts"]), (cut["x1"], cut["y1"], last, runs["ends"])]
    # A place is told to a tenth of a micrometre.
    key = lambda x, y: (int(np.floor(x * 10 + 0.5)), int(np.floor(y * 10 + 0.5)))
    dry = {key(x[at[r]], y[at[r]]) for x, y, at, ends in sides for r in np.flatnonzero(ends & ~runs["inside"])}
    exits = np.full(len(decks), 2)
    nodes = []
    for x, y, at, ends in sides:
        for k in np.flatnonzero(ends[decks]):
            px, py = x[at[decks[k]]], y[at[decks[k]]]
            edge = px <= EDGE or py <= EDGE or px >= width - EDGE or py >= height - EDGE
            if edge or key(px, py) not in dry:
                exits[k] -= 1
            if not edge and key(px, py) not in dry:
                nodes.append((k, px, py))
    parent = list(range(len(decks)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    order = sorted(range(len(decks)), key=lambda k: (names[runs["of"][decks[k]]], runs["run"][decks[k]])) if nodes else range(len(decks))
    place = np.empty(len(decks), np.int64)
    place[list(order)] = np.arange(len(decks))

    def tie(a: int, b: int) -> None:
        a, b = sorted((top(a), top(b)), key=lambda k: place[k])
        parent[b] = a

    seen: dict[tuple[int, int], int] = {}
    for k, px, py in nodes:
        tie(k, seen.setdefault(key(px, py), k))
    if nodes:
        deck = np.full(len(first), -1)
        deck[decks] = np.arange(len(decks))
        deck = np.repeat(deck, last - first + 1)
        wet = deck >= 0
        deck, x, y = deck[wet], cut["x0"][wet], cut["y0"][wet]
        dx, dy = cut["x1"][wet] - x, cut["y1"][wet] - y
        size = dx * dx + dy * dy
        for k, px, py in nodes:
            t = np.clip(((px - x) * dx + (py - y) * dy) / np.where(size > 0, size, 1), 0, 1)
            ex, ey = px - (x + t * dx), py - (y + t * dy)
            for other in np.unique(deck[ex * ex + ey * ey <= TOUCH * TOUCH]):
                tie(k, int(other))
    root = np.array([top(k) for k in range(len(decks))], np.int64)
    return exits, root, np.bincount(root, exits, minlength=len(decks))[root] >= 2


def tunnels_over_water(roads: DataFrame, water: DataFrame, cell: int = 0, group: str = "board") -> DataFrame:
    """(group, id): the tunnels that pass below water."""
    return pieces(roads.filter("tunnel"), water, group=group).filter("inside").select(group, "id").distinct()


def bridge_report(found: DataFrame, roads: DataFrame, group: str = "board") -> DataFrame:
    """(group, spans, dead_ends, narrow, thinnest, longest) of `crossings`: stretches that get a tab, crossings that don't, and tabs under LEAST_WIDTH."""
    wide = found if "width" in found.columns else found.join(roads.select(group, "id", "width"), [group, "id"])
    narrow = F.col("bridge") & (F.col("width") < LEAST_WIDTH)
    return wide.groupBy(group).agg(
        F.count(F.when(F.col("bridge"), 1)).alias("spans"), F.count_distinct(F.when(~F.col("bridge"), F.col("root"))).alias("dead_ends"), F.count(F.when(narrow, 1)).alias("narrow"),
        F.min(F.when(narrow, F.col("width"))).alias("thinnest"), F.max(F.when(narrow, F.col("length"))).alias("longest"),
    )


def bridge_tabs(found: DataFrame, roads: DataFrame, group: str = "board") -> DataFrame:
    """(group, area, rings): the tabs of a group's bridges, each as wide as its road with round ends, joined to one set."""
    whole = F.transform("line", lambda p: F.struct(F.round(p["x"]).cast("long").alias("x"), F.round(p["y"]).cast("long").alias("y")))
    wide = found if "width" in found.columns else found.join(roads.select(group, "id", "width"), [group, "id"])
    spans = wide.filter("bridge").select(group, F.array(whole).alias("lines"), (F.col("width") / 2).alias("half"))
    return poly.union_all(poly.stroked(spans, "lines", "half", None), "rings", [group])

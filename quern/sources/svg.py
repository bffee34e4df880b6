"""Writers: vector layers as SVG, with their metadata, as text files or one ZIP.

Shapes are rows (board, group, ix, d); a drawing is a grouped, ordered string, so boards are written in parallel.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import escape_xml


def millimetres(um: Column) -> Column:
    """Whole micrometres as millimetres with up to three decimals and no negative zero."""
    whole, part = F.floor(F.abs(um) / 1000), F.abs(um) % 1000
    text = F.concat(F.when((um < 0), "-").otherwise(""), whole.cast("string"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 3, "0"), F.lit("0")))))
    return text


def path(polygons: Column) -> Column:
    """The SVG path of polygons of closed rings of (x, y) in micrometres."""
    point = lambda p: F.concat_ws(" ", millimetres(p["x"]), millimetres(p["y"]))
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), point), "L"), F.lit("Z"))
    return F.array_join(F.flatten(F.transform(polygons, lambda p: F.transform(p, ring))), "")


def documents(shapes: DataFrame, groups: list[str], width: str, height: str, metadata: Column | None = None) -> DataFrame:
    """(board, svg): one drawing per board with all `groups` in order, empty ones included; other groups come first by name."""
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)]), F.col("group")), F.lit(-1))
    sheets = shapes.groupBy("board").agg(F.max(width).alias("w"), F.max(height).alias("h"))
    every = sheets.select("board").withColumn("group", F.explode(F.array(*map(F.lit, groups))))
    drawn = shapes.groupBy("board", "group").agg(F.array_sort(F.collect_list(F.struct("ix", "d"))).alias("s"))
    body = F.concat(F.lit('<g id="'), escape_xml(F.col("group")), F.lit('">'), F.coalesce(F.array_join(F.transform("s", lambda x: F.concat(F.lit('<path d="'), x["d"], F.lit('"/>'))), ""), F.lit("")), F.lit("</g>"))
    parts = every.join(drawn, ["board", "group"], "full").select("board", order.alias("o"), "group", body.alias("xml"))
    joined = parts.groupBy("board").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "group", "xml"))), lambda x: x["xml"]), "").alias("body"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), millimetres(F.col("w")), F.lit('mm" height="'), millimetres(F.col("h")), F.lit('mm" viewBox="0 0 '), millimetres(F.col("w")), F.lit(" "), millimetres(F.col("h")), F.lit('">'))
    note = metadata if metadata is not None else F.lit("")
    return joined.join(sheets, "board").select("board", F.concat(head, note, F.col("body"), F.lit("</svg>")).alias("svg"))


def metadata_xml(fields: dict[str, Column]) -> Column:
    """A metadata element with a child for each field that is not null."""
    return F.concat(F.lit("<metadata>"), F.concat_ws("", *[F.concat(F.lit(f"<{k}>"), escape_xml(v.cast("string")), F.lit(f"</{k}>")) for k, v in fields.items()]), F.lit("</metadata>"))


def write(drawings: DataFrame, path: str) -> None:
    """A folder per board with its drawing as text."""
    drawings.select("board", "svg").write.mode("overwrite").partitionBy("board").text(path)


def zipped(drawings: DataFrame, per: str = "board") -> DataFrame:
    """(per, content): the drawings (per, name, svg) of each group in one ZIP of fixed times, so that equal drawings give equal bytes."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(pdf["name"], pdf["svg"], strict=True)):
                z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 12, 0, 0)), text)
        return pd.DataFrame({per: [pdf[per].iloc[0]], "content": [out.getvalue()]})

    return drawings.groupBy(per).applyInPandas(pack, f"{per} {dict(drawings.dtypes)[per]}, content binary")

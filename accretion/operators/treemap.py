"""Squarified layout of one level of a tree map, a group at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALLEST, MOST_BOXES = 0.5, 10_000


def squarified(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) of each of descending values: rows along the shorter side, closed where one more would make them longer
    and thinner; fewer rectangles than values where the rest of the area is under half a unit wide."""
    total, out, i = sum(values), [], 0
    if total <= 0 or w <= 0 or h <= 0:
        return out
    scale = w * h / total
    while i < len(values) and w > SMALLEST and h > SMALLEST:
        side, j, area, worst = min(w, h), i, 0.0, float("inf")
        while j < len(values):
            more = area + values[j] * scale
            low, high = values[j] * scale, values[i] * scale
            ratio = max(side * side * high / more**2, more**2 / (side * side * low)) if more > 0 and low > 0 else float("inf")
            if j > i and ratio > worst:
                break
            area, worst, j = more, ratio, j + 1
        thick, at = area / side, 0.0
        for v in values[i:j]:
            length = v * scale / thick if thick > 0 else 0.0
            out.append((x, y + at, thick, length) if w >= h else (x + at, y, length, thick))
            at += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        i = j
    return out


def layout(items: DataFrame, group: str, width: float, height: float, most: int = MOST_BOXES) -> DataFrame:
    """(group, path, bytes, x, y, w, h) of items (group, path, bytes), largest first within each group.

    A group's largest `most` items have boxes of their own; the rest share one without a path, so that no task lays out
    more, however many children a directory has.
    """
    kind = dict(items.dtypes)[group]
    items = items.select(group, "path", "bytes").where("bytes > 0")
    order = Window.partitionBy(group).orderBy(F.desc("bytes"), "path")
    first = items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
    rest = items.groupBy(group).agg(F.sum("bytes").alias("all"), F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    rest = rest.join(first.groupBy(F.col(group).alias("own_group")).agg(F.sum("bytes").alias("own")), F.col(group).eqNullSafe(F.col("own_group")))
    both = first.unionByName(rest.select(group, F.lit(None).cast("string").alias("path"), (F.col("all") - F.col("own")).alias("bytes")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "path"], ascending=[False, True])
        boxes = squarified(rows["bytes"].astype(float).tolist(), 0.0, 0.0, width, height)
        out = rows.iloc[: len(boxes)][[group, "path", "bytes"]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(boxes, columns=list("xywh"), dtype=float)], axis=1)

    return both.groupBy(group).applyInPandas(run, f"{group} {kind}, path string, bytes long, x double, y double, w double, h double")

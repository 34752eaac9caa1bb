"""Which names are drawn: eligibility, score, and a greedy choice without overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRE_WEIGHT, CENTRE_REACH, POINTED, SELECTED = 250.0, 2.0, 500.0, 1000.0


def eligible(stands: Column, pointed: Column, selected: Column, shown: Column, filtered: Column) -> Column:
    return stands & (pointed | selected | (shown & ~filtered))


def marked(pointed: Column, selected: Column) -> Column:
    """The greater of the two, not their sum."""
    return F.greatest(F.when(pointed, POINTED).otherwise(0.0), F.when(selected, SELECTED).otherwise(0.0))


def score(away: Column, pointed: Column, selected: Column) -> Column:
    near = away / CENTRE_REACH
    return marked(pointed, selected) + CENTRE_WEIGHT / (1 + near * near) - away


def placed(names: DataFrame) -> DataFrame:
    """``names`` (view, id, score, left, top, right, bottom) that stand: best first, each only if it
    overlaps none that stands.

    Sequential by nature, so a view is one group: it is what one screen shows, and its names are as many
    as a screen's systems. Those that stand are kept by cells as large as the largest name, so each is
    compared with its neighbours only. Who asks for the whole sky deals it into screens first (``screens``).
    """

    def greedy(view: pd.DataFrame) -> pd.DataFrame:
        ordered = view.sort_values(["score", "id"], ascending=[False, True])
        wide, high = max((view.right - view.left).max(), 1e-9), max((view.bottom - view.top).max(), 1e-9)
        cells: dict[tuple[int, int], list] = {}
        stand = []
        for i, r in enumerate(ordered.itertuples(index=False)):
            x, y = int(r.left // wide), int(r.top // high)
            near = (k for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for k in cells.get((a, b), ()))
            if all(r.right <= k.left or k.right <= r.left or r.bottom <= k.top or k.bottom <= r.top for k in near):
                cells.setdefault((x, y), []).append(r)
                stand.append(i)
        return ordered.iloc[stand]

    return names.groupBy("view").applyInPandas(greedy, names.schema)


def screens(names: DataFrame, width: float, height: float) -> DataFrame:
    """``names`` (id, score, left, top, right, bottom) with the screen that each begins in as its view; a name
    that reaches into the next screen is drawn over there."""
    return names.withColumn("view", F.concat_ws(":", F.floor(F.col("left") / width).cast("string"), F.floor(F.col("top") / height).cast("string")))

"""Joins of things with boxes through a regular index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import hinted

#: Lower and upper end of a segment on each axis, for :func:`meet`.
SEGMENT = {"x": ("least(x0, x1)", "greatest(x0, x1)"), "y": ("least(y0, y1)", "greatest(y0, y1)"), "t": ("t0", "t1")}


def meet(things: DataFrame, grid: DataFrame, columns: dict[str, tuple[str, str]], how: str = "inner") -> DataFrame:
    """Pairs of things and boxes that overlap, borders in.

    ``columns`` gives, for each axis, the expressions of a thing's lower and
    upper end. Both sides are filed under the cells of a regular index over the
    grid's extent, with about as many cells as the grid has boxes, so the join
    has an equality for any grid; a pair is taken in the cell where the common
    part begins, so once.
    """
    ends = grid.agg(*(f(F.col(f"{a}{f.__name__}").cast("double")) for a in columns for f in (F.min, F.max)), F.count("*")).first()
    if ends[0] is None:
        return things.join(grid, F.lit(False), how)
    cell, cells = {}, max(1, round(ends[-1] ** (1 / len(columns))))
    for k, a in enumerate(columns):
        lo, hi = ends[2 * k], ends[2 * k + 1]
        width = (hi - lo) / cells or 1.0
        cell[a] = lambda v, lo=lo, width=width: f"CAST(least({cells - 1}, greatest(0, floor((CAST({v} AS DOUBLE) - CAST({lo!r} AS DOUBLE)) / CAST({width!r} AS DOUBLE)))) AS INT)"
    overlap = " AND ".join(f"{lo} <= {a}max AND {hi} >= {a}min" for a, (lo, hi) in columns.items())
    boxes = grid
    for a, (lo, hi) in columns.items():
        spread = [cell[a](lo), cell[a](hi)]
        things = things.withColumn(f"_of_{a}", F.expr(spread[0])).withColumn(f"_in_{a}", F.expr(spread[0] if lo == hi else f"explode(sequence({spread[0]}, {spread[1]}))"))
        boxes = boxes.withColumn(f"_box_{a}", F.expr(cell[a](f"{a}min"))).withColumn(f"_at_{a}", F.expr(f"explode(sequence(_box_{a}, {cell[a](f'{a}max')}))"))
    same = " AND ".join(f"_in_{a} = _at_{a} AND _in_{a} = greatest(_of_{a}, _box_{a})" for a in columns)
    marks = [f"_{m}_{a}" for a in columns for m in ("of", "in", "box", "at")]
    return things.join(hinted(boxes), F.expr(f"{same} AND {overlap}"), how).drop(*marks)

"""Cell tables: (row, col, value). D8 codes are powers of two clockwise from north; -1 is nodata, 0 no flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row and column steps of the eight directions N, NE, E, SE, S, SW, W, NW; the code of direction k is 2**k.
DROW = (-1, -1, 0, 1, 1, 1, 0, -1)
DCOL = (0, 1, 1, 1, 0, -1, -1, -1)

#: Cells get one number, so that flow becomes a functional graph.
WIDTH = 1 << 31


def cell(row: Column | str, col: Column | str) -> Column:
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return row.cast("long") * WIDTH + col.cast("long")


def row_of(c: Column) -> Column:
    return F.floor(c / WIDTH).cast("int")


def col_of(c: Column) -> Column:
    return (c % WIDTH).cast("int")


def neighbours(cells: DataFrame, value: str, diagonal: bool = True) -> DataFrame:
    """For each cell and direction k with a neighbour: row, col, k, near.

    Cells are sent to their neighbours' places and joined there: one shuffle on (row, col), whatever the extent.
    Joins with them are no broadcasts: Spark takes a cell table's size from its file, which says little of its rows.
    """
    ks = range(8) if diagonal else range(0, 8, 2)
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(DROW[k]).alias("dr"), F.lit(DCOL[k]).alias("dc")) for k in ks))
    sent = cells.select("row", "col", F.col(value).alias("near"), F.explode(steps).alias("s"))
    return sent.select((F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), F.col("s.k").alias("k"), "near").hint("merge")


def window(cells: DataFrame, value: str, up: int, left: int, down: int, right: int) -> DataFrame:
    """For each cell place, the values of the cells within a rectangle around it: row, col, dr, dc, near."""
    span = F.flatten(F.transform(F.sequence(F.lit(-up), F.lit(down)), lambda r: F.transform(F.sequence(F.lit(-left), F.lit(right)), lambda c: F.struct(r.alias("dr"), c.alias("dc")))))
    sent = cells.select("row", "col", F.col(value).alias("near"), F.explode(span).alias("s"))
    return sent.select((F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), "near").hint("merge")


def downstream(flow: DataFrame, code: str = "d8") -> DataFrame:
    """(id, next) of D8 cells: next is null at code 0, at nodata and beyond the grid."""
    at = F.col(code)
    k = F.log2(at.cast("double")).cast("int")
    dr = F.element_at(F.array(*map(F.lit, DROW)), k + 1)
    dc = F.element_at(F.array(*map(F.lit, DCOL)), k + 1)
    to = F.when(at > 0, cell(F.col("row") + dr, F.col("col") + dc))
    steps = flow.select(cell("row", "col").alias("id"), to.alias("next"))
    there = flow.where(f"{code} >= 0").select(cell("row", "col").alias("next")).withColumn("known", F.lit(True)).hint("merge")
    return steps.join(there, "next", "left").select("id", F.when(F.col("known"), F.col("next")).alias("next"))

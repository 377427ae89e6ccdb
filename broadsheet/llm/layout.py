"""A clustered layout over several dimensions, and what queries by neighbourhood read of it.

Every dimension's values become coordinates, equal shares of the rows where values allow; a row's place is the z-order of its cell, then its id, and
every `file_rows` rows are a file. A query by a row's cell asks for the cells around it, `reach` to either side in each
dimension. How many files it touches (their bounds meet the query) and how many match (they hold a row inside) depends on its cell alone, and there are
at most `cells` to the number of dimensions of those, whatever the input. So files are dealt out, and each task adds up its files in one
grid: the occupied cells of a file are a small grid, dilated one dimension after the other (a sliding OR, which is separable), then counted cell by cell; the
bounds of a file, dilated, are counted as boxes by their corners. Grids are summed by cell.

Nothing else that goes to one task, to the driver or into a broadcast depends on the number of rows: cuts of the coordinates come from
running sums over ranges of the counted values, places from row numbers within ranges (one number a shuffle partition goes through the driver), bounds from the rows of one file.

Edge cases: null values are smaller than any other and take coordinate 0. Null ids come first among the rows of a cell, rows that share an id or are repeated in full follow each other
in an order that is chosen once. Strings compare by their UTF-8 bytes. Texts matter only by what the caller takes of them, so very long ones are nothing special. Columns of the input that have
a name of the output give way to it. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._shared import before, settled

CELLS = 8
FILE_ROWS = 2000
#: Cells of all dimensions together, at most: the grids of a task have as many numbers.
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Dimension:
    """A value by which rows are laid out; queries reach so many coordinates to either side."""

    name: str
    value: Column
    reach: int = 0


def cuts(rows: DataFrame, columns: Sequence[str], cells: int = CELLS) -> list[list]:
    """For each column its cuts: the k-th is the least value with at least k / cells of all rows below it, None if there is none."""
    total = rows.count()
    if not total:
        return [[None] * (cells - 1) for _ in columns]
    group = F.grouping_id().alias("__kind")
    counted = rows.groupingSets([[c] for c in columns], *columns).agg(group, F.count(F.lit(1)).alias("__n"))
    # All columns are summed in one run: each has `total` rows, so what lies below a value is the sum less those of the columns before.
    kinds = [(1 << len(columns)) - 1 - (1 << len(columns) - 1 - i) for i in range(len(columns))]
    summed = before(counted, ["__kind", *columns], "__n", name="__below")
    least = []
    for i, c in enumerate(columns):
        below = F.col("__below") - F.lit(total * i)
        least += [F.min(F.when((F.col("__kind") == kinds[i]) & (below * cells >= F.lit(total * k)), F.col(c))).alias(f"c{i}_{k}") for k in range(1, cells)]
    row = summed.agg(*least).first()
    return [[row[f"c{i}_{k}"] for k in range(1, cells)] for i in range(len(columns))]


def coordinate(value: Column, cut: Sequence) -> Column:
    """Of a value, the number of cuts that are not above it."""
    out = F.lit(0)
    for c in cut:
        if c is not None:
            out += F.when(value >= F.lit(c), 1).otherwise(0)
    return out.cast("int")


def interleaved(coordinates: Sequence[Column], bits: int) -> Column:
    """The coordinates' binary digits in turns, the highest first, those of the first coordinate first in each turn."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for c in coordinates:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(c, bit).bitwiseAND(F.lit(1)).cast("long"))
    return out


def placed(df: DataFrame, dimensions: Sequence[Dimension], id_column: str = "doc_id", carried: Sequence[str] | None = None, cells: int = CELLS, file_rows: int = FILE_ROWS, interleave: Sequence[str] | None = None) -> DataFrame:
    """The `carried` columns of `df` (all by default; the id's must be among them), the coordinates (c0, c1, ... in the order of `dimensions`), z, position and file.

    `interleave`: names of the dimensions in the order of their digits.
    """
    names = [d.name for d in dimensions]
    turns = [names.index(n) for n in interleave or names]
    added = [*[f"c{i}" for i in range(len(names))], "z", "position", "file"]
    keep = [c for c in (df.columns if carried is None else carried) if c.lower() not in added]
    values = [f"__v{i}" for i in range(len(names))]
    given = settled(df.select(*[df[X.quoted(c)] for c in keep], *[d.value.alias(v) for d, v in zip(dimensions, values, strict=True)]))
    cut = cuts(given.select(*values), values, cells)
    at = given.select(*[F.col(X.quoted(c)) for c in keep], *[coordinate(F.col(v), cut[i]).alias(f"c{i}") for i, v in enumerate(values)])
    at = at.withColumn("z", interleaved([F.col(f"c{i}") for i in turns], max(1, (cells - 1).bit_length())))
    ordered = before(at, ["z", F.col(X.quoted(id_column))], name="position")
    return ordered.withColumn("position", F.col("position").cast("long")).withColumn("file", F.floor(F.col("position") / file_rows).cast("long"))


def bounds(rows: DataFrame, n: int) -> DataFrame:
    """Rows as `placed` gives them with file_bounds: minimum and maximum of each coordinate over their file, joined by commas."""
    over = Window.partitionBy("file")
    ends = [f(f"c{i}").over(over).cast("string") for i in range(n) for f in (F.min, F.max)]
    return rows.withColumn("file_bounds", F.concat_ws(",", *ends))


def dilated(grid: np.ndarray, axis: int, reach: int) -> np.ndarray:
    """True where a true cell lies at most `reach` away along one axis."""
    out = grid.copy()
    for k in range(1, min(reach, grid.shape[axis] - 1) + 1):
        ahead, behind = [slice(None)] * grid.ndim, [slice(None)] * grid.ndim
        ahead[axis], behind[axis] = slice(k, None), slice(None, -k)
        out[tuple(ahead)] |= grid[tuple(behind)]
        out[tuple(behind)] |= grid[tuple(ahead)]
    return out


def counted_cells(files: Sequence[np.ndarray], cells: int, reach: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every cell how many of the files its query touches, and how many match; a file is its distinct occupied cells as numbers in row-major order."""
    shape = (cells,) * len(reach)
    matching, corners = np.zeros(shape, np.int64), np.zeros((cells + 1,) * len(reach), np.int64)
    for held in files:
        at = np.unravel_index(held, shape)
        low, high = [int(a.min()) for a in at], [int(a.max()) for a in at]
        # Only the box around the file's cells, widened by the reach, can be true: a sparse file costs its box.
        first = [max(0, a - r) for a, r in zip(low, reach, strict=True)]
        last = [min(cells, b + r + 1) for b, r in zip(high, reach, strict=True)]
        grid = np.zeros([b - a for a, b in zip(first, last, strict=True)], bool)
        grid[tuple(a - f for a, f in zip(at, first, strict=True))] = True
        for axis, r in enumerate(reach):
            if r:
                grid = dilated(grid, axis, r)
        matching[tuple(slice(a, b) for a, b in zip(first, last, strict=True))] += grid
        for corner in itertools.product((0, 1), repeat=len(reach)):
            corners[tuple(b if c else a for a, b, c in zip(first, last, corner, strict=True))] += (-1) ** sum(corner)
    for axis in range(len(reach)):
        corners = corners.cumsum(axis)
    return corners[(slice(0, cells),) * len(reach)], matching


def read_by_query(rows: DataFrame, dimensions: Sequence[Dimension], cells: int = CELLS) -> DataFrame:
    """cell, files_touched, files_matching for the queries of all cells that any file touches: at most cells ** dimensions rows. `rows`: file, cell."""
    reach = [d.reach for d in dimensions]
    if cells ** len(reach) > MOST_CELLS:
        raise ValueError("too many cells: use fewer coordinates or dimensions")
    held = rows.groupBy("file").agg(F.collect_set("cell").alias("held"))  # a file has a bounded number of rows

    def run(batches):
        touched = matching = None
        for batch in batches:
            lists = batch.column("held")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            t, m = counted_cells([values[a:b] for a, b in itertools.pairwise(ends)], cells, reach)
            touched, matching = (t, m) if touched is None else (touched + t, matching + m)
        if touched is not None:
            at = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(touched.ravel()[at]), pa.array(matching.ravel()[at])], ["cell", "touched", "matching"])

    part = held.select("held").mapInArrow(run, "cell long, touched long, matching long")
    return part.groupBy("cell").agg(F.sum("touched").alias("files_touched"), F.sum("matching").alias("files_matching"))


def clustered(df: DataFrame, dimensions: Sequence[Dimension], id_column: str = "doc_id", carried: Sequence[str] | None = None, cells: int = CELLS, file_rows: int = FILE_ROWS, interleave: Sequence[str] | None = None) -> DataFrame:
    """The `carried` columns (all by default) with coordinates, z, position, file, file_bounds, and files_touched and files_matching of the query around the row's own cell."""
    n = len(dimensions)
    cell = F.lit(0).cast("long")
    for i in range(n):
        cell = cell * cells + F.col(f"c{i}")
    laid = settled(bounds(placed(df, dimensions, id_column, carried, cells, file_rows, interleave), n).withColumn("cell", cell))
    counts = read_by_query(laid.select("file", "cell"), dimensions, cells)
    keep = [c for c in laid.columns if c.lower() not in ("cell", "files_touched", "files_matching")]
    # One row a cell, whose number is bounded by the shape of the grid.
    return laid.join(F.broadcast(counts), "cell").select(*[X.quoted(c) for c in keep], "files_touched", "files_matching")


def write_files(laid: DataFrame, folder: str) -> None:
    """Writes rows with their file and position as Parquet, a folder a file, rows in order of position; file_bounds stay with the rows, whose statistics Parquet keeps."""
    laid.repartition(F.col("file")).sortWithinPartitions("file", "position").write.partitionBy("file").parquet(folder)


def in_neighbourhood(rows: DataFrame, cell: Sequence[int], dimensions: Sequence[Dimension]) -> DataFrame:
    """Rows inside the query around a cell; over what `write_files` wrote, only files and row groups whose bounds meet it are read."""
    for i, (c, d) in enumerate(zip(cell, dimensions, strict=True)):
        rows = rows.where(F.col(f"c{i}").between(c - d.reach, c + d.reach))
    return rows

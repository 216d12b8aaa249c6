"""Polygons: segments, latitude bands, points inside, raster fill, projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import slabs
from geoloom.scratch import materialize

#: Bits of a band's height: 4 194 304 units, 0.42 degrees.
BAND_BITS = 22
#: What it costs to make a piece of a segment, in tests of a point with a piece.
PIECE_COST = 3
#: Pieces and tests from which on slabs are taken, if there are few paths: rows for each are too many then.
MANY_PIECES = 20_000_000
#: Rows and columns of a grid are at most 2 to this power: below a unit there is nothing to tell apart.
MOST_BITS = 30


def located(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id, pos, pos_x, pos_y."""
    x, y = geo.from_node(F.col("lat_code"), F.col("lon_code"))
    return paths.join(nodes, "id").select("path_id", "pos", x.alias("pos_x"), y.alias("pos_y"))


def segments(places: DataFrame) -> DataFrame:
    """path_id, pos, x1, y1, x2, y2 of each step of a path, turned so that y1 <= y2."""
    w = Window.partitionBy("path_id").orderBy("pos")
    s = places.withColumns({"px": F.lag("pos_x").over(w), "py": F.lag("pos_y").over(w)}).where("px is not null")
    down = F.col("py") <= F.col("pos_y")
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    return s.select("path_id", "pos", pick("px", "pos_x").alias("x1"), F.least("py", "pos_y").alias("y1"), pick("pos_x", "px").alias("x2"), F.greatest("py", "pos_y").alias("y2"))


def bands(seg: DataFrame, bits: int = BAND_BITS) -> DataFrame:
    """Segments once for every band of 2^bits units that a point crossing them can lie in; flat ones can't be crossed."""
    return seg.where("y1 < y2").withColumn("band", F.explode(F.sequence(F.shiftright(F.col("y1") + 1, bits), F.shiftright("y2", bits))))


@dataclass(frozen=True)
class Grid:
    """Rows of 2^row_bits units, numbered as bands are; 2^levels columns of 2^column_bits units from x on."""

    row_bits: int
    column_bits: int
    levels: int
    x: int

    @classmethod
    def over(cls, seg: DataFrame, points: int) -> Grid:
        """Cells for so many points: smaller ones save tests of points, but cut segments into more pieces.

        A point is tested with about n / k of n segments where there are k rows and columns, and a segment that spans
        a share f of the height has about 2 f k pieces; the sum is least at the k taken here.
        """
        side = F.greatest(F.col("y2") - F.col("y1"), F.abs(F.col("x2") - F.col("x1")))
        s = seg.agg(F.min("y1").alias("y0"), F.max("y2").alias("y9"), F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.avg(side).alias("side")).first()
        if s.y0 is None:
            return cls(0, 0, 0, 0)
        height, width = s.y9 - s.y0 + 1, s.x9 - s.x0 + 1
        share = max(s.side, 1.0) / max(height, width)
        k = min(2**MOST_BITS, max(1.0, math.sqrt(0.85 * points / (share * PIECE_COST))))
        bits = lambda size: max(0, math.ceil(math.log2(size / k)))
        column_bits = bits(width)
        return cls(bits(height), column_bits, ((width - 1) >> column_bits).bit_length(), s.x0)

    def row(self, y: Column) -> Column:
        return F.shiftright(y, self.row_bits)

    def column(self, x: Column) -> Column:
        return F.least(F.greatest(F.shiftright(x - self.x, self.column_bits), F.lit(0)), F.lit((1 << self.levels) - 1)).cast("long")

    def in_blocks(self, rows: DataFrame, low: str, end: str) -> DataFrame:
        """rows once for each block of 2^level columns, at most two a level, that make up its columns low to end - 1."""
        out = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col(end) - F.col(low))) - 1)))
        lo, hi = F.expr(f"shiftright({low} + shiftleft(1L, level) - 1, level)"), F.expr(f"shiftright({end}, level)")
        out = out.withColumns({"_lo": lo, "_hi": hi})
        first, last = F.when(F.expr("_lo % 2 = 1 and _lo < _hi"), F.col("_lo")), F.when(F.expr("_hi % 2 = 1 and _hi > _lo + _lo % 2"), F.col("_hi") - 1)
        return out.withColumn("block", F.explode(F.array(first, last))).where("block is not null").drop("_lo", "_hi")


def _pieces(seg: DataFrame, grid: Grid) -> DataFrame:
    """seg once for every row it crosses, with the first and last y there (low, high) and columns (left, right)."""
    rows = seg.where("y1 < y2").withColumn("row", F.explode(F.sequence(grid.row(F.col("y1") + 1), grid.row(F.col("y2")))))
    first = F.shiftleft("row", grid.row_bits)
    cut = rows.withColumns({"low": F.greatest(F.col("y1") + 1, first), "high": F.least(F.col("y2"), first + ((1 << grid.row_bits) - 1))})
    a, b = (geo.crossing(F.col(y), *(F.col(c) for c in ("x1", "y1", "x2", "y2"))) for y in ("low", "high"))
    cut = cut.withColumns({"a": a, "b": b})
    return cut.withColumns({"left": grid.column(F.least("a", "b")), "right": grid.column(F.greatest("a", "b"))}).drop("a", "b")


def _passed(pieces: DataFrame, grid: Grid) -> DataFrame:
    """path_id, row, y, left, end: in the columns left to end - 1 and from y on, an odd number of pieces lies wholly to the left.

    A piece is passed by every cell of its row to the right of it, from its first y to its last: it turns the parity
    at both.  Where two segments of a path share a point they turn it twice, so of most points nothing stays but the
    columns between the two pieces, and of a row's first y the columns between one passing piece and the next.
    """
    top = F.shiftleft(F.col("row") + 1, grid.row_bits)
    turns = F.explode(F.when(F.col("high") + 1 < top, F.array(F.col("low"), F.col("high") + 1)).otherwise(F.array("low")))
    at = pieces.select("path_id", "row", turns.alias("y"), (F.col("right") + 1).alias("left"))
    odd = at.groupBy("path_id", "row", "y", "left").agg(F.count("*").alias("n")).where("n % 2 = 1")
    w = Window.partitionBy("path_id", "row", "y").orderBy("left")
    out = odd.withColumns({"rank": F.row_number().over(w), "end": F.coalesce(F.lead("left").over(w), F.lit(1 << grid.levels).cast("long"))})
    return out.where("rank % 2 = 1 and left < end").select("path_id", "row", "y", "left", "end")


def in_slabs(seg: DataFrame, points: int) -> bool:
    """Whether so many points meet so many segments of so few paths that slabs are cheaper than cells: they do little for
    each piece and test, but something for each point and path."""
    side = F.greatest(F.col("y2") - F.col("y1"), F.abs(F.col("x2") - F.col("x1")))
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    s = seg.agg(F.count("*").alias("n"), F.approx_count_distinct("path_id").alias("paths"), F.avg(side).alias("side"), F.max(F.greatest(*map(F.abs, ends))).alias("far"),
                F.greatest(F.max("y2") - F.min("y1"), F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("size")).first()
    if not s.n or s.far >= slabs.LARGEST:
        return False
    pieces = 2 * s.n * math.sqrt(points * max(s.side, 1.0) / max(s.size, 1) / PIECE_COST)
    return pieces > MANY_PIECES and s.paths * points < pieces


def points_in_polygons(points: DataFrame, seg: DataFrame, key: str, grid: Grid | None = None) -> DataFrame:
    """path_id and key of the points (key, pos_x, pos_y) that lie in a path's polygon, by the parity of crossings.

    A grid of cells whose size follows the data parts the work.  A point is tested exactly only with the segments
    that pass its own cell; of those that lie wholly to the left of the cell only the parity counts, which the cells
    of a row share.  Ranges of columns are held as blocks of 2^level columns, so that a point finds all that concerns
    it by one equi-join on row, level and block.  seg: path_id, pos, x1, y1, x2, y2 with y1 <= y2, as segments()
    gives them; grid: other cells than the data call for, with the same result.  Points that repeat a key count as one if they lie in one place.  Without points or segments the
    result is empty.
    """
    spark = points.sparkSession
    seg = materialize(seg.where("y1 < y2"), "polygon-segments")
    if grid is None:
        n = points.count()
        if in_slabs(seg, n):
            return slabs.points_in_polygons(points, seg, key, n)
        grid = Grid.over(seg, n)
    # few bytes make very many pieces: all tasks make them, whatever the bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pieces = _pieces(seg.repartition(tasks, "path_id", "pos"), grid)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    none = [F.lit(None).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]
    near = pieces.select("path_id", "row", F.lit(None).cast("long").alias("y"), *ends, "left", (F.col("right") + 1).alias("end"))
    beside = _passed(pieces, grid).select("path_id", "row", "y", *none, "left", "end")
    items = grid.in_blocks(near, "left", "end").unionByName(grid.in_blocks(beside, "left", "end")).drop("left", "end")
    level = F.explode(F.sequence(F.lit(0), F.lit(grid.levels))).alias("level")
    spread = points.select(key, "pos_x", "pos_y", grid.row(F.col("pos_y")).alias("row"), grid.column(F.col("pos_x")).alias("column"), level)
    spread = spread.withColumn("block", F.expr("shiftright(column, level)")).repartition(tasks, "row", "level", "block")
    hit = F.when(F.col("y").isNotNull(), F.col("pos_y") >= F.col("y")).otherwise(geo.crosses(F.col("pos_x"), F.col("pos_y"), *ends))
    met = spread.join(items.hint("merge"), ["row", "level", "block"]).where(hit)
    return met.groupBy("path_id", key).agg(F.count("*").alias("n")).where("n % 2 = 1").select("path_id", key)


def bounding_box(places: DataFrame, *by: str) -> DataFrame:
    return places.groupBy(*by).agg(F.min("pos_x").alias("min_x"), F.max("pos_x").alias("max_x"), F.min("pos_y").alias("min_y"), F.max("pos_y").alias("max_y"))


def raster(spark: SparkSession, box: DataFrame, width: int, height: int) -> DataFrame:
    """pixel, pos_x, pos_y of a width x height grid over the one row of box."""
    grid = spark.range(width * height).select(F.col("id").alias("pixel"), (F.col("id") % width).alias("c"), F.floor(F.col("id") / width).alias("r")).join(F.broadcast(box))
    x = F.col("min_x") + F.floor((F.col("max_x") - F.col("min_x")) * F.col("c") / width)
    y = F.col("min_y") + F.floor((F.col("max_y") - F.col("min_y")) * F.col("r") / height)
    return grid.select("pixel", x.alias("pos_x"), y.alias("pos_y"))


def image_width(box: str, height: int, padding: int) -> Column:
    """Width of an image of that height in which a metre is as long across as upright, along the middle of the box.

    box: a struct of min_x, max_x, min_y, max_y in units of 1e-7 degrees, x east and y north.
    """
    x0, x9, y0, y9 = (F.col(f"{box}.{c}") for c in ("min_x", "max_x", "min_y", "max_y"))
    degrees = lambda c: c / F.lit(geo.UNITS)
    middle = degrees(y0 + F.call_function("div", y9 - y0, F.lit(2).cast("long")))
    across = geo.distance(middle, degrees(x0), middle, degrees(x9))
    upright = geo.distance(degrees(y0), F.lit(0.0), degrees(y9), F.lit(0.0))
    return (F.lit(float(height - 2 * padding)) / upright * across).cast("long") + 2 * padding


def _scales(box: str, height: int, padding: int) -> tuple[Column, Column]:
    """Pixels a unit, across and upright."""
    across = (image_width(box, height, padding) - 2 * padding) / (F.col(f"{box}.max_x") - F.col(f"{box}.min_x")).cast("double")
    return across, F.lit(float(height - 2 * padding)) / (F.col(f"{box}.max_y") - F.col(f"{box}.min_y")).cast("double")


def to_pixel(x: Column, y: Column, box: str, height: int, padding: int) -> tuple[Column, Column]:
    """Pixel (column, row from the top) of a position in an image of that height, the box inside a padding."""
    across, upright = _scales(box, height, padding)
    return ((x - F.col(f"{box}.min_x")) * across).cast("long") + padding, F.lit(height) - ((y - F.col(f"{box}.min_y")) * upright).cast("long") - padding


def from_pixel(column: Column, row: Column, box: str, height: int, padding: int) -> tuple[Column, Column]:
    """The position (x, y) of a pixel."""
    across, upright = _scales(box, height, padding)
    return ((column - padding) / across).cast("long") + F.col(f"{box}.min_x"), ((F.lit(height) - row - padding) / upright).cast("long") + F.col(f"{box}.min_y")


def zigzag_grid(spark: SparkSession, n: int) -> DataFrame:
    """place, x, y of an n x n grid by diagonals, turning at each."""
    g = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    d = F.col("x") + F.col("y")
    # cells on earlier diagonals, in closed form, and the cells before this one on its own
    k, m = d - (n - 1), F.lit(n)
    before = F.when(d < n, d * (d + 1) / 2).otherwise(m * m - (2 * m - 1 - d) * (2 * m - d) / 2)
    low, high = F.greatest(k, F.lit(0)), F.least(d, F.lit(n - 1))
    own = F.when(d % 2 == 1, high - F.col("x")).otherwise(F.col("x") - low)
    return g.select((before + own).cast("long").alias("place"), "x", "y")

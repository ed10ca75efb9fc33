"""Points, rasters, polylines and polygons as plain columns, joined on equal keys.

Rasters join on cell numbers. Polygon edges are listed by horizontal band and polyline segments by
square cell, so a point only meets the geometry of its own band or cell; nothing is cross joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.scalar import one_row
from sightline.operators.ranks import is_small
from sightline.session import settle

# The coordinate reference system of the published sightings, in km. It is a label on
# the coordinates; nothing is reprojected.
CRS = "+proj=utm +zone=32 +datum=WGS84 +units=km +no_defs +ellps=WGS84 +towgs84=0,0,0"

CANDIDATES = 32
LEVELS = 10
SHARE = 16
SPAN = 4096
LOCAL_EDGES = 100_000
FAN = 8
SEGMENT = ("x1", "y1", "x2", "y2")


def with_crs(df: DataFrame, columns: tuple[str, ...], crs: str = CRS) -> DataFrame:
    """Attach the CRS as metadata of coordinate columns."""
    return df.withColumns({c: F.col(c).alias(c, metadata={"crs": crs}) for c in columns})


def points_layer(df: DataFrame, *attributes: str) -> DataFrame:
    return with_crs(df.select(*attributes, "x", "y", F.lit(1).alias("d")), ("x", "y"))


def _with_following(vertices: DataFrame, key: str) -> DataFrame:
    """Every vertex with the next one of its line as x2, y2 (NULL for the last) and the line's first as x0, y0.

    Windows run inside spans of ``SPAN`` numbers; the first vertex of each span, a small table, gives the step to the next
    span. So a line of any length spreads over tasks, and gaps in ``seq`` do not matter.
    """
    point = F.struct("x", "y").alias("point")
    cut = vertices.select(key, "seq", point, F.floor(F.col("seq") / SPAN).alias("span"))
    spans = cut.groupBy(key, "span").agg(F.min_by("point", "seq").alias("head"))
    line = Window.partitionBy(key).orderBy("span")
    heads = spans.select(key, "span", F.lead("head").over(line).alias("beyond"), F.first("head").over(line).alias("first"))
    inside = cut.withColumn("near", F.lead("point").over(Window.partitionBy(key, "span").orderBy("seq")))
    joined = inside.join(heads, [key, "span"]).withColumn("next", F.coalesce("near", "beyond"))
    return joined.select(key, "seq", *[
        F.col(f"{of}.{c}").alias(f"{c}{n}") for n, of in ((1, "point"), (2, "next"), (0, "first")) for c in ("x", "y")])


def line_segments(vertices: DataFrame, key: str = "line_id") -> DataFrame:
    """Segments between consecutive vertices in the order of ``seq``, whatever numbers it skips."""
    found = _with_following(vertices, key)
    return found.filter(F.col("x2").isNotNull() | F.col("y2").isNotNull()).select(key, "seq", *SEGMENT)


def ring_edges(vertices: DataFrame, key: str = "geom_id") -> DataFrame:
    """Edges of closed rings: as ``line_segments`` with the last vertex joined to the first."""
    last = F.col("x2").isNull() & F.col("y2").isNull()
    closed = [F.when(last, F.col(f"{c}0")).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in ("x", "y")]
    return _with_following(vertices, key).select(key, "x1", "y1", *closed)


# ---- rasters ------------------------------------------------------------------------------------

def cell(coordinate: str | Column, origin: float | Column, size: float | Column) -> Column:
    c = F.col(coordinate) if isinstance(coordinate, str) else coordinate
    o, s = (v if isinstance(v, Column) else F.lit(float(v)) for v in (origin, size))
    return F.floor((c - o) / s).cast("int")


def grid_layer(cells: DataFrame, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Number the cells of a regular raster given as x, y, z."""
    return cells.withColumns({"ix": cell("x", x0, dx), "iy": cell("y", y0, dy)})


def point_grid_join(
    points: DataFrame, grid: DataFrame, dx: float, dy: float, out: str = "surf", x0: float = 0.0, y0: float = 0.0
) -> DataFrame:
    """Value of the raster cell under each point, 0 outside the raster."""
    numbered = points.withColumns({"gx": cell("x", x0, dx), "gy": cell("y", y0, dy)})
    values = grid.select(F.col("ix").alias("gx"), F.col("iy").alias("gy"), F.col("z").alias(out))
    return numbered.join(values, ["gx", "gy"], "left").drop("gx", "gy").withColumn(out, F.coalesce(out, F.lit(0.0)))


def pixel_lattice(spark: SparkSession, nx: int, ny: int, extent: Column) -> DataFrame:
    """Centres of an nx by ny lattice over ``extent`` (a struct xmin, xmax, ymin, ymax)."""
    index = spark.range(nx * ny)
    dx = (extent["xmax"] - extent["xmin"]) / F.lit(float(nx))
    dy = (extent["ymax"] - extent["ymin"]) / F.lit(float(ny))
    cells = index.select(
        (F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"),
        dx.alias("dx"), dy.alias("dy"), extent["xmin"].alias("xmin"), extent["ymin"].alias("ymin"),
    )
    return cells.select(
        "ix", "iy", "dx", "dy",
        (F.col("xmin") + (F.col("ix") + 0.5) * F.col("dx")).alias("x"),
        (F.col("ymin") + (F.col("iy") + 0.5) * F.col("dy")).alias("y"),
    )


def extent(df: DataFrame) -> Column:
    return one_row(df, xmin=F.min("x"), xmax=F.max("x"), ymin=F.min("y"), ymax=F.max("y"))


# ---- point in polygon -----------------------------------------------------------------------------

def _crosses(edge: dict[str, Column]) -> Column:
    """A ray from (x, y) to the right crosses the edge; half-open in y, so a vertex counts once."""
    x1, y1, x2, y2 = (edge[k] for k in SEGMENT)
    spans = (y1 <= F.col("y")) != (y2 <= F.col("y"))
    return spans & (F.col("x") < x1 + (F.col("y") - y1) * (x2 - x1) / (y2 - y1))


def inside_polygon(points: DataFrame, edges: DataFrame, key: str, band: float | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """Rows whose (x, y) lies inside the rings (even-odd rule, so holes work too).

    Each edge is listed in the horizontal bands it touches; a band is as high as an edge on average unless given. While
    the list is small (checked), a band carries its edges as an array and the points are filtered where they are, without
    a shuffle. Larger geometry is joined edge by edge and the crossings are counted per distinct place. Both ways give the
    same rows: a point with a null coordinate, or without geometry, is outside; repeated keys and places are judged row by row.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    sloped = edges.filter("y1 <> y2")
    if band is None:
        band = sloped.agg(F.avg(high - low)).first()[0] or 1.0
    banded = sloped.select(*SEGMENT, F.explode(F.sequence(F.floor(low / band), F.floor(high / band))).alias("band"))
    numbered = points.withColumn("band", F.floor(F.col("y") / band))
    if is_small(banded, local):
        lists = banded.groupBy("band").agg(F.collect_list(F.struct(*SEGMENT)).alias("edges"))
        crossed = F.size(F.filter("edges", lambda e: _crosses({k: e[k] for k in SEGMENT})))
        return numbered.join(lists, "band").filter(crossed % 2 == 1).drop("band", "edges")
    places = numbered.select("x", "y", "band").distinct()
    hits = places.join(banded, "band").filter(_crosses({k: F.col(k) for k in SEGMENT}))
    odd = hits.groupBy("x", "y").agg(F.count("*").alias("crossed")).filter("crossed % 2 = 1")
    return points.join(odd.select("x", "y"), ["x", "y"], "left_semi").select(*points.columns)


# ---- nearest line -----------------------------------------------------------------------------------

def _segment_distance(px: Column, py: Column, seg: dict[str, Column]) -> Column:
    x1, y1, x2, y2 = (seg[k] for k in SEGMENT)
    dx, dy = x2 - x1, y2 - y1
    along = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - x1 - t * dx, py - y1 - t * dy)


def _known_segments(segments: DataFrame, line: str) -> DataFrame:
    """Different segments whose four coordinates are finite numbers, with the smallest line of each; others are not part of any line."""
    known = F.lit(True)
    for c in SEGMENT:
        known = known & F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf")))
    return segments.select(line, *[F.col(c).cast("double").alias(c) for c in SEGMENT]).filter(known).groupBy(*SEGMENT).agg(F.min(line).alias(line))


def segment_cells(
    segments: DataFrame, line: str, xmin: float, ymin: float, side: float, most: int = CANDIDATES, levels: int = LEVELS
) -> DataFrame:
    """(level, cx, cy, candidates): the cells of an adaptive lattice with the segments that may be nearest to some point in them.

    The square is one cell of level 0. A cell with more than ``most`` candidates is cut into FAN x FAN cells of the next level, others
    stay, so the lattice is fine only where segments are dense. A segment stays with a cell if its distance to the centre is at most
    the least such distance plus the cell's diagonal; any other is farther than the nearest one from every point of the
    cell. Cutting ends when the cells still to cut list more than ``SHARE`` times all segments, or at the last level: cells far from a dense
    bundle of segments see all of it at nearly one distance. What is left uncut keeps its candidates, so the result never depends on it.
    """
    one = F.struct(line, *SEGMENT)
    active = settle(segments.select(line, *SEGMENT, F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy")), "cells")
    leaves, budget = [], SHARE * active.count()
    for level in range(levels + 1):
        counted = settle(active.groupBy("cx", "cy").agg(F.count("*").alias("held")), "counts")
        crowded = counted.filter(F.col("held") > most)
        listed = crowded.agg(F.sum("held")).first()[0] or 0
        full = crowded.filter(F.lit(level < levels and listed <= budget)).select("cx", "cy")
        settled = active.join(full, ["cx", "cy"], "left_anti")
        leaves.append(settled.groupBy("cx", "cy").agg(F.collect_list(one).alias("candidates")).select(
            F.lit(level).alias("level"), "cx", "cy", "candidates"))
        if not listed or level == levels or listed > budget:
            break
        size = side / FAN ** (level + 1)
        child = F.explode(F.sequence(F.lit(0), F.lit(FAN * FAN - 1))).alias("child")
        split = active.join(full, ["cx", "cy"], "left_semi").select(line, *SEGMENT, "cx", "cy", child).select(
            line, *SEGMENT, (F.col("cx") * FAN + F.col("child") % FAN).alias("cx"), (F.col("cy") * FAN + F.floor(F.col("child") / FAN)).alias("cy"))
        centre = [F.lit(o) + (F.col(c) + 0.5) * F.lit(size) for o, c in ((xmin, "cx"), (ymin, "cy"))]
        measured = split.withColumn("d", _segment_distance(*centre, {k: F.col(k) for k in SEGMENT}))
        best = measured.groupBy("cx", "cy").agg(F.min("d").alias("best"))
        reach = F.col("best") + F.lit(size * 2 ** 0.5 * (1 + 1e-9) + 1e-12 * side)
        active = settle(measured.join(best, ["cx", "cy"]).filter(F.col("d") <= reach).drop("d", "best"), "cells")
    return reduce(DataFrame.union, leaves)


def nearest_line(points: DataFrame, segments: DataFrame, key: str, line: str = "line_id", most: int = CANDIDATES) -> DataFrame:
    """Distance from each point to the nearest line, and which line it is.

    Every point meets the one cell of the adaptive lattice that holds it and measures the few candidates of that cell where it is; with
    few segments the whole square is that cell. Equal distances go to the smallest line. A point with a null or infinite coordinate,
    or without any segment, has NULL for both; segments with a null or infinite end do not count.
    """
    def number(c: str) -> Column:
        return F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double"))

    known = _known_segments(segments, line)
    kind = segments.schema[line].dataType
    nothing = {"dist_obs": F.lit(None).cast("double"), line: F.lit(None).cast(kind)}
    both = F.when(number("x").isNotNull() & number("y").isNotNull(), F.lit(1))
    box = points.agg(*[f(F.when(both == 1, number(c))) for c in "xy" for f in (F.min, F.max)]).first()
    if box[0] is None or known.isEmpty():
        return points.withColumns(nothing)
    xmin, ymin = float(box[0]), float(box[2])
    side = max(float(box[1]) - xmin, float(box[3]) - ymin) or 1.0
    cells = settle(segment_cells(known, line, xmin, ymin, side, most), "segment-cells")
    present = sorted(r.level for r in cells.select("level").distinct().collect())  # at most LEVELS + 1

    def at(c: str, low: float, level: int) -> Column:
        count = FAN ** level
        return F.least(F.floor((number(c) - low) / F.lit(side / count)), F.lit(count - 1)).cast("bigint")

    places = [F.struct(F.lit(v).alias("level"), at("x", xmin, v).alias("cx"), at("y", ymin, v).alias("cy")) for v in present]
    near = F.array_min(F.transform("candidates", lambda s: F.struct(
        _segment_distance(F.col("x").cast("double"), F.col("y").cast("double"), {k: s[k] for k in SEGMENT}).alias("d"), s[line].alias("line"))))
    held = points.select(F.struct(*points.columns).alias("row"), both.alias("known"), *[c for c in ("x", "y")])
    met = held.filter("known = 1").select("row", "x", "y", F.explode(F.array(*places)).alias("at")).select("row", "x", "y", "at.*").join(
        cells, ["level", "cx", "cy"]).select("row", near.alias("near"))
    found = met.select("row.*", F.col("near.d").alias("dist_obs"), F.col("near.line").alias(line))
    return found.unionByName(held.filter("known IS NULL").select("row.*").withColumns(nothing))

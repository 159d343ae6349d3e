"""Map operators: thinned points, tile pyramids, tile covers and overlaps of boxes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occura.functions.tiles import grid_size, pixel_at, tile_bbox, tile_fractions, tile_xy
from occura.operators.nest import OccDataset, once, small_side
from occura.operators.search import SearchSpec, box_filter, matching
from occura.storage import written

#: Highest latitude of the map.
LIMIT = 85.0511287798066


def _points(ds: OccDataset, spec: SearchSpec | None) -> DataFrame:
    found = matching(ds.core, spec or SearchSpec())
    name = F.col("scientificName") if "scientificName" in ds.core.columns else F.lit(None).cast("string")
    return found.select(F.col(ds.core_id).alias("core_id"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lng"), name.alias("scientificName")).filter("lat is not null and lng is not null")


def thin(points: DataFrame, size: float | None, *keys: str) -> DataFrame:
    """One point per cell of ``size`` degrees (and per ``keys``), the smallest as a whole row; all without a size."""
    if size is None:
        return points
    cell = lambda c: F.floor(F.col(c) / F.lit(size))
    return points.groupBy(*keys, cell("lat").alias("_r"), cell("lng").alias("_c")).agg(F.min(F.struct("core_id", "lat", "lng", "scientificName")).alias("p")).select(*keys, "p.*")


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    n = 2.0**z
    lat = lambda r: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * r / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_points(ds: OccDataset, z: int, x: int, y: int, spec: SearchSpec | None = None) -> DataFrame:
    """Thinned points of one tile, its edges included; the box reaches the scan as comparisons."""
    west, south, east, north = tile_box(z, x, y)
    inside = box_filter({"swlng": repr(west), "swlat": repr(south), "nelng": repr(east), "nelat": repr(north)})
    return thin(_points(OccDataset(ds.core.filter(inside), ds.core_id), spec), grid_size(z))


#: What is known of a point; the smallest of a cell is so by these in their order.
POINT = ("core_id", "lat", "lng", "scientificName")


def tile_features(ds: OccDataset, zooms: Iterable[int], spec: SearchSpec | None = None) -> DataFrame:
    """(z, x, y, px, py, core_id, scientificName): each point in its one tile of each zoom, thinned by the zoom's cell.  Zooms without cells have every point."""
    points, sizes, whole = _points(ds, spec).filter(F.abs("lat") <= LIMIT), *_by_size(zooms)
    parts = [_thinned(points, sizes)] if sizes else []
    parts += [_whole(points, whole)] if whole else []
    return _features(functools.reduce(DataFrame.unionByName, parts))


def _by_size(zooms: Iterable[int]) -> tuple[dict[float, list[int]], list[int]]:
    """The zooms that are thinned by their cell's size, from the smallest cells up, and those that are not; the highest zoom first."""
    by_size: dict[float | None, list[int]] = {}
    for z in sorted(set(zooms), reverse=True):
        by_size.setdefault(grid_size(z), []).append(z)
    whole = by_size.pop(None, [])
    return dict(sorted(by_size.items())), whole


def _whole(points: DataFrame, zooms: list[int]) -> DataFrame:
    """(top, zooms, x, y, point): every point, in its tile of the highest zoom, as a feature of all these zooms."""
    x, y = tile_xy(F.col("lat"), F.col("lng"), F.lit(zooms[0]))
    return points.select(F.lit(zooms[0]).alias("top"), F.array(*[F.lit(z) for z in zooms]).alias("zooms"), x.alias("x"), y.alias("y"), *POINT)


def _thinned(points: DataFrame, by_size: dict[float, list[int]]) -> DataFrame:
    """(top, zooms, x, y, point): for each size of cells its thinned points, each in its tile of the size's highest zoom and with the zooms it is a feature of.

    Points are thinned to the smallest cells within tiles of the highest zoom, and each size is made of what is left of the one below it, as tiles nest.
    Cells of different sizes do not nest to the last bit, so a thinned point also keeps the larger cells it lies in.  A cell holds few thinned points, as it
    meets few tiles; they are the features of all the size's zooms but where a smaller one of the cell is in the same tile.
    """
    sizes = list(by_size)
    cells = {size: (f"_r{k}", f"_c{k}") for k, size in enumerate(sizes)}
    cell = lambda c, size: F.floor(F.col(c) / F.lit(size))
    at = by_size[sizes[0]][0]
    x, y = tile_xy(F.col("lat"), F.col("lng"), F.lit(at))
    left = points.select(x.alias("x"), y.alias("y"), *[cell(c, s).alias(n) for s in sizes for c, n in zip(("lat", "lng"), cells[s], strict=True)], *POINT)
    found = []
    for k, size in enumerate(sizes):
        top, kept = by_size[size][0], [n for s in sizes[k:] for n in cells[s]]
        moved = left.select(*[_up(c, F.lit(at - top)).alias(c) for c in ("x", "y")], *kept, *POINT)
        left, at = moved.groupBy("x", "y", *kept).agg(F.min(F.struct(*POINT)).alias("p")).select("x", "y", *kept, "p.*"), top
        before = F.collect_list(F.struct("x", "y")).over(Window.partitionBy(*cells[size]).orderBy(*POINT).rowsBetween(Window.unboundedPreceding, -1))
        every = F.array(*[F.lit(z) for z in by_size[size]])
        same = lambda t, z: (_up(t["x"], top - z) == _up("x", top - z)) & (_up(t["y"], top - z) == _up("y", top - z))  # noqa: B023, E731
        first = F.filter(every, lambda z: ~F.exists("_before", lambda t: same(t, z)))  # noqa: B023
        rows = left.withColumn("_before", before).withColumn("zooms", F.when(F.size("_before") == 0, every).otherwise(first))
        found.append(rows.filter(F.size("zooms") > 0).select(F.lit(top).alias("top"), "zooms", "x", "y", *POINT))
    return functools.reduce(DataFrame.unionByName, found)


def _features(rows: DataFrame, *more: str) -> DataFrame:
    """Features of points with their zooms; what is the same at every zoom is worked out before there is a row for each."""
    across, _, down = tile_fractions(F.col("lat"), F.col("lng"))
    rows = rows.select("top", F.explode("zooms").alias("z"), "x", "y", across.alias("_across"), down.alias("_down"), "core_id", "scientificName", *more)
    rows = rows.select("z", *[_up(c, F.col("top") - F.col("z")).alias(c) for c in ("x", "y")], "_across", "_down", "core_id", "scientificName", *more)
    px, py = pixel_at(F.col("_across"), F.col("_down"), F.col("z"), F.col("x"), F.col("y"))
    return rows.select("z", "x", "y", px.alias("px"), py.alias("py"), "core_id", "scientificName", *more)


def _up(c: str | Column, zooms: Column) -> Column:
    """The column or row of a tile's ancestor so many zooms above."""
    return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, zooms.cast("int"))


def tile_pyramid(ds: OccDataset, zooms: Iterable[int] = range(15), spec: SearchSpec | None = None, part_features: int = 20_000) -> DataFrame:
    """(z, x, y, part, features): a tile's features in rows of about ``part_features``, to be written by zoom.

    Most tiles are one part.  The features of a larger one are dealt over as many parts as it needs, so none of its rows, and no task, holds all of them.

    Thinned points are written once, to be counted and gathered.  Zooms that are not thinned are counted at the lowest of them only: where a tile of it is no
    larger than a part, neither are the tiles it holds, so its points are sent to one task, once, and gathered there for all these zooms.
    """
    points, sizes, whole = _points(ds, spec).filter(F.abs("lat") <= LIMIT), *_by_size(zooms)
    found = [_parted(_features(written(_thinned(points, sizes), "thinned")), part_features)] if sizes else []
    if whole:
        spark = ds.core.sparkSession
        low = [_up(c, F.lit(whole[0] - whole[-1])).alias(f"_{c}") for c in ("x", "y")]
        rows = _whole(points, whole).select("*", *low)
        crowded, held = once(rows.groupBy("_x", "_y").agg(F.count("*").alias("_n")).filter(F.col("_n") > part_features).select("_x", "_y"))
        none = held and crowded.isEmpty()
        crowded = F.broadcast(crowded) if held else crowded
        few = rows if none else rows.join(crowded, ["_x", "_y"], "left_anti")
        few = _features(few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_x", "_y"), "_x", "_y")
        found.append(few.groupBy("_x", "_y", "z", "x", "y").agg(_gathered()).select("z", "x", "y", F.lit(0).alias("part"), "features"))
        if not none:
            found.append(_parted(_features(rows.join(crowded, ["_x", "_y"], "left_semi")), part_features))
    return functools.reduce(DataFrame.unionByName, found)


def _gathered() -> Column:
    return F.sort_array(F.collect_list(F.struct("core_id", "px", "py", "scientificName"))).alias("features")


def _parted(rows: DataFrame, part_features: int) -> DataFrame:
    """Features gathered by tile, those of a large tile dealt over parts."""
    large = rows.groupBy("z", "x", "y").agg(F.count("*").alias("_n")).filter(F.col("_n") > part_features)
    parts = rows.join(small_side(large), ["z", "x", "y"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("core_id"), F.ceil(F.col("_n") / part_features)), F.lit(0)).cast("int"))
    return parts.groupBy("z", "x", "y", "part").agg(_gathered())


def _ranges(boxes: DataFrame, max_zoom: int, low_zoom: int = 0) -> DataFrame:
    """Rows of (west, south, east, north) with the tile ranges of every zoom."""
    rows = boxes.withColumn("z", F.explode(F.sequence(F.lit(low_zoom), F.lit(max_zoom))))
    x0, y0 = tile_xy(F.col("north"), F.col("west"), F.col("z"))
    x1, y1 = tile_xy(F.col("south"), F.col("east"), F.col("z"))
    return rows.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1})


def tile_counts(boxes: DataFrame, max_zoom: int) -> DataFrame:
    """Per box and zoom: its tiles, and those of the whole map up to that zoom."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint") * (F.col("y1") - F.col("y0") + 1)
    return _ranges(boxes, max_zoom).withColumn("tiles", n).withColumn("map_tiles", ((F.pow(F.lit(4.0), F.col("z") + 1) - 1) / 3).cast("bigint")).drop("x0", "x1", "y0", "y1")


def tile_cover(boxes: DataFrame, max_zoom: int) -> DataFrame:
    """All tiles of each box up to a zoom."""
    columns = _ranges(boxes, max_zoom).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return columns.withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("x0", "x1", "y0", "y1")


def tile_sample(boxes: DataFrame, zoom: int, most: int = 16) -> DataFrame:
    """All tiles of a box at a zoom if there are no more than ``most``, else a grid of them spread evenly."""
    side = max(1, math.isqrt(most))
    steps = max(1, side - 1)
    rows = _ranges(boxes, zoom, zoom)
    total = (F.col("x1") - F.col("x0") + 1).cast("bigint") * (F.col("y1") - F.col("y0") + 1)
    spread = lambda a, b: F.when(total <= most, F.sequence(F.col(a), F.col(b))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.col(a) + F.floor(k * (F.col(b) - F.col(a)) / steps).cast("int")))
    return rows.withColumn("x", F.explode(spread("x0", "x1"))).withColumn("y", F.explode(spread("y0", "y1"))).drop("x0", "x1", "y0", "y1").distinct()


def pyramid_size(boxes: DataFrame, max_zoom: int, average: float | None = None) -> DataFrame:
    """Estimated bytes of each box's tiles: a tile's average at the highest zoom grows by half for each zoom above it, five times at most."""
    # Growth by zoom, zooms it goes on for, bytes of a tile without a sample.
    growth, depth, unknown = 1.5, 5, 5000.0
    average = unknown if average is None else average
    each = F.floor(F.lit(average) * F.pow(F.lit(growth), F.least(F.lit(max_zoom) - F.col("z"), F.lit(depth)))).cast("bigint")
    own = [c for c in boxes.columns]
    return tile_counts(boxes, max_zoom).groupBy(*own).agg(F.sum(F.col("tiles") * each).alias("bytes"))


def overlap_join(tiles: DataFrame, regions: DataFrame, deepest: int = 14, salts: int = 16) -> DataFrame:
    """Tiles (z, x, y) with the regions (region, west, south, east, north, max_zoom) that overlap them, touching edges included.

    Bounded regions go before unbounded (null) ones, which serve only tiles without any bounded one.  A region lies in the few tiles of the zoom
    that fits its size; a tile meets it by the tile's ancestor of that zoom, or, if the tile is the larger one, by the region's.  So large regions do
    not gather tiles by place, and small ones do not meet tiles far from them; the tiles below one large region are dealt over ``salts`` parts.
    """
    west, south, east, north = tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    boxed = tiles.select("z", "x", "y").distinct().withColumns({"t_west": west, "t_south": south, "t_east": east, "t_north": north, "_salt": F.pmod(F.xxhash64("x", "y"), F.lit(salts))})
    near = 1e-7  # so that what only touches a region's edge meets it
    keep = lambda c, by, low, high: F.greatest(F.lit(low), F.least(F.col(c) + by, F.lit(high)))

    def corners(z: Column) -> tuple[Column, Column, Column, Column]:
        x0, y0 = tile_xy(keep("north", near, -LIMIT, LIMIT), keep("west", -near, -180.0, 180.0), z)
        x1, y1 = tile_xy(keep("south", -near, -LIMIT, LIMIT), keep("east", near, -180.0, 180.0), z)
        return x0, x1, y0, y1

    def fits(z: Column) -> Column:
        x0, x1, y0, y1 = corners(z)
        return (x1 - x0 <= 1) & (y1 - y0 <= 1)

    bounded = regions.filter("west is not null").withColumn("_level", F.array_max(F.filter(F.sequence(F.lit(0), F.lit(deepest)), fits)))
    x0, x1, y0, y1 = corners(F.col("_level"))
    placed = bounded.withColumn("_x", F.explode(F.sequence(x0, x1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # no more than there are zooms

    ancestors = boxed.withColumn("_level", F.explode(F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k <= F.col("z"))))
    ancestors = ancestors.withColumns({"_x": _up("x", F.col("z") - F.col("_level")), "_y": _up("y", F.col("z") - F.col("_level"))})
    smaller = ancestors.join(placed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), ["_level", "_x", "_y", "_salt"])
    raised = placed.filter("_level > 0").withColumn("z", F.explode(F.sequence(F.lit(0), F.col("_level") - 1)))
    raised = raised.withColumns({"x": _up("_x", F.col("_level") - F.col("z")), "y": _up("_y", F.col("_level") - F.col("z"))}).drop("_x", "_y", "_level").distinct()
    larger = boxed.join(raised, ["z", "x", "y"])
    overlaps = "t_west <= east and t_east >= west and t_south <= north and t_north >= south and z <= max_zoom"
    pairs = smaller.filter(overlaps).select("z", "x", "y", "region").union(larger.filter(overlaps).select("z", "x", "y", "region")).distinct()
    rest = tiles.select("z", "x", "y").distinct().join(pairs, ["z", "x", "y"], "left_anti")
    world = regions.filter("west is null").select("region", F.explode(F.sequence(F.lit(0), F.col("max_zoom"))).alias("z"))
    return pairs.union(rest.join(small_side(world), "z").select("z", "x", "y", "region"))


def box_table(spark: SparkSession, *boxes: tuple[str, float, float, float, float]) -> DataFrame:
    return spark.createDataFrame(list(boxes), "region string, west double, south double, east double, north double")

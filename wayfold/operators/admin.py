"""Administrative areas: readers, containment joins, geometry and the area index.

Areas are covered by square tiles of the smallest size that keeps their number
down; a tile that more than MOST_EDGES edges meet is split into sixteen, again
and again down to the smallest side. A tile wholly inside an area needs no test;
a border tile carries only the edges that meet it and whether its lower left
corner is inside, so no polygon is copied and a point is tested against few
edges. Points meet tiles in an equi-join, once for each size of tile that areas
use around there, and the test is a native count of edges crossed on the way
from that corner. Plain boxes are covered by expressions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.operators.cells import accumulate

#: Datasets in bucket order.
DATASETS = ("cities", "countries", "provinces", "counties")
#: Sides of tiles in degrees, each a quarter of the one before, so that all are exact and nest.
TILES = tuple(16.0 / 4**k for k in range(8))
#: Number of the smallest side that a box alone asks for, and how many tiles it may have before it takes the next larger ones.
FINEST_START, MOST_TILES = 3, 64
#: Edges of a tile before it is split, tiles of one batch, and the largest tiles around the globe each way.
MOST_EDGES, BATCH_TILES, AROUND = 64, 1_024, (24, 12)
#: Degrees within which an edge counts as meeting a tile; more edges than needed do no harm.
SLACK = 1e-9
RINGS = "array<array<struct<lon:double,lat:double>>>"
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
BOX = ("min_lon", "max_lon", "min_lat", "max_lat")


def area_key(dataset: Column) -> Column:
    """Key of an area's place names; null where a needed part is missing. Counties exist in the USA only."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    country, province = part("country_code3"), F.concat_ws("-", part("country_code3"), part("province_code"))
    below = lambda c: F.when(part("country_code3").isNotNull() & part("province_code").isNotNull() & part(c).isNotNull(), F.concat_ws("-", province, part(c)))
    return (
        F.when(dataset == "countries", country)
        .when(dataset == "provinces", F.when(country.isNotNull() & part("province_code").isNotNull(), province))
        .when(dataset == "counties", F.when(country == "USA", below("county")))
        .when(dataset == "cities", below("city"))
    )


def read_areas(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Areas of a file of polygon and multipolygon features, one a line, keyed by their place-name properties."""
    v = F.try_parse_json("value")
    rows = spark.read.text(path).select(v.alias("v")).where("v is not null")
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    named = rows.select(
        *(get(f"$.properties.{c}", "string").alias(c) for c in ("country_code3", "province_code", "county", "city")),
        F.when(get("$.geometry.type", "string") == "Polygon", get("$.geometry.coordinates", "array<array<array<double>>>")).otherwise(F.flatten(get("$.geometry.coordinates", "array<array<array<array<double>>>>"))).alias("xy"),
    )
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    shaped = named.withColumn("rings", F.transform("xy", lambda ring: F.transform(ring, point))).withColumn("all", F.flatten("rings"))
    low, high = (lambda c: F.array_min(F.transform("all", lambda p: p[c]))), (lambda c: F.array_max(F.transform("all", lambda p: p[c])))
    box = [low("lon").alias("min_lon"), high("lon").alias("max_lon"), low("lat").alias("min_lat"), high("lat").alias("max_lat")]
    return shaped.select(F.lit(dataset).alias("dataset"), area_key(F.lit(dataset)).alias("area_key"), *box, "rings").where("area_key is not null and rings is not null")


def tile_side(size: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TILES)), size + 1)


def start_size() -> Column:
    """Number of the smallest side, FINEST_START at most, that covers a box in MOST_TILES, else of the largest."""
    span = lambda low, high, side: F.floor(F.col(high) / side) - F.floor(F.col(low) / side) + 1
    fits = lambda side: span("min_lon", "max_lon", side) * span("min_lat", "max_lat", side) <= MOST_TILES
    return F.coalesce(*(F.when(fits(TILES[k]), F.lit(k)) for k in range(FINEST_START, -1, -1)), F.lit(0))


def meeting(edges: np.ndarray, x: float, y: float, side: float) -> np.ndarray:
    """The edges that meet a closed tile: their boxes do, and its corners are not all on one side of their line."""
    x1, y1, x2, y2 = edges.T
    near = lambda a, b, low: (np.minimum(a, b) <= low + side + SLACK) & (np.maximum(a, b) >= low - SLACK)
    dx, dy = x2 - x1, y2 - y1
    turns = np.stack([dx * (cy - y1) - dy * (cx - x1) for cx in (x, x + side) for cy in (y, y + side)])
    slack = SLACK * (np.abs(dx) + np.abs(dy))
    return edges[near(x1, x2, x) & near(y1, y2, y) & (turns.min(0) <= slack) & (turns.max(0) >= -slack)]


def crossings_odd(edges: np.ndarray, x0: float, y0: float, x: float, y: float) -> bool:
    """What crossed() counts, for one point."""
    x1, y1, x2, y2 = edges.T
    turn = lambda px, py: (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    rising = ((x2 > x1) & (y2 > y1)) | ((x2 < x1) & (y2 < y1))
    right = lambda t: np.where(y2 > y1, t > 0, t < 0) | ((t == 0) & rising)
    above = lambda t: np.where(x2 > x1, t < 0, t > 0)
    bend = turn(x, y0)
    first = ((y1 > y0) != (y2 > y0)) & right(turn(x0, y0)) & ~right(bend)
    second = ((x1 > x) != (x2 > x)) & above(bend) & ~above(turn(x, y))
    return bool((np.count_nonzero(first) + np.count_nonzero(second)) % 2)


def split(size: int, tx: int, ty: int, corner: bool, edges: np.ndarray) -> Iterator[dict]:
    """Tiles of one tile: itself, or those of its sixteen parts where too many edges meet it; outer ones are left out."""
    if not len(edges):
        if corner:
            yield {"size": size, "tx": tx, "ty": ty}
    elif len(edges) <= MOST_EDGES or size + 1 == len(TILES):
        own = [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in edges.tolist()]
        yield {"size": size, "tx": tx, "ty": ty, "corner_inside": corner, "edges": own}
    else:
        x0, y0, side = tx * TILES[size], ty * TILES[size], TILES[size + 1]
        for cx in range(4 * tx, 4 * tx + 4):
            for cy in range(4 * ty, 4 * ty + 4):
                x, y = cx * side, cy * side
                yield from split(size + 1, cx, cy, corner != crossings_odd(edges, x0, y0, x, y), meeting(edges, x, y, side))


def cover_boxes(areas: DataFrame) -> DataFrame:
    """cover() of areas by their boxes alone, without Python."""
    side = tile_side(F.col("size"))
    along = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side).cast("long"), F.floor(F.col(high) / side).cast("long")))
    sized = areas.select("dataset", "area_key", *BOX, start_size().alias("size")).where("min_lon <= max_lon and min_lat <= max_lat")
    return sized.withColumn("tx", along("min_lon", "max_lon")).withColumn("ty", along("min_lat", "max_lat")).withColumns({"corner_inside": F.lit(None).cast("boolean"), "edges": F.lit(None).cast(EDGES)})


def cover(areas: DataFrame) -> DataFrame:
    """Tiles of all areas: dataset, area_key, box, size, tx, ty, corner_inside and edges (null where no test is needed)."""

    def tiles_of(row: dict) -> Iterator[dict]:
        rings = [[(p["lon"], p["lat"]) for p in ring] for ring in row["rings"]]
        edges = np.array([(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True)], dtype=float).reshape(-1, 4)
        edges, size = edges[(edges[:, :2] != edges[:, 2:]).any(1)], row["size"]
        side, known = TILES[size], {c: row[c] for c in ("dataset", "area_key", *BOX)}
        ranges = (range(int(np.floor(row[a] / side)), int(np.floor(row[b] / side)) + 1) for a, b in (BOX[:2], BOX[2:]))
        tx, ty = np.meshgrid(*ranges)
        outside = min(row["min_lon"], *edges[:, [0, 2]].ravel().tolist()) - 2 * TILES[0]
        for x, y in zip(tx.ravel().tolist(), ty.ravel().tolist(), strict=True):
            corner = crossings_odd(edges, outside, y * side, x * side, y * side)
            yield from (known | tile for tile in split(size, x, y, corner, meeting(edges, x * side, y * side, side)))

    edge = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
    made = pa.schema([("dataset", pa.string()), ("area_key", pa.string()), *((c, pa.float64()) for c in BOX), ("size", pa.int32()), ("tx", pa.int64()), ("ty", pa.int64()), ("corner_inside", pa.bool_()), ("edges", pa.list_(edge))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tiles = tiles_of(batch.slice(k, 1).to_pylist()[0])
                while some := list(islice(tiles, BATCH_TILES)):
                    yield pa.RecordBatch.from_pylist(some, made)

    kind = f"dataset string, area_key string, {', '.join(f'{c} double' for c in BOX)}, size int, tx long, ty long, corner_inside boolean, edges {EDGES}"
    shaped = areas.where("rings is not null").select("dataset", "area_key", *BOX, "rings", start_size().alias("size")).mapInArrow(run, kind)
    return shaped.unionByName(cover_boxes(areas.where("rings is null")))


def crossed(x: Column, y: Column, x0: Column, y0: Column, edges: Column) -> Column:
    """Whether an odd number of edges is crossed on the way from (x0, y0) along y0 to x, then along x to y.

    All points count as moved up by a little and right by far less, and sides
    are told by one exact sign, so that vertices on corners of tiles do no harm.
    """

    def crosses(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        turn = lambda px, py: dx * (py - e["y1"]) - dy * (px - e["x1"])
        right = lambda t: F.when(dy > 0, t > 0).otherwise(t < 0) | ((t == 0) & (((dx > 0) & (dy > 0)) | ((dx < 0) & (dy < 0))))
        above = lambda t: F.when(dx > 0, t < 0).otherwise(t > 0)
        first = ((e["y1"] > y0) != (e["y2"] > y0)) & right(turn(x0, y0)) & ~right(turn(x, y0))
        second = ((e["x1"] > x) != (e["x2"] > x)) & above(turn(x, y0)) & ~above(turn(x, y))
        return first != second

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses(e))


def locate(points: DataFrame, areas: DataFrame, refine: bool = True) -> DataFrame:
    """Points joined with every area that holds them.

    areas: dataset, area_key, min_lon, max_lon, min_lat, max_lat and rings
    (array of arrays of (lon, lat) structs, null for plain boxes). Boxes are
    half-open: they hold their lower edges. Without refine the boxes alone count.
    """
    tiles = cover(areas) if refine else cover_boxes(areas)
    wide, high = AROUND
    around = lambda x, y: {"__wx": F.pmod(x, F.lit(wide)), "__wy": F.pmod(y, F.lit(high))}
    used = tiles.select("size", *(c.alias(n) for n, c in around(F.expr("shiftright(tx, 2 * size)"), F.expr("shiftright(ty, 2 * size)")).items()))
    used = used.groupBy("__wx", "__wy").agg(F.collect_set("size").alias("__sizes"))
    tile_of = lambda c, side: F.floor(F.col(c) / side).cast("long")
    # At most AROUND's product of rows, each of at most as many numbers as there are sizes.
    placed = points.withColumns(around(tile_of("lon", TILES[0]), tile_of("lat", TILES[0]))).join(F.broadcast(used), ["__wx", "__wy"])
    placed = placed.withColumn("__size", F.explode("__sizes")).drop("__sizes", "__wx", "__wy")
    placed = placed.withColumns({"__tx": tile_of("lon", tile_side(F.col("__size"))), "__ty": tile_of("lat", tile_side(F.col("__size")))})
    boxed = (F.col("lon") >= F.col("min_lon")) & (F.col("lon") < F.col("max_lon")) & (F.col("lat") >= F.col("min_lat")) & (F.col("lat") < F.col("max_lat"))
    found = placed.join(tiles, (F.col("__size") == F.col("size")) & (F.col("__tx") == F.col("tx")) & (F.col("__ty") == F.col("ty"))).where(boxed)
    side = tile_side(F.col("size"))
    odd = crossed(F.col("lon"), F.col("lat"), F.col("tx") * side, F.col("ty") * side, F.col("edges"))
    return found.where(F.col("edges").isNull() | (F.col("corner_inside") != odd)).select(*points.columns, "dataset", "area_key")


def admin_index(points: DataFrame, areas: DataFrame, visit_gap_s: int = Settings.admin_visit_s, refine: bool = True, width: int = Settings.bucket_s) -> DataFrame:
    """Accumulators by subject, dataset and area; points outside every area are skipped."""
    return accumulate(locate(points, areas, refine), ["subject_id", "dataset", "area_key"], visit_gap_s, width)


def enrich(index: DataFrame, areas: DataFrame) -> DataFrame:
    """Accumulators of areas with the areas' rings and boxes: the rows of an area layer."""
    return index.join(areas, ["dataset", "area_key"])


def geometry(points: DataFrame, areas: DataFrame, dataset: str) -> DataFrame:
    """Points with the key and rings of the area of one dataset that holds them; null where none does."""
    mine = areas.where(F.col("dataset") == dataset)
    found = locate(points, mine).join(mine.select("area_key", "rings"), "area_key").drop("dataset")
    return points.join(found.select(*(F.col(c).alias(f"__g_{c}") for c in ("event_id",)), "area_key", "rings"), F.col("event_id") == F.col("__g_event_id"), "left").drop("__g_event_id")

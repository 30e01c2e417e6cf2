"""Building ways and their nodes, per scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from relief.functions.projection import forward, reproject_point
from relief.operators.quadtree import overlapping
from relief.stores import replace_rows

_ELEMENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
DOCUMENT = T.StructType([T.StructField("elements", T.ArrayType(_ELEMENT))])


def split_elements(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of documents with an `elements` array; relations are unused.

    Documents of neighbouring scenes share elements, so each id is kept once.
    """
    elements = documents.select(F.inline("elements"))
    nodes = elements.where("type = 'node'").select("id", "lon", "lat").dropDuplicates(["id"])
    ways = elements.where("type = 'way' AND nodes IS NOT NULL").select("id", "nodes", "tags").dropDuplicates(["id"])
    return nodes, ways


def read_osm_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_elements(spark.read.schema(DOCUMENT).option("multiLine", True).json(path))


def cache_key(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Key of a scene's stored buildings, from its bounds at five decimals."""
    return F.substring(F.sha2(F.format_string("%.5f,%.5f,%.5f,%.5f", min_lat, min_lon, max_lat, max_lon), 256), 1, 16)


def with_cache_key(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("cache_key", cache_key(*[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]))


def cached_and_missing(scenes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes whose key is in the stored table, and those still to be loaded."""
    keyed = with_cache_key(scenes)
    keys = cache.select("cache_key").distinct()
    return keyed.join(keys, "cache_key", "left_semi"), keyed.join(keys, "cache_key", "left_anti")


def store_ways(ways: DataFrame, path: str, keys: DataFrame | None = None) -> None:
    """Store ways under their cache key, in place of earlier ones.

    Keys of `keys` without ways are kept too, as areas known to hold none.
    """
    replace_rows(ways, path, "cache_key", keys)


def way_bounds(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longitude and latitude range of each way's known nodes."""
    return (
        ways.select(F.col("id").alias("way_id"), F.explode("nodes").alias("node_id"))
        .join(nodes.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")
        .groupBy("way_id")
        .agg(
            F.min("lon").alias("w_min_lon"),
            F.max("lon").alias("w_max_lon"),
            F.min("lat").alias("w_min_lat"),
            F.max("lat").alias("w_max_lat"),
        )
    )


def scene_boxes(scenes: DataFrame) -> DataFrame:
    """Longitude and latitude range of each located scene's corners."""

    def corner(x: Column, y: Column) -> Column:
        lon, lat = reproject_point(*forward(F.col("transform"), x, y), F.col("crs"), F.lit("EPSG:4326"))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    zero, width, height = F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")
    corners = F.array(corner(zero, zero), corner(width, zero), corner(zero, height), corner(width, height))
    boxes = scenes.select("scene_id", F.inline(corners)).groupBy("scene_id").agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat")
    )
    return boxes.where("min_lon IS NOT NULL AND min_lat IS NOT NULL")


def ways_in_scenes(bounds: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, way_id) pairs whose boxes overlap.

    Boxes meet on quadtree cells of the globe, each on the level of its own
    size, so that a vast scene is a few rows and a dense town spreads. The
    overlap itself is tested in degrees.
    """

    def on_unit(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
        spans = [(f"{prefix}{end}_{axis}", half) for end in ("min", "max") for axis, half in (("lon", 180.0), ("lat", 90.0))]
        return df.withColumns({n: (F.col(c) + half) / (2 * half) for n, (c, half) in zip(names, spans, strict=True)})

    of_way, of_scene = ([f"_{side}{k}" for k in range(4)] for side in ("w", "s"))
    pairs = overlapping(
        on_unit(bounds, "w_", of_way), on_unit(scenes, "", of_scene), of_way, of_scene, ["way_id"], ["scene_id"], []
    )
    overlap = (F.greatest("w_min_lon", "min_lon") <= F.least("w_max_lon", "max_lon")) & (
        F.greatest("w_min_lat", "min_lat") <= F.least("w_max_lat", "max_lat")
    )
    return pairs.where(overlap).select("scene_id", "way_id")


__all__ = [
    "DOCUMENT",
    "cache_key",
    "cached_and_missing",
    "read_osm_json",
    "scene_boxes",
    "split_elements",
    "store_ways",
    "way_bounds",
    "ways_in_scenes",
    "with_cache_key",
]

"""Known scenes and depth models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.projection import square_bounds, transform_from_bounds

# 1024 m squares in EPSG:26985 (left, bottom, right, top).
BOXED_SCENES = (
    ("downtown", 397800.0, 135000.0, 398824.0, 136024.0, "Dense high-rise core"),
    ("mall", 396200.0, 134400.0, 397224.0, 135424.0, "Open ground and low monuments"),
    ("rock-creek", 395400.0, 139000.0, 396424.0, 140024.0, "Forested valley with relief"),
    ("residential", 399600.0, 140200.0, 400624.0, 141224.0, "Low-rise housing and tree cover"),
    ("waterfront", 399000.0, 132600.0, 400024.0, 133624.0, "River, bridges, flat terrain"),
)
# Centre latitude and longitude, pixels a side, metres a side.
CENTRED_SCENES = (
    ("mumbai-bkc", 19.0658, 72.8685, 1024, 650.0),
    ("mumbai-nariman", 18.9265, 72.8235, 1024, 650.0),
    ("mumbai-cst", 18.9400, 72.8350, 1024, 650.0),
    ("delhi-cp", 28.6315, 77.2167, 1024, 650.0),
    ("bengaluru-techpark", 13.0485, 77.6210, 1024, 650.0),
)
# Model size, millions of parameters, download in MiB.
MODELS = (
    ("small", "depth-anything/Depth-Anything-V2-Small-hf", 24.8, 100),
    ("base", "depth-anything/Depth-Anything-V2-Base-hf", 97.5, 390),
    ("large", "depth-anything/Depth-Anything-V2-Large-hf", 335.3, 1350),
)


def located(scenes: DataFrame) -> DataFrame:
    """Add the pixel transform to rows with bounds, width and height."""
    b = F.col("bounds")
    return scenes.withColumn(
        "transform",
        transform_from_bounds(b["left"], b["bottom"], b["right"], b["top"], F.col("width"), F.col("height")),
    )


def centred_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes from scene_id, lat, lon, size and span: Web Mercator squares."""
    boxed = scenes.select(
        "scene_id",
        F.col("size").cast("int").alias("width"),
        F.col("size").cast("int").alias("height"),
        F.lit("EPSG:3857").alias("crs"),
        square_bounds("lat", "lon", F.col("span")).alias("bounds"),
    )
    return located(boxed)


def scene_catalog(spark: SparkSession, size: int = 1024) -> DataFrame:
    boxed = spark.createDataFrame(
        BOXED_SCENES, "scene_id string, left double, bottom double, right double, top double, description string"
    )
    fixed = located(
        boxed.select(
            "scene_id",
            F.lit(size).alias("width"),
            F.lit(size).alias("height"),
            F.lit("EPSG:26985").alias("crs"),
            F.struct("left", "bottom", "right", "top").alias("bounds"),
        )
    )
    centred = spark.createDataFrame(CENTRED_SCENES, "scene_id string, lat double, lon double, size int, span double")
    return fixed.unionByName(centred_scenes(centred))


def model_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MODELS, "alias string, model_id string, parameters_millions double, download_mib int"
    )

"""Readers of the given tables, and frame streams, polylines and meshes derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions.exprs import xyz

#: Landmarks of a frame; triangle t of a frame has the landmarks t, t + 1 and t + 2.
LANDMARKS = 21
PIXELS = 100.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt over four tasks a core by their key, for those whose work outweighs their bytes: a small file is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as a frame of 21 landmarks with three coordinates: frame, label, embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", "embedding")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's first nine numbers as a point, a tangent and a target: id, label, x..z, tx..tz, qx..qz."""
    v = xyz(F.col("embedding"), 0, 9)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *(c.alias(n) for c, n in zip(v, ("x", "y", "z", "tx", "ty", "tz", "qx", "qy", "qz"), strict=True)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in each user's order: user_id, event_id, seq (from 0), t (seconds), value, event_type."""
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")) - 1)


def triangle_corners(vector, t) -> list[list]:
    """The three landmarks of triangle t of a frame's vector, in pixels."""
    return [[F.get(vector, (t + k) * 3 + i).cast("double") * PIXELS for i in range(3)] for k in range(3)]


def terrain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A surface for each label: its vectors are the rows of a height field, their first 21 numbers the columns. Vertices (label, v, x, y, z) and faces (label, tri, i0, i1, i2), two to a cell; v counts along the rows."""
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "embeddings").withColumns({"r": F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1, "rows": F.count("*").over(W.partitionBy("label"))})
    cells = rows.select("label", "r", "rows", F.posexplode(F.slice("embedding", 1, LANDMARKS)).alias("c", "z"))
    v = F.col("r") * LANDMARKS + F.col("c")
    vertices = cells.select("label", v.alias("v"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    square = F.array(*(F.struct((((F.col("r") * (LANDMARKS - 1) + F.col("c")) * 2) + h).cast("long").alias("tri"), *(i.alias(f"i{j}") for j, i in enumerate(corners))) for h, corners in enumerate(((v, v + 1, v + LANDMARKS), (v + LANDMARKS + 1, v + LANDMARKS, v + 1)))))
    faces = cells.filter((F.col("r") < F.col("rows") - 1) & (F.col("c") < LANDMARKS - 1)).select("label", F.explode(square).alias("t")).select("label", "t.*")
    return vertices, faces


def cornered(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """faces (tri, i0, i1, i2) as triangles (by, tri, x0..z2)."""
    for j in range(3):
        faces = faces.join(vertices.select(*by, F.col("v").alias(f"i{j}"), *(F.col(n).alias(f"{n}{j}") for n in "xyz")), [*by, f"i{j}"])
    return faces.select(*by, "tri", *(f"{n}{j}" for j in range(3) for n in "xyz"))

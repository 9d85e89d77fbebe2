"""Density clusters of vectors, their grid of parameters, and how stable they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.operators import density
from assaykit.plans.registry import query
from assaykit.sources.tables import read


@query()
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density cluster of every vector, null for noise. Fifteen random directions stand for a learned embedding, which Spark lacks."""
    return density.density_clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10, min_cluster_size=10, min_samples=5, dims=15, seed=42)


@query()
def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, noise and sizes of 24 combinations of neighbours, least size and samples, read from six trees."""
    return density.cluster_grid(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of clusters under three seeds, pair by pair, with its mean."""
    pairs = density.seed_stability(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pairs.withColumn("mean_ari", F.avg("ari").over(Window.partitionBy())).withColumns({c: F.round(c, 4) for c in ("ari", "mean_ari")})

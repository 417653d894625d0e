"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytofleet.plans import q_cells, q_population, q_priors, q_raster, q_rules, q_sources, q_spatial  # noqa: F401
from cytofleet.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top cells per field by composite score, from raw pixels and masks."""
    from pyspark.sql import functions as F

    from cytofleet.operators import cells as D
    from cytofleet.operators import population as P
    from cytofleet.plans.adapters import labels, pixels

    lab = labels(spark, sf_dir)
    yap = D.nuclear_partition(D.over(pixels(spark, sf_dir, ["yap"]), lab))
    c = D.moments(lab).join(yap, D.CELL).withColumn("cell_area", F.col("area").cast("double"))
    panel = ["yap_nc_ratio", "yap_nuclear_intensity", "aspect_ratio", "-eccentricity"]
    scored = P.composite_score(P.residualise(c), panel, mode="weighted_sum")
    return P.top_cells(scored).select(*D.CELL, "rank", F.round("mechano_score", 6).alias("mechano_score"))

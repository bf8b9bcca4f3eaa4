"""Volumes per participant and means per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_volume(voxels: DataFrame, threshold: int) -> DataFrame:
    """Foreground voxels ``(block_id, volume)``: those above ``threshold``."""
    return voxels.groupBy("block_id").agg(F.count_if(F.col("v") > threshold).alias("volume"))


def participant_volume(images: DataFrame, volumes: DataFrame) -> DataFrame:
    """Attach block volumes to ``images(site, subject, image_id)``.

    Volumes are already one row per image, so the join moves metadata and no voxels. An image
    whose voxels could not be read keeps its row, with ``error`` set and no volume.
    """
    known = volumes if "error" in volumes.columns else volumes.withColumn("error", F.lit(None).cast("string"))
    right = known.select(F.col("block_id").alias("image_id"), "volume", "error")
    joined = images.join(right, "image_id", "left")
    error = F.when(F.col("volume").isNull(), F.coalesce("error", F.lit("no voxels"))).otherwise(F.col("error"))
    return joined.select("site", "subject", "image_id", "volume", error.alias("error"))


def subject_volume(volumes: DataFrame) -> DataFrame:
    """Volume of each participant: the mean over the participant's images, which show one brain several times.

    Images with ``error`` count in ``unread`` only; a participant with no other image has no volume.
    """
    good = F.col("error").isNull()
    total, images = F.sum(F.when(good, F.col("volume"))).cast("double"), F.count_if(good)
    return volumes.groupBy("site", "subject").agg(
        F.when(images > 0, total / images).alias("volume"), images.alias("images"), F.count_if(~good).alias("unread")
    )


def site_mean_volume(volumes: DataFrame) -> DataFrame:
    """Mean volume per site over its participants, from image volumes; each participant weighs the same."""
    known = subject_volume(volumes).where(F.col("volume").isNotNull())
    mean = F.sum("volume") / F.count(F.lit(1))
    return known.groupBy("site").agg(mean.alias("mean_volume"), F.sum("images").alias("images"))

"""Histology images beside pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from histomill.errors import InvalidParameterError
from histomill.model import Cohort

#: Largest image, in values, that is shipped to the workers whole.
SHIPPED_VALUES = 500_000_000


def scaled_image(image: np.ndarray) -> np.ndarray:
    """The image as float32 in [0, 1]: divided by its maximum if that exceeds 1."""
    image = np.asarray(image, np.float32)
    if image.ndim not in (2, 3):
        raise InvalidParameterError(f"An image has 2 or 3 dimensions, not {image.ndim}.")
    top = float(image.max()) if image.size else 0.0
    return image / top if top > 1 else image


def align_image(cohort: Cohort, scale_x: float = 1.0, scale_y: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0) -> Cohort:
    """Columns ``image_x, image_y``: where a pixel lies in the image; coordinates are image
    places times scale plus offset."""
    if not scale_x or not scale_y:
        raise InvalidParameterError("A scale must not be 0.")
    place = {"image_x": (F.col("x") - offset_x) / scale_x, "image_y": (F.col("y") - offset_y) / scale_y}
    return cohort.with_pixels(cohort.pixels.withColumns(place), "align_image", scale_x=scale_x, scale_y=scale_y, offset_x=offset_x, offset_y=offset_y)


def extract_image_features(cohort: Cohort, image: np.ndarray, radius: int = 3) -> Cohort:
    """Mean of every channel over the disc around a pixel's place, as columns ``image_<c>``;
    places outside repeat the edge."""
    image = scaled_image(image)
    if image.size > SHIPPED_VALUES:
        raise InvalidParameterError(f"Images of more than {SHIPPED_VALUES} values must be tiled first.")
    cube = image[..., None] if image.ndim == 2 else image
    channels = ["grey"] if image.ndim == 2 else ["red", "green", "blue", "alpha"][: cube.shape[2]]
    held = cohort.pixels.sparkSession.sparkContext.broadcast(cube)
    span = np.arange(-radius, radius + 1)
    dy, dx = (v[(span[:, None] ** 2 + span[None] ** 2) <= radius**2] for v in np.meshgrid(span, span, indexing="ij"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def discs(places: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cube = held.value
        h, w = cube.shape[:2]
        for xs, ys in places:
            cx, cy = np.clip(np.trunc(xs).astype(int), 0, w - 1), np.clip(np.trunc(ys).astype(int), 0, h - 1)
            rows = np.clip(cy.to_numpy()[:, None] + dy, 0, h - 1)
            columns = np.clip(cx.to_numpy()[:, None] + dx, 0, w - 1)
            yield pd.Series(list(cube[rows, columns].mean(axis=1).astype(float)))

    if "image_x" not in cohort.pixels.columns:
        cohort = align_image(cohort)
    pixels = cohort.pixels.withColumn("_m", discs("image_x", "image_y"))
    pixels = pixels.withColumns({f"image_{c}": F.get("_m", F.lit(i)) for i, c in enumerate(channels)}).drop("_m")
    return cohort.with_pixels(pixels, "extract_image_features", radius=radius)

"""Image files: the first page as grey pixels, with contrast and sharpness raised for reading.

A renderer makes pixels of a file's bytes; the one here reads grey images of the portable
format (P2 and P5), others can take its place. Files that no renderer knows have nulls;
empty files are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factors of contrast and sharpness, and the weights of a pixel and its eight neighbours in the smooth image (fixed values).
CONTRAST, SHARPNESS, OWN, EACH = 1.2, 1.1, 5, 1
IMAGE = "struct<width: int, height: int, pixels: binary>"


class Renderer(Protocol):
    def first_page(self, content: bytes) -> np.ndarray | None:
        """Grey pixels (rows, columns) of the first page, or None if the format isn't known."""


class Grey:
    """Portable grey maps of one byte a pixel, as text (P2) or bytes (P5), with comments."""

    HEADER = re.compile(rb"(P[25])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s")

    def first_page(self, content: bytes) -> np.ndarray | None:
        m = self.HEADER.match(content)
        if not m:
            return None
        width, height, top = (int(m.group(i)) for i in (3, 5, 7))
        body = content[m.end() :]
        values = np.frombuffer(body, np.uint8) if m.group(1) == b"P5" else np.array(body.split(), np.int64)
        if not 0 < top < 256 or len(values) < width * height:
            return None
        return values[: width * height].reshape(height, width).astype(np.uint8)


def _pixels(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def contrast(image: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    """Pixels moved away from the image's mean."""
    mean = np.floor(image.mean() + 0.5) if image.size else 0.0
    return _pixels(mean + factor * (image.astype(float) - mean))


def sharpness(image: np.ndarray, factor: float = SHARPNESS) -> np.ndarray:
    """Pixels moved away from a smooth image; those of the border stay."""
    if min(image.shape) < 3:
        return image
    x = image.astype(float)
    smooth = x.copy()
    total = sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    smooth[1:-1, 1:-1] = np.floor((EACH * total + (OWN - EACH) * x[1:-1, 1:-1]) / (OWN + 8 * EACH) + 0.5)
    return _pixels(smooth + factor * (x - smooth))


def rendered(content: Column, renderers: Sequence[Renderer] = (Grey(),), enhance: bool = True) -> Column:
    """Struct of width, height and pixels of the first page that a renderer gives, enhanced for reading."""

    def page(data: bytes | None) -> dict | None:
        image = next((p for r in renderers if data is not None and (p := r.first_page(data)) is not None), None)
        if image is None:
            return None
        shown = sharpness(contrast(image)) if enhance else image
        return {"width": image.shape[1], "height": image.shape[0], "pixels": shown.tobytes()}

    @F.arrow_udf(IMAGE)
    def run(files: pa.Array) -> pa.Array:
        return pa.array([page(f.as_py()) for f in files], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return run(content)


def read_images(spark: SparkSession, path: str, renderers: Sequence[Renderer] = (Grey(),), enhance: bool = True) -> DataFrame:
    """path, n_bytes, image: one row per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), rendered(F.col("content"), renderers, enhance).alias("image"), F.left(F.col("content").cast("string"), F.lit(200)).alias("head"))

"""Geometry of page images, and grayscale with contrast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.shipping import vectorised

# Resolutions and sizes of rendered images.
EVIDENCE_DPI, URL_DPI, POINTS = 200, 600, 72
MAX_SCALE, MAX_EDGE, JPEG_QUALITY = 2.0, 1800.0, 0.84
CONTRAST = 1.35


def region_plan(width: Column, height: Column, box: Column, dpi: Column) -> Column:
    """scale, size in pixels (rounded up, at least 1) and translation of a crop; box is relative to the page, whose size is in points."""
    scale = dpi / POINTS
    edge = lambda size, share: F.greatest(F.lit(1), F.ceil(size * share * scale)).cast("int")
    return F.struct(
        scale.alias("scale"), edge(width, box["width"]).alias("width"), edge(height, box["height"]).alias("height"), (-(width * box["x"] * scale)).alias("offset_x"), (-(height * box["y"] * scale)).alias("offset_y")
    )


def page_scale(width: Column, height: Column) -> Column:
    """twice the size, but no edge over 1800 pixels."""
    return F.least(F.lit(MAX_SCALE), MAX_EDGE / F.greatest(width, height))


def contrasted(rgba: bytes, contrast: float = CONTRAST) -> bytes:
    """RGBA pixels as gray, spread around 128; alpha stays."""
    p = np.frombuffer(rgba, np.uint8).reshape(-1, 4).astype(np.float64)
    gray = p[:, :3] @ np.array([0.299, 0.587, 0.114])
    gray = np.clip(np.floor((gray - 128) * contrast + 128 + 0.5), 0, 255)
    return np.column_stack([gray, gray, gray, p[:, 3]]).astype(np.uint8).tobytes()


@vectorised("binary")
def grayscale(images: pd.Series) -> pd.Series:
    return images.map(lambda v: None if v is None else contrasted(v))


def data_url(mime: Column, content: Column) -> Column:
    """F23."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))

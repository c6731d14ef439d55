"""Page counts and sizes of PDFs, without a PDF library.

A page's size is that of its crop box within its media box, turned as the page is, in points times its unit; boxes and rotation are inherited from the page tree. Pictures of pages aren't made
here: rendering is the provider's. Files whose page tree can't be read are reported as invalid, encrypted ones as encrypted.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.shipping import spread, vectorised
from tracewright.sources.pdf_objects import Pdf, PdfError, Ref

# Fixed value: the media box of a page that has none.
LETTER = (0.0, 0.0, 612.0, 792.0)


def _box(pdf: Pdf, value) -> tuple[float, float, float, float] | None:
    corners = pdf.get(value)
    corners = [pdf.get(c) for c in corners] if isinstance(corners, list) else []
    if len(corners) != 4 or not all(isinstance(c, int | float) and not isinstance(c, bool) for c in corners):
        return None
    x0, y0, x1, y1 = corners
    box = min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
    return box if box[2] > box[0] and box[3] > box[1] else None


def _size(pdf: Pdf, page: dict, inherited: dict) -> tuple[float, float]:
    media = _box(pdf, inherited.get("MediaBox")) or LETTER
    crop = _box(pdf, inherited.get("CropBox")) or media
    shown = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
    if shown[2] <= shown[0] or shown[3] <= shown[1]:
        shown = media
    unit = pdf.get(page.get("UserUnit"))
    unit = unit if isinstance(unit, int | float) and not isinstance(unit, bool) and unit > 0 else 1.0
    width, height = (shown[2] - shown[0]) * unit, (shown[3] - shown[1]) * unit
    turn = pdf.get(inherited.get("Rotate"))
    return (height, width) if isinstance(turn, int) and turn % 90 == 0 and turn % 180 else (width, height)


def page_sizes(data: bytes) -> tuple[list[tuple[float, float]], str | None]:
    """Width and height in points of every page in order, and what is wrong: PDF_ENCRYPTED, PDF_INVALID or null."""
    if not data.startswith(b"%PDF-"):
        return [], "PDF_INVALID"
    try:
        pdf = Pdf(data)
        if pdf.trailer.get("Encrypt") is not None:
            return [], "PDF_ENCRYPTED"
        catalog = pdf.get(pdf.trailer.get("Root"))
        root = catalog.get("Pages") if isinstance(catalog, dict) else None
        tree = pdf.get(root)
        if not isinstance(tree, dict) or not isinstance(pdf.get(tree.get("Kids")), list):
            return [], "PDF_INVALID"
        sizes: list[tuple[float, float]] = []
        seen: set[int] = set()
        todo: list[tuple[object, dict]] = [(root, {})]
        while todo:
            at, inherited = todo.pop()
            node = pdf.get(at)
            if not isinstance(node, dict) or isinstance(at, Ref) and at[0] in seen:
                return [], "PDF_INVALID"
            if isinstance(at, Ref):
                seen.add(at[0])
            inherited = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate") if node.get(k) is not None}
            kids = pdf.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, inherited) for k in reversed(kids)]
            else:
                sizes.append(_size(pdf, node, inherited))
    except (PdfError, RecursionError, OverflowError):
        return [], "PDF_INVALID"
    return sizes, None if sizes else "PDF_INVALID"


@vectorised("sizes array<struct<width:double,height:double>>, problem string")
def _read(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_sizes(bytes(c)) for c in contents], columns=["sizes", "problem"])


def opened(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, page_count, sizes, problem; more pages than allowed are a problem, too."""
    out = spread(files.select("path", "content"), "path").select("path", _read("content").alias("p")).select("path", F.size("p.sizes").alias("page_count"), "p.sizes", "p.problem")
    return out.withColumn("problem", F.coalesce("problem", F.when(F.col("page_count") > schemas.MAX_PDF_PAGES, "PDF_INVALID")))


def main(paths: list[str]) -> int:
    """The page sizes of each file as a line of JSON; 1 if one can't be read."""
    wrong = 0
    for path in paths:
        with open(path, "rb") as f:
            sizes, problem = page_sizes(f.read())
        wrong |= problem is not None
        print(json.dumps({"path": path, "pageCount": len(sizes), "pages": [{"page": i, "width": w, "height": h} for i, (w, h) in enumerate(sizes, 1)], "problem": problem}))
    return int(wrong)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

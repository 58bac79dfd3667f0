"""Pages as image files, read back and enhanced."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import plugins as G
from graphloom.sources.files import shared_path
from graphloom.sources.images import read_images
from graphloom.sources.tables import table

#: Pixels of a line.
WIDTH = 48


def drawn(html: str | None, page_id: int) -> str:
    """A page's bytes as a grey map, one byte a pixel, whole lines."""
    data = (html or "").encode()
    height = -(-len(data) // WIDTH)
    data = data.ljust(height * WIDTH, b" ")
    lines = [" ".join(map(str, data[i : i + WIDTH])) for i in range(0, len(data), WIDTH)]
    return "\n".join(["P2", f"# page {page_id}", f"{WIDTH} {height}", "255", *lines])


@F.arrow_udf(T.StringType())
def _drawn(html: pa.Array, ids: pa.Array) -> pa.Array:
    return pa.array([drawn(h.as_py(), i.as_py()) for h, i in zip(html, ids)], pa.string())


def src_pdf_image(spark, sf):
    """Pages written as image files, one each, read as bytes, rendered and enhanced; and the reader of images that answers."""
    path = shared_path(spark, "images")
    table(spark, sf, "pages").select(_drawn("html", "page_id").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    files = read_images(spark, path + "/part-*").filter("image is not null")
    rows = files.select(F.regexp_extract("head", r"# page (\d+)", 1).cast("long").alias("page_id"), "image.*")
    seen = G.ask(F.concat_ws(" ", "width", "height"), [G.Silent(), G.Echo()])["method"]
    return rows.select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.md5("pixels").alias("pixels_md5"), seen.alias("method"))


QUERIES = {"src_pdf_image": (src_pdf_image, None)}

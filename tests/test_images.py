"""Images pixel by pixel against plain Python."""

import hashlib
import math

import numpy as np

from graphloom.plans import images, registry
from graphloom.sources import images as I
from graphloom.sources.tables import table


def enhanced(rows):
    """The definition with loops."""
    half = lambda v: max(0, min(255, math.floor(v + 0.5)))
    n = sum(map(len, rows))
    mean = math.floor(sum(map(sum, rows)) / n + 0.5)
    rows = [[half(mean + 1.2 * (v - mean)) for v in r] for r in rows]
    if len(rows) < 3 or len(rows[0]) < 3:
        return rows
    out = [list(r) for r in rows]
    for y in range(1, len(rows) - 1):
        for x in range(1, len(rows[0]) - 1):
            near = sum(rows[y + b][x + a] for a in (-1, 0, 1) for b in (-1, 0, 1)) + 4 * rows[y][x]
            smooth = math.floor(near / 13 + 0.5)
            out[y][x] = half(smooth + 1.1 * (rows[y][x] - smooth))
    return out


def test_query_is_pixel_exact(spark, sf):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").select("page_id", "html").collect()}
    got = {r["page_id"]: r for r in registry.queries()["src_pdf_image"](spark, sf).collect()}
    assert got.keys() == {k for k, h in pages.items() if h}
    for k in sorted(got)[:25]:
        data = pages[k].encode()
        data = data.ljust(-(-len(data) // images.WIDTH) * images.WIDTH, b" ")
        rows = [list(data[i : i + images.WIDTH]) for i in range(0, len(data), images.WIDTH)]
        assert (got[k]["width"], got[k]["height"]) == (images.WIDTH, len(rows))
        assert got[k]["pixels_md5"] == hashlib.md5(bytes(v for r in enhanced(rows) for v in r)).hexdigest()


def test_formats_and_other_files(spark, tmp_path):
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    (tmp_path / "a.pgm").write_bytes(b"P5\n# by hand\n4 3\n255\n" + pixels.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P2 4 3 255\n" + " ".join(map(str, pixels.ravel())).encode())
    (tmp_path / "c.pgm").write_bytes(b"P5\n4 3\n255\nshort")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 something")
    got = {r["path"][-5]: r["image"] for r in I.read_images(spark, str(tmp_path), enhance=False).collect()}
    assert got["c"] is None and got["d"] is None
    assert all((got[k]["width"], got[k]["height"], bytes(got[k]["pixels"])) == (4, 3, pixels.tobytes()) for k in "ab")

    class Anything:
        def first_page(self, content):
            return np.zeros((1, 2), np.uint8)

    got = {r["path"][-5]: r["image"] for r in I.read_images(spark, str(tmp_path), [I.Grey(), Anything()]).collect()}
    assert bytes(got["d"]["pixels"]) == b"\0\0" and bytes(got["a"]["pixels"]) == bytes(v for r in enhanced(pixels.tolist()) for v in r)

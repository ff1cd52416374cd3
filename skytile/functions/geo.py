"""Column functions on boxes, rings, windows and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trunc(c: Column) -> Column:
    """Towards zero, as an integer."""
    return c.cast("int")


def map_to_pixel(x: Column, y: Column) -> tuple[Column, Column]:
    """Map coordinates to pixels with the row's gt0, gt1, gt3, gt5; rotation terms are left out and the result is truncated."""
    return trunc((x - F.col("gt0")) / F.col("gt1") + 0.5), trunc((y - F.col("gt3")) / F.col("gt5") + 0.5)


def pixel_to_map(x: Column, y: Column, prefix: str = "gt") -> tuple[Column, Column]:
    """Map coordinates of a pixel's centre."""
    g = [F.col(f"{prefix}{i}") for i in range(6)]
    return g[0] + (x + 0.5) * g[1] + (y + 0.5) * g[2], g[3] + (x + 0.5) * g[4] + (y + 0.5) * g[5]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column, prefix: str = "gt") -> Column:
    """Closed five-point ring of a box in map coordinates."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(*[point(*pixel_to_map(x, y, prefix)) for x, y in corners])


def wkt_ring(wkt: Column) -> Column:
    """Ring of a WKT polygon's outer text, as an array of points; null for other text."""
    inner = F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.when(inner != "", F.transform(F.split(inner, ","), lambda p: point(F.try_element_at(pair(p), F.lit(1)).try_cast("double"), F.try_element_at(pair(p), F.lit(2)).try_cast("double"))))


def six_places(values: Column) -> Column:
    """Texts of an array of doubles with six places, rounded from the exact value, ties to even, as C prints them.

    Java's formatter rounds the shortest decimal that stands for a double, which may be a tie that the double is not.
    """
    size = lambda v: F.abs(v)
    part = F.transform(values, lambda v: F.struct(v.alias("v"), (size(v) - F.floor(size(v))).alias("f")))
    # f * 1e6 as p + e, without loss: the upper half of f's digits and the rest are multiplied apart.
    upper = lambda f: f * 134217729.0 - (f * 134217729.0 - f)
    product = F.transform(part, lambda s: F.struct(s["v"].alias("v"), s["f"].alias("f"), (s["f"] * 1e6).alias("p"), upper(s["f"]).alias("hi")))
    parts = F.transform(product, lambda s: F.struct(s["v"].alias("v"), F.floor(s["p"]).alias("n"), (s["p"] - F.floor(s["p"]) - 0.5).alias("d"), (s["hi"] * 1e6 - s["p"] + (s["f"] - s["hi"]) * 1e6).alias("e")))
    up = lambda s: (s["d"] > 0) | ((s["d"] == 0) & ((s["e"] > 0) | ((s["e"] == 0) & (s["n"] % 2 == 1))))
    whole = F.transform(parts, lambda s: F.struct(s["v"].alias("v"), (s["n"] + F.when(up(s), 1).otherwise(0)).alias("n")))
    text = lambda s: F.concat(F.when(s["v"] < 0, "-").otherwise(""), (F.floor(size(s["v"])) + F.floor(s["n"] / 1000000)).cast("string"), F.lit("."), F.lpad((s["n"] % 1000000).cast("string"), 6, "0"))
    return F.transform(whole, lambda s: F.when((s["v"] != 0) & (size(s["v"]) < 2.0**63), text(s)).otherwise(F.format_string("%.6f", s["v"])))


def ring_wkt(ring: Column) -> Column:
    pairs = F.zip_with(six_places(F.transform(ring, lambda p: p["x"])), six_places(F.transform(ring, lambda p: p["y"])), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.concat(F.lit("POLYGON (("), F.array_join(pairs, ","), F.lit("))"))


def ring_box(ring: Column) -> dict[str, Column]:
    """Bounding box, centre (mean of the points) and number of points of a ring."""
    xs, ys, n = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]), F.size(ring)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys), "xc": total(xs) / n, "yc": total(ys) / n, "n_points": n}


def xyxy_to_xywh(xmin, ymin, xmax, ymax) -> dict[str, Column]:
    return {"xc": (xmin + xmax) / 2, "yc": (ymin + ymax) / 2, "w": xmax - xmin, "h": ymax - ymin}


def xywh_to_xyxy(xc, yc, w, h) -> dict[str, Column]:
    return {"xmin": xc - w / 2, "ymin": yc - h / 2, "xmax": xc + w / 2, "ymax": yc + h / 2}


def clamp_window(x0: Column, y0: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Keep a window a pixel inside the raster by moving its start to 1 and cutting its size."""
    x, y = F.greatest(F.lit(1), trunc(x0)), F.greatest(F.lit(1), trunc(y0))
    return {
        "x0": x, "y0": y,
        "w": trunc(F.when(x + w > width - 1, width - 1 - x).otherwise(w)),
        "h": trunc(F.when(y + h > height - 1, height - 1 - y).otherwise(h)),
    }


def shifted_window(xc: Column, yc: Column, size: Column, width: Column, height: Column) -> dict[str, Column]:
    """A window of one size about a centre, moved inside the raster where it would cross its border."""
    def axis(c, limit):
        lo = c - size / 2
        lo = F.when(lo + size > limit, limit - size).otherwise(lo)
        return trunc(F.when(lo < 0, F.lit(0)).otherwise(lo))

    return {"x0": axis(xc, width), "y0": axis(yc, height), "w": trunc(F.least(size, width)), "h": trunc(F.least(size, height))}


def square_window(xmin, ymin, xmax, ymax, width, height, grow: float = 1.3, pad: float = 32) -> dict[str, Column]:
    """A square about the box, ``grow`` times its longer side and ``pad`` more, cut to the raster."""
    side = F.greatest(xmax - xmin, ymax - ymin) * grow + pad
    xc, yc = (xmin + xmax) / 2, (ymin + ymax) / 2
    return {"x0": trunc(F.greatest(F.lit(0), xc - side / 2)), "y0": trunc(F.greatest(F.lit(0), yc - side / 2)), "x1": trunc(F.least(width, xc + side / 2)), "y1": trunc(F.least(height, yc + side / 2))}


def area(b: str, inclusive: bool) -> Column:
    one = 1 if inclusive else 0
    return (F.col(f"{b}xmax") - F.col(f"{b}xmin") + one) * (F.col(f"{b}ymax") - F.col(f"{b}ymin") + one)


def intersection(a: str, b: str, inclusive: bool) -> Column:
    """Intersection area of the boxes whose columns carry these prefixes."""
    one = 1 if inclusive else 0
    side = lambda ax: F.greatest(F.lit(0), F.least(F.col(f"{a}{ax}max"), F.col(f"{b}{ax}max")) - F.greatest(F.col(f"{a}{ax}min"), F.col(f"{b}{ax}min")) + one)
    return side("x") * side("y")


def iou(a: str, b: str, inclusive: bool) -> Column:
    i = intersection(a, b, inclusive).cast("double")
    return F.try_divide(i, area(a, inclusive) + area(b, inclusive) - i)


def natural_key(name: Column) -> Column:
    """A sort key under which runs of digits compare as numbers: each run is padded to 20 digits."""
    padded = F.transform(F.split(F.regexp_replace(name, r"(\d+)", "\u0000$1\u0000"), "\u0000"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def hashed(*parts: Column, seed: int = 0, modulus: int = 2147483647) -> Column:
    """A reproducible number in 0..modulus-1 from integer keys by integer arithmetic, the same in any partitioning."""
    h = F.lit(seed).cast("long")
    for p in parts:
        h = F.pmod((h + F.pmod(p.cast("long"), F.lit(modulus))) * 48271 + 11, F.lit(modulus))
    return h


def patch_name(prefix: Column, row: Column, col: Column, size: Column) -> Column:
    return F.concat_ws("_", prefix, *[c.cast("string") for c in (row, col, size)])


def patch_parts(name: Column) -> dict[str, Column]:
    """Scene, row, column and size of a patch's name; the scene's name may hold underscores itself."""
    at = lambda i: F.regexp_extract(name, r"^(.*)_(\d+)_(\d+)_(\d+)$", i)
    return {"prefix": at(1), "row": at(2).try_cast("int"), "col": at(3).try_cast("int"), "size": at(4).try_cast("int")}


def expanded_window(ring: Column, width: Column, height: Column, key: Column, seed: int = 0, least: int = 512) -> dict[str, Column]:
    """A window about a polygon's mean point, of its size and twice a hashed half to two sizes more; sides below ``least`` are drawn anew from there to twice as much."""
    b = ring_box(ring)
    draws = (hashed(key, seed=seed), hashed(key, F.lit(1), seed=seed))

    def side(size, own, other):
        grown = size + 2 * size * (0.5 + (own % 1001) / 1000.0 * 1.5)
        return trunc(F.when(grown < least, least + other % (least + 1)).otherwise(grown))

    w, h = side(b["xmax"] - b["xmin"], *draws), side(b["ymax"] - b["ymin"], *draws[::-1])
    half = lambda c: F.floor(c / 2)
    return clamp_window(trunc(b["xc"]) - half(w), trunc(b["yc"]) - half(h), w, h, width, height)


def rotate_box(xmin, ymin, xmax, ymax, w, h, degrees: int) -> dict[str, Column]:
    """A box in a tile of w x h after the tile is turned by a right angle."""
    out = {
        0: (xmin, ymin, xmax, ymax),
        90: (ymin, w - xmax, ymax, w - xmin),
        180: (w - xmax, h - ymax, w - xmin, h - ymin),
        270: (h - ymax, xmin, h - ymin, xmax),
    }[degrees % 360]
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), out))

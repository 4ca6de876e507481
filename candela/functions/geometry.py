"""Boxes [x, y, w, h], grids of visual tokens, and draws that depend on keys alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(key: Column) -> Column:
    """Share in [0, 1] from the first eight hex digits of the md5 of the key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def data_split(key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    u = unit_hash(key)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("probe")


def seed_key(*keys: Column) -> Column:
    """The first key that is neither null nor empty."""
    return F.coalesce(*[F.nullif(k.cast("string"), F.lit("")) for k in keys], F.lit("proposal_seed"))


def box(raw: Column) -> Column:
    """Four numbers as doubles, else null."""
    d = F.transform(raw, lambda v: v.try_cast("double"))
    return F.when((F.size(raw) == 4) & F.forall(d, lambda v: v.isNotNull()), d)


def solid_box(raw: Column) -> Column:
    b = box(raw)
    return F.when((b[2] > 0) & (b[3] > 0), b)


def _limit(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(v, hi))


def clipped(b: Column, width: Column, height: Column) -> Column:
    zero, w, h = F.lit(0.0), width.cast("double"), height.cast("double")
    x, y = _limit(b[0], zero, w), _limit(b[1], zero, h)
    out = F.array(x, y, _limit(b[2], zero, w - x), _limit(b[3], zero, h - y))
    return F.when((out[2] > 0) & (out[3] > 0), out)


def centre_box(width: Column, height: Column, share: float = 0.35) -> Column:
    w, h = F.greatest(F.lit(1.0), width * share), F.greatest(F.lit(1.0), height * share)
    return F.array(F.greatest(F.lit(0.0), (width - w) * 0.5), F.greatest(F.lit(0.0), (height - h) * 0.5), w, h)


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.when(w * h > 0, w * h / F.greatest(a[2] * a[3] + b[2] * b[3] - w * h, F.lit(1e-9))).otherwise(0.0)


def primary_box(width: Column, height: Column, *sources: tuple[str, Column]) -> Column:
    """struct(bbox, source, fallback): the first source with a solid box inside the image, else the centre."""
    found = [F.when(clipped(solid_box(b), width, height).isNotNull(), F.struct(clipped(solid_box(b), width, height).alias("bbox"), F.lit(n).alias("source"), F.lit(False).alias("fallback"))) for n, b in sources]
    return F.coalesce(*found, F.struct(centre_box(width, height).alias("bbox"), F.lit("fallback.center_bbox").alias("source"), F.lit(True).alias("fallback")))


def negative_box(b: Column, width: Column, height: Column, key: Column, tries: int = 24, most: float = 0.05) -> Column:
    """A box of the same size drawn by the key, the first of ``tries`` that overlaps by ``most`` at most; null if none does. No draw is made after that one."""
    def found(x: Column) -> Column:
        own, w, h = x["b"], x["w"], x["h"]

        def draw(i: Column) -> Column:
            def u(s: str) -> Column:
                return unit_hash(F.concat_ws(":", x["key"], i, F.lit(s)))
            return F.array(u("x") * F.greatest(F.lit(0.0), w - own[2]), u("y") * F.greatest(F.lit(0.0), h - own[3]), own[2], own[3])
        first = F.reduce(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("array<double>"), lambda had, i: F.when(had.isNotNull(), had).otherwise(F.get(F.filter(F.array(draw(i)), lambda c: iou(own, c) <= most), F.lit(0))))
        return F.when((own[2] > 0) & (own[3] > 0) & (own[2] <= w) & (own[3] <= h), first)
    asked = F.struct(b.alias("b"), width.cast("double").alias("w"), height.cast("double").alias("h"), key.cast("string").alias("key"))
    return F.get(F.transform(F.array(asked), found), F.lit(0))


def merge_ratio(cells: Column, tokens: Column) -> Column:
    """Grid cells per token, rounded; null where the rounding is off by over a twentieth."""
    r = F.greatest(F.bround(cells / tokens), F.lit(1)).cast("int")
    off = F.abs(tokens * r - cells) / F.greatest(cells, F.lit(1))
    return F.when((cells % tokens == 0) | (off <= 0.05), r)


def merge_size(ratio: Column) -> Column:
    """struct(h, w): the largest divisor up to the square root, and its partner."""
    root = F.floor(F.sqrt(ratio)).cast("int")
    h = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(root, F.lit(1))), lambda i: ratio % i == 0))
    return F.struct(h.alias("h"), (ratio / h).cast("int").alias("w"))


def box_cells(b: Column, img_w: Column, img_h: Column, grid_h: Column, grid_w: Column) -> Column:
    """Grid cells struct(y, x) whose centres lie in the box, else the one that holds its centre; none for an empty box."""
    cw, ch = img_w / grid_w.cast("double"), img_h / grid_h.cast("double")

    def inside(n: Column, size: Column, lo: Column, hi: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i + 0.5) * size >= lo) & ((i + 0.5) * size <= hi))

    ys, xs = inside(grid_h, ch, b[1], b[1] + b[3]), inside(grid_w, cw, b[0], b[0] + b[2])
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))

    def centre(v: Column, size: Column, n: Column) -> Column:
        return F.least(n - 1, F.greatest(F.lit(0), (v / size).cast("int")))

    one = F.array(F.struct(centre(b[1] + b[3] / 2, ch, grid_h).alias("y"), centre(b[0] + b[2] / 2, cw, grid_w).alias("x")))
    return F.when((b[2] > 0) & (b[3] > 0), F.when(F.size(cells) > 0, cells).otherwise(one)).otherwise(F.slice(one, 1, 0))


def box_tokens(b: Column, img_w: Column, img_h: Column, grid_h: Column, grid_w: Column, ratio: Column) -> Column:
    """Sorted distinct merged tokens of the box's cells."""
    s = merge_size(ratio)
    return F.array_sort(F.array_distinct(F.transform(box_cells(b, img_w, img_h, grid_h, grid_w), lambda c: (F.floor(c["y"] / s["h"]) * F.floor(grid_w / s["w"]) + F.floor(c["x"] / s["w"])).cast("int"))))


def ring_tokens(targets: Column, n: Column, grid_h: Column, grid_w: Column, ratio: Column, ring: int = 2) -> Column:
    """struct(tokens, method): tokens within ``ring`` steps (Chebyshev) of a target; else all others, else all."""
    s = merge_size(ratio)
    mh, mw = F.floor(grid_h / s["h"]).cast("int"), F.floor(grid_w / s["w"]).cast("int")
    known = F.filter(targets, lambda t: (t >= 0) & (t < n))
    everything = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    near = F.filter(everything, lambda i: (i < mh * mw) & ~F.array_contains(known, i) & F.exists(known, lambda t: F.greatest(
        F.abs(F.floor(i / mw) - F.floor(t / mw)), F.abs(i % mw - t % mw)) <= ring))
    others = F.array_except(everything, known)

    def told(tokens: Column, method: str) -> Column:
        return F.struct(tokens.cast("array<int>").alias("tokens"), F.lit(method).alias("method"))

    return (F.when(n <= 0, told(F.slice(everything, 1, 0), "empty")).when(F.size(known) == 0, told(everything, "global_fallback")).when(F.size(near) > 0, told(near, "ring"))
            .when(F.size(others) > 0, told(others, "global_fallback")).otherwise(told(everything, "all_tokens_fallback")))


def overlapping_tokens(spans: Column, start: Column, end: Column) -> Column:
    """Places of the token spans struct(start, end) that overlap [start, end)."""
    return F.transform(F.filter(F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda t: (t["s"]["end"] > start) & (t["s"]["start"] < end)), lambda t: t["i"])


def token_spans(tokens: Column) -> Column:
    """Character spans struct(start, end) of tokens written one after another: one pass with a running end."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def grown(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(t)
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))).alias("spans"))
    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("spans")), grown, lambda s: s["spans"])


def absolute(ids: Column, relative: Column, image_token: Column) -> Column:
    """Absolute places of relative ones in the range from the first to the last image token."""
    first = F.array_position(ids, image_token)
    last = F.size(ids) - F.array_position(F.reverse(ids), image_token) + 1
    return F.when(first > 0, F.transform(F.filter(relative, lambda i: (i >= 0) & (i < last - first + 1)), lambda i: (i + first - 1).cast("int")))

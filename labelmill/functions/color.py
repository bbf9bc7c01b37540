"""Colour conversions and differences as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ (D65), its white point, and the inverse matrix.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
EPS, KAPPA = 216 / 24389, 24389 / 27


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB to CIELAB (D65)."""
    lin = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]) / white
        f.append(F.when(t > EPS, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lab_to_rgb(lab_l: Column, lab_a: Column, lab_b: Column) -> tuple[Column, ...]:
    """CIELAB to 8-bit sRGB, clipped to 0..255 (not rounded)."""
    fy = (lab_l + 16) / 116
    f = (fy + lab_a / 500, fy, fy - lab_b / 200)
    xyz = [w * F.when(v * v * v > EPS, v * v * v).otherwise((116 * v - 16) / KAPPA) for v, w in zip(f, WHITE, strict=True)]
    out = []
    for row in FROM_XYZ:
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        s = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        out.append(255 * F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    return tuple(out)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in turns, saturation and value in 0..1."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return h, F.when(hi == 0, 0.0).otherwise(d / hi), hi


def delta_e76(p, q) -> Column:
    return F.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)


def ciede2000(p, q) -> Column:
    """CIEDE2000 difference of two (L, a, b) triples."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    c7 = ((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    k1, k2 = F.hypot(a1, b1), F.hypot(a2, b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(a1, b1), hue(a2, b2)
    grey, gap = (k1 * k2) == 0, h2 - h1
    dh = F.when(grey, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap)
    big_h = 2 * F.sqrt(k1 * k2) * F.sin(F.radians(dh / 2))
    total = h1 + h2
    mean_h = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    ml, mk = (l1 + l2) / 2, (k1 + k2) / 2
    cos = lambda x: F.cos(F.radians(x))
    t = 1 - 0.17 * cos(mean_h - 30) + 0.24 * cos(2 * mean_h) + 0.32 * cos(3 * mean_h + 6) - 0.20 * cos(4 * mean_h - 63)
    sl = 1 + 0.015 * (ml - 50) ** 2 / F.sqrt(20 + (ml - 50) ** 2)
    sc, sh = 1 + 0.045 * mk, 1 + 0.015 * mk * t
    rt = -2 * F.sqrt(mk**7 / (mk**7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-(((mean_h - 275) / 25) ** 2))))
    x, y, z = (l2 - l1) / sl, (k2 - k1) / sc, big_h / sh
    return F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z + rt * y * z))


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue_circle(h: Column) -> tuple[Column, Column]:
    """sin and cos of a hue in turns."""
    return F.sin(2 * math.pi * h), F.cos(2 * math.pi * h)


def perturbation_kinds(x: Column, y: Column, width: int, height: int, key: Column, sigma: float = 6.0) -> Column:
    """Changes of acquisition as an array of (kind, fr, fg, fb, plus): factors of the channels, and what is added to each.

    Kinds: brightness, dark, white_balance, gamma, shadow (darker to the left), specular (a spot at a third), noise (normal,
    by hashes of key). Explode it, then take perturbed: expressions of all kinds and channels in one row are more code
    than the JVM compiles.
    """
    unit = lambda i: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{i} "), key)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    shade = 0.6 + 0.4 * x / float(max(width - 1, 1))
    spot = 120 * F.exp(-(F.pow(y - height / 3, F.lit(2)) + F.pow(x - width / 3, F.lit(2))) / (2 * (0.08 * max(width, height)) ** 2))
    noise = sigma * F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    one, none = F.lit(1.0), F.lit(0.0)
    kinds = {
        "brightness": ([F.lit(1.25)] * 3, none),
        "dark": ([F.lit(0.75)] * 3, none),
        "white_balance": ([F.lit(1.08), one, F.lit(0.9)], none),
        "gamma": ([one] * 3, none),
        "shadow": ([shade] * 3, none),
        "specular": ([one] * 3, spot),
        "noise": ([one] * 3, noise),
    }
    return F.array(*[F.struct(F.lit(k).alias("kind"), *[f.alias(n) for f, n in zip(fs, ("fr", "fg", "fb"), strict=True)], plus.alias("plus")) for k, (fs, plus) in kinds.items()])


def perturbed(c: Column, kind: Column, factor: Column, plus: Column) -> Column:
    """A channel after a change, unclipped; gamma is a power of its share of 255."""
    return F.when(kind == "gamma", 255 * F.pow(c / 255.0, F.lit(1.3))).otherwise(c * factor + plus)

"""Colour spaces as column expressions.

Packed formats are integers (0x00RRGGBB, 5-5-5 and 5-6-5 words); float spaces are structs of doubles. Everything stays inside whole-stage code
generation. Floats are double precision. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference white D65 and the matrices between linear sRGB and XYZ.
WHITE = (0.950489, 1.0, 1.088840)
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
GRAY = (0.2126, 0.7152, 0.0722)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0

Three = tuple[Column, Column, Column]


# --- packed integers -------------------------------------------------------------------------------------------------


def channels(c: Column, fmt: str = "xrgb8888") -> Three:
    """R, G and B of a packed colour."""
    shifts, widths = {"xrgb8888": ((16, 8, 0), (8, 8, 8)), "xrgb1555": ((10, 5, 0), (5, 5, 5)), "rgb565": ((11, 5, 0), (5, 6, 5))}[fmt]
    return tuple(F.shiftright(c, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, widths))  # type: ignore[return-value]


def pack(rgb: Three, fmt: str = "xrgb8888") -> Column:
    r, g, b = (x.cast("int") for x in rgb)
    hi, mid = {"xrgb8888": (16, 8), "xrgb1555": (10, 5), "rgb565": (11, 5)}[fmt]
    return F.shiftleft(r, hi).bitwiseOR(F.shiftleft(g, mid)).bitwiseOR(b)


def _scale(c: Column, mul: int, add: int, shift: int) -> Column:
    return F.shiftright(c * mul + add, shift)


def convert_packed(c: Column, src: str, dst: str) -> Column:
    """Rounded conversion between packed formats."""
    if src == dst:
        return c
    r, g, b = channels(c, src)
    eight_to_five, five_to_eight = (249, 1014, 11), (527, 23, 6)
    if src == "xrgb8888":
        out = _scale(r, *eight_to_five), _scale(g, *(eight_to_five if dst == "xrgb1555" else (253, 505, 10))), _scale(b, *eight_to_five)
    elif dst == "xrgb8888":
        out = _scale(r, *five_to_eight), _scale(g, *(five_to_eight if src == "xrgb1555" else (259, 33, 6))), _scale(b, *five_to_eight)
    else:
        out = r, _scale(g, *((130, 33, 6) if dst == "rgb565" else (31, 31, 6))), b
    return pack(out, dst)


def truncate_packed(c: Column, dst: str) -> Column:
    """Conversion from 8-bit channels that drops low bits instead of rounding."""
    r, g, b = channels(c)
    return pack((F.shiftright(r, 3), F.shiftright(g, 2 if dst == "rgb565" else 3), F.shiftright(b, 3)), dst)


def swap_red_blue(c: Column, fmt: str = "xrgb8888") -> Column:
    r, g, b = channels(c, fmt)
    return pack((b, g, r), fmt)


def from_hex(s: Column) -> Column:
    """``RRGGBB`` or ``#RRGGBB`` to a packed colour; anything else is an error under ``assert_hex`` and null here."""
    digits = F.regexp_extract(s, r"\A#?([0-9A-Fa-f]{6})\z", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("int"))


def to_hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 6, "0")


# --- float spaces ----------------------------------------------------------------------------------------------------


def to_rgbf(c: Column, fmt: str = "xrgb8888") -> Three:
    r, g, b = channels(c, fmt)
    top = {"xrgb8888": (255.0, 255.0, 255.0), "xrgb1555": (31.0, 31.0, 31.0), "rgb565": (31.0, 63.0, 31.0)}[fmt]
    return r / F.lit(top[0]), g / F.lit(top[1]), b / F.lit(top[2])


def from_rgbf(rgb: Three, fmt: str = "xrgb8888") -> Column:
    """Nearest packed colour; channels are clamped first."""
    top = {"xrgb8888": (255, 255, 255), "xrgb1555": (31, 31, 31), "rgb565": (31, 63, 31)}[fmt]
    return pack(tuple(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(t)), x * float(t) + 0.5))) for x, t in zip(rgb, top)), fmt)  # type: ignore[arg-type]


def to_linear(rgb: Three) -> Three:
    return tuple(F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))) for x in rgb)  # type: ignore[return-value]


def to_srgb(rgb: Three) -> Three:
    return tuple(F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1.0 / 2.4)) * 1.055 - 0.055) for x in rgb)  # type: ignore[return-value]


def to_gray(rgb: Three) -> Column:
    """Luma without linearisation."""
    return rgb[0] * GRAY[0] + rgb[1] * GRAY[1] + rgb[2] * GRAY[2]


def to_ycgco(rgb: Three) -> Three:
    """Lifting transform: Y in 0..1, Cg and Co in -1..1."""
    r, g, b = rgb
    co = r - b
    base = b + co / 2
    cg = g - base
    return base + cg / 2, cg, co


def from_ycgco(ycc: Three) -> Three:
    y, cg, co = ycc
    base = y - cg / 2
    blue = base - co / 2
    return blue + co, cg + base, blue


def ycgco_normalized(ycc: Three) -> Three:
    return ycc[0], (ycc[1] + 1) * 0.5, (ycc[2] + 1) * 0.5


def _mul(m, v: Three) -> Three:
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in m)  # type: ignore[return-value]


def to_lab(rgb: Three) -> Three:
    """CIE L*a*b* of linear RGB."""
    f = [x / F.lit(w) for x, w in zip(_mul(RGB_TO_XYZ, rgb), WHITE)]
    f = [F.when(x > EPSILON, F.pow(x, F.lit(1.0 / 3.0))).otherwise((x * KAPPA + 16.0) / 116.0) for x in f]
    return f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0


def from_lab(lab: Three) -> Three:
    """Linear RGB, clamped to 0..1."""
    y = (lab[0] + 16.0) / 116.0
    f = lab[1] / 500.0 + y, y, y - lab[2] / 200.0
    inv = [F.when(x > 6.0 / 29.0, x * x * x).otherwise((x * 116.0 - 16.0) / KAPPA) * w for x, w in zip(f, WHITE)]
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in _mul(XYZ_TO_RGB, inv))  # type: ignore[arg-type,return-value]


def round_to_grid(rgb: Three, levels: Three) -> Three:
    """Clamp to 0..1 and snap each channel to the nearest of its ``levels + 1`` values."""
    return tuple(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * n + 0.5) / n for x, n in zip(rgb, levels))  # type: ignore[return-value]


# --- distances, all in 0..1 ------------------------------------------------------------------------------------------


def mse_rgb(a: Three, b: Three, variant: str = "weighted") -> Column:
    """Red-weighted distance of channels in 0..1.

    ``variant="offset"`` is the form in which two ninths are added to every unequal pair and blue weighs ``1 - mean red``; palette work that was tuned with it needs it.
    """
    mean = (a[0] + b[0]) * 0.5
    dr, dg, db = a[0] - b[0], a[1] - b[1], a[2] - b[2]
    base = (mean + 2) * dr * dr + dg * dg * 4
    if variant == "weighted":
        return (base + (F.lit(3.0) - mean) * db * db) / 9.0
    same = (dr == 0) & (dg == 0) & (db == 0)
    return F.when(same, 0.0).otherwise((base + ((F.lit(1.0) - mean) * db * db + 2)) / 9.0)


def mse_ycgco(a: Three, b: Three) -> Column:
    dy, dg, do = a[0] - b[0], (a[1] - b[1]) * 0.5, (a[2] - b[2]) * 0.5
    return dy * dy * 0.4 + dg * dg * 0.3 + do * do * 0.3


def mse_gray(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def hyab(a: Three, b: Three) -> Column:
    """Hybrid distance of L*a*b* colours: city-block in lightness, Euclidean in chroma."""
    dl, da, db = (a[0] - b[0]) / 100.0, (a[1] - b[1]) / 255.0, (a[2] - b[2]) / 255.0
    return (F.sqrt(da * da + db * db) + F.abs(dl)) / 2.414213562


def psnr(mean_error: Column) -> Column:
    """Peak signal-to-noise ratio in dB of a mean distance in 0..1; infinite for equal images."""
    return F.when(mean_error == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(1.0) / mean_error) * 10)


# --- chains of conversions, one projection for each step, so that no step's expression is repeated within the next ---------


def with_lab(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Add L*a*b* of a packed colour, linearised first, as columns ``{prefix}l``, ``{prefix}a``, ``{prefix}b``."""
    t = [f"_{prefix}{i}" for i in range(3)]
    df = df.withColumns(dict(zip(t, to_rgbf(F.col(value)))))
    df = df.withColumns(dict(zip(t, to_linear(tuple(F.col(x) for x in t)))))
    f = [x / F.lit(w) for x, w in zip(_mul(RGB_TO_XYZ, tuple(F.col(x) for x in t)), WHITE)]
    df = df.withColumns(dict(zip(t, f)))
    df = df.withColumns({x: F.when(F.col(x) > EPSILON, F.pow(x, F.lit(1.0 / 3.0))).otherwise((F.col(x) * KAPPA + 16.0) / 116.0) for x in t})
    fx, fy, fz = (F.col(x) for x in t)
    return df.withColumns({f"{prefix}l": fy * 116.0 - 16.0, f"{prefix}a": (fx - fy) * 500.0, f"{prefix}b": (fy - fz) * 200.0}).drop(*t)


def with_packed_of_lab(df: DataFrame, lab: tuple[str, str, str], out: str) -> DataFrame:
    """Add the packed colour of L*a*b* columns."""
    t = [f"_{out}{i}" for i in range(3)]
    y = (F.col(lab[0]) + 16.0) / 116.0
    df = df.withColumns(dict(zip(t, (F.col(lab[1]) / 500.0 + y, y, y - F.col(lab[2]) / 200.0))))
    df = df.withColumns({x: F.when(F.col(x) > 6.0 / 29.0, F.col(x) * F.col(x) * F.col(x)).otherwise((F.col(x) * 116.0 - 16.0) / KAPPA) * w for x, w in zip(t, WHITE)})
    lin = _mul(XYZ_TO_RGB, tuple(F.col(x) for x in t))
    df = df.withColumns({x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for x, v in zip(t, lin)})
    df = df.withColumns(dict(zip(t, to_srgb(tuple(F.col(x) for x in t)))))
    return df.withColumn(out, from_rgbf(tuple(F.col(x) for x in t))).drop(*t)


def with_ciede2000(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the CIE 2000 colour difference of two L*a*b* colours with these prefixes, all parametric factors being one.

    The steps are those of the CIE definition, with hue angles in degrees: chroma with its correction of a*, hue difference and mean hue on the circle, weighting functions, rotation of blue hues.
    """
    keep = [*df.columns, out]
    c = F.col
    part = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + 25.0**7))
    cosd = lambda x: F.cos(F.radians(x))
    df = df.withColumn("_g", part((F.hypot(f"{a}a", f"{a}b") + F.hypot(f"{b}a", f"{b}b")) / 2) * -0.5 + 1.5)
    df = df.withColumns({f"_a{i}": c(f"{p}a") * c("_g") for i, p in ((1, a), (2, b))})
    df = df.withColumns({f"_c{i}": F.hypot(f"_a{i}", f"{p}b") for i, p in ((1, a), (2, b))})
    # a gray has no hue; zero stands for it
    df = df.withColumns({f"_h{i}": F.when(c(f"_c{i}") == 0, 0.0).otherwise(F.pmod(F.degrees(F.atan2(c(f"{p}b"), c(f"_a{i}"))), F.lit(360.0))) for i, p in ((1, a), (2, b))})
    turn, total = c("_h2") - c("_h1"), c("_h1") + c("_h2")
    gray = c("_c1") * c("_c2") == 0
    df = df.withColumns(
        {
            "_dh": F.when(gray, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn),
            "_hm": F.when(gray, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2),
            "_cm": (c("_c1") + c("_c2")) / 2,
            "_l2": F.pow((c(f"{a}l") + c(f"{b}l")) / 2 - 50, F.lit(2.0)),
        }
    )
    h, cm = c("_hm"), c("_cm")
    t = F.lit(1.0) - cosd(h - 30) * 0.17 + cosd(h * 2) * 0.24 + cosd(h * 3 + 6) * 0.32 - cosd(h * 4 - 63) * 0.20
    spread = (h - 275) / 25
    df = df.withColumns(
        {
            "_dl": (c(f"{b}l") - c(f"{a}l")) / (F.lit(1.0) + c("_l2") * 0.015 / F.sqrt(c("_l2") + 20)),
            "_dc": (c("_c2") - c("_c1")) / (F.lit(1.0) + cm * 0.045),
            "_dh": F.sqrt(c("_c1") * c("_c2")) * 2 * F.sin(F.radians(c("_dh") / 2)) / (F.lit(1.0) + cm * 0.015 * t),
            "_rt": part(cm) * -2 * F.sin(F.radians(F.exp(-(spread * spread)) * 60)),
        }
    )
    dl, dc, dh = c("_dl"), c("_dc"), c("_dh")
    return df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), dl * dl + dc * dc + dh * dh + c("_rt") * dc * dh))).select(*keep)

"""Per-pixel colour maths as native Column expressions; integers are exact, divisions truncate towards zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, as bigint."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def percent(x: int) -> int:
    """A weight in percent as 256ths."""
    return (x * 256 + 50) // 100


def gray_from_rgb(r: Column, g: Column, b: Column, weights: tuple[int, int, int] = (30, 59, 11)) -> Column:
    wr, wg, wb = map(percent, weights)
    return F.shiftright(r * wr + g * wg + b * wb, 8)


def gray_level(v: Column, bits: int = 8, white_is_zero: bool = False) -> Column:
    """A grey sample of `bits` bits on the scale 0..255; 16-bit samples are taken by their high byte."""
    if bits == 16:
        v, bits = F.shiftright(v, 8), 8
    top = (1 << bits) - 1
    return idiv((top - v if white_is_zero else v) * 255, top)


def depth16_to_8(v: Column) -> Column:
    return idiv(v + 128, 257)


def premultiply(v: Column, alpha: Column) -> Column:
    """Unassociated to associated alpha."""
    return idiv(v * alpha + 127, 255)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    rest = 255 - k
    return tuple(idiv(rest * (255 - x), 255) for x in (c, m, y))


def pack_abgr(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Red in the lowest byte; opaque unless an alpha is given."""
    return (r + g * 256 + b * 65536).cast("bigint") + (F.lit(255) if a is None else a).cast("bigint") * 16777216


def unpack_abgr(p: Column) -> dict[str, Column]:
    return {n: F.shiftright(p, 8 * i).bitwiseAND(F.lit(255)) for i, n in enumerate("rgba")}


def invert(v: Column, bits: int = 8) -> Column:
    return (1 << bits) - 1 - v


def threshold(v: Column, at: int = 128) -> Column:
    return F.when(v > at, 1).otherwise(0)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def scale_palette(v: Column, wide: Column | bool) -> Column:
    """Palette entries of 16 bits to 8; `wide` says that some entry of the palette is 256 or more."""
    return F.when(F.lit(wide) if isinstance(wide, bool) else wide, F.shiftright(v, 8)).otherwise(v)


def bits_of(packed: Column, bits: int) -> Column:
    """Samples of 1, 2 or 4 bits in a byte, the most significant first."""
    return F.array(*(F.shiftright(packed, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in range(8 - bits, -1, -bits)))


def default_reference(photometric: int, bits: int = 8) -> tuple[float, ...]:
    """Reference black and white of the three components where no tag tells: chroma (photometric 6) is centred."""
    top = float((1 << bits) - 1)
    half = float(1 << (bits - 1))
    return (0.0, top, half, top, half, top) if photometric == 6 else (0.0, top) * 3


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, luma: tuple[float, float, float] = (0.299, 0.587, 0.114), reference: tuple[float, ...] | None = None) -> tuple[Column, Column, Column]:
    """YCbCr to RGB in 16-bit fixed point, clamped to 0..255; full range, unless a reference of black and white is given.

    With a reference, luma is spread from its black and white to 0..255 and chroma to -127..127 about 128, truncated.
    """
    if reference is not None:
        spread = lambda c, i, top: ((c - reference[2 * i]) * top / max(reference[2 * i + 1] - reference[2 * i], 1.0)).cast("int")
        y, cb, cr = spread(y, 0, 255.0), spread(cb, 1, 127.0) + 128, spread(cr, 2, 127.0) + 128
    lr, lg, lb = luma
    fix = lambda x: int(x * 65536 + 0.5)
    d1, d2, d3, d4 = fix(2 - 2 * lr), fix(lr * (2 - 2 * lr) / lg), fix(2 - 2 * lb), fix(lb * (2 - 2 * lb) / lg)
    b, r = cb - 128, cr - 128
    red, blue = y + F.shiftright(r * d1 + 32768, 16), y + F.shiftright(b * d3 + 32768, 16)
    green = y + F.shiftright(-(r * d2) - b * d4 + 32768, 16)
    return tuple(F.greatest(F.least(x, F.lit(255)), F.lit(0)) for x in (red, green, blue))


def rgb_to_ycbcr(r: Column, g: Column, b: Column, luma: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> tuple[Column, Column, Column]:
    """Luma and centred chroma as doubles."""
    lr, lg, lb = luma
    y = r * lr + g * lg + b * lb
    return y, (b - y) / (2 - 2 * lb) + 128, (r - y) / (2 - 2 * lr) + 128


def to_code(v: Column) -> Column:
    """Round half up and limit to 0..255."""
    return F.greatest(F.least(F.floor(v + 0.5), F.lit(255)), F.lit(0))


def lab_to_xyz(lightness: Column, a: Column, b: Column, white: tuple[float, float, float] = (96.42, 100.0, 82.49)) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (L 0..100) to XYZ."""
    fy = F.when(lightness < 8.856, 7.787 * (lightness / 903.3) + 16.0 / 116.0).otherwise((lightness + 16.0) / 116.0)
    y = F.when(lightness < 8.856, lightness * white[1] / 903.292).otherwise(white[1] * fy * fy * fy)
    cube = lambda t, w: F.when(t < 0.2069, (t - 0.13793) * w / 7.787).otherwise(w * t * t * t)
    return cube(fy + a / 500.0, white[0]), y, cube(fy - b / 200.0, white[2])


def xyz_to_rgb24(x: Column, y: Column, z: Column, white: float = 1.0) -> tuple[Column, Column, Column]:
    """CCIR-709 primaries with a square-root gamma, 0..255. white: what stands for 1 in x, y and z; each product is divided by it, since codes at a border turn on the last bit."""
    rows = ((2.690, -1.276, -0.414), (-1.022, 1.978, 0.044), (0.061, -0.224, 1.163))
    out = []
    for p, q, s in rows:
        v = p * x / white + q * y / white + s * z / white
        out.append(F.when(v <= 0, 0).when(v >= 1, 255).otherwise(F.floor(256 * F.sqrt(F.greatest(v, F.lit(0.0))))).cast("int"))
    return tuple(out)


#: A display of standard primaries: XYZ to light, white, brightest code, darkest light and gamma.
DISPLAY = {"matrix": ((3.2410, -1.5374, -0.4986), (-0.9692, 1.8760, 0.0416), (0.0556, -0.2040, 1.0570)), "white": 100.0, "top": 255, "dark": 1.0, "gamma": 2.4}


def xyz_to_rgb_display(x: Column, y: Column, z: Column, display: dict = DISPLAY, steps: int = 1500) -> tuple[Column, Column, Column]:
    """RGB codes of XYZ (Y of white: 100) on a display: light within its range, in `steps` steps, to codes by its gamma."""
    out, step = [], (display["white"] - display["dark"]) / steps
    for p, q, s in display["matrix"]:
        light = clamp(x * p + y * q + z * s, display["dark"], display["white"])
        at = F.least(F.floor((light - display["dark"]) / step), F.lit(steps))
        out.append(F.floor(display["top"] * F.pow(at / float(steps), F.lit(1 / display["gamma"])) + 0.5).cast("int"))
    return tuple(out)


def logl16_to_y(p: Column) -> Column:
    """Sign and 15-bit log luminance to Y."""
    e = p.bitwiseAND(F.lit(0x7FFF))
    y = F.exp(F.lit(0.693147180559945309417) / 256.0 * (e + 0.5) - F.lit(0.693147180559945309417) * 64.0)
    return F.when(e == 0, 0.0).when(p.bitwiseAND(F.lit(0x8000)) == 0, y).otherwise(-y)


def logl16_from_y(y: Column) -> Column:
    code = lambda v: F.floor(256.0 * (F.log2(v) + 64.0)).cast("int")
    return F.when(y >= 1.8371976e19, 0x7FFF).when(y <= -1.8371976e19, 0xFFFF).when(y > 5.4136769e-20, code(y)).when(y < -5.4136769e-20, code(-y).bitwiseOR(F.lit(0x8000))).otherwise(0)


def logl10_to_y(p: Column) -> Column:
    ln2 = 0.693147180559945309417
    return F.when(p == 0, 0.0).otherwise(F.exp(F.lit(ln2 / 64.0) * (p + 0.5) - F.lit(ln2 * 12.0)))


def transfer_curve(bits: int = 8, gamma: float = 2.2) -> Column:
    """The default transfer function of a bit depth, as an array of 2^bits values of 16 bits."""
    top = (1 << bits) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda i: F.when(i == 0, 0).otherwise(F.floor(F.lit(65535.0) * F.pow(i / float(top), F.lit(gamma)) + 0.5)).cast("int"))


def contrast_curve(percent_: float, linear: bool = False) -> Column:
    """256 output levels for box-filtered thumbnails: linear or exponential, dark ink on white."""
    if linear:
        return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: 255 - i)
    p = percent_ / 100.0
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: 255 - F.floor(255 * (F.lit(1.0) - F.exp(-(i / 255.0) / p)) / (1.0 - float(__import__("math").exp(-1.0 / p))) + 0.5).cast("int"))


#: The registry of replaceable pixel kernels: photometric name -> function of sample columns to (r, g, b).
KERNELS: dict[str, Callable[..., tuple[Column, Column, Column]]] = {
    "min_is_black": lambda v: (gray_level(v),) * 3,
    "min_is_white": lambda v: (gray_level(v, white_is_zero=True),) * 3,
    "rgb": lambda r, g, b: (r, g, b),
    "separated": cmyk_to_rgb,
    "ycbcr": ycbcr_to_rgb,
}


def register_kernel(photometric: str, kernel: Callable[..., tuple[Column, Column, Column]]) -> None:
    KERNELS[photometric] = kernel


def rgba(photometric: str, *samples: Column, alpha: Column | None = None) -> Column:
    """Packed pixel of any registered photometric interpretation."""
    if photometric not in KERNELS:
        raise ValueError(f"no kernel for {photometric}")
    return pack_abgr(*KERNELS[photometric](*samples), a=alpha)

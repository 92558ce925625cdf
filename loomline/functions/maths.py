"""Mathematics on Columns: rounding, interpolation, vectors, bits and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.strings import col


def round_away(x) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.round(col(x))


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(col(x), F.lit(high)))


def remainder(a, b) -> Column:
    """Of both as whole numbers, with the sign of a."""
    return col(a).cast("long") % F.lit(b).cast("long")


def lerp(a, b, r) -> Column:
    return col(a) * (1 - col(r)) + col(b) * col(r)


def lerp_between(a, b, t0, t1, t) -> Column:
    """Null where t0 is t1."""
    return col(a) + F.try_divide((col(b) - col(a)) * (col(t) - col(t0)), col(t1) - col(t0))


def lerp_three(a, mid, b, r) -> Column:
    """Through mid at one half."""
    a, mid, b, r = map(col, (a, mid, b, r))
    return F.when(r < 0.5, a + (mid - a) * r * 2).when(r > 0.5, mid + (b - mid) * (r * 2 - 1)).otherwise(mid)


def median3(a, b, c) -> Column:
    return F.element_at(F.array_sort(F.array(col(a), col(b), col(c))), 2)


def almost(a, b, eps: float) -> Column:
    return F.abs(col(a) - col(b)) <= eps * F.greatest(F.abs(col(a)), F.abs(col(b)))


def half_life(x, low: float, high: float, life: float) -> Column:
    """1 at one end and half for each life from it; a negative life starts from the high end."""
    x = clamp(x, low, high)
    if life == 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), (x - (low if life > 0 else high)) / life)


def remap(x, s0: float, s1: float, d0: float, d1: float, clamped: bool = False) -> Column:
    """From s0..s1 to d0..d1; null where s0 is s1, but for what clamping settles."""
    x = col(x)
    out = F.lit(d0) + F.try_divide((x - s0) * (d1 - d0), F.lit(s1 - s0))
    return F.when(x <= s0, d0).when(x >= s1, d1).otherwise(out) if clamped else out


def floor_log2(x) -> Column:
    return F.least(F.floor(F.log2(col(x))), F.lit(23))


def round_to(x, step) -> Column:
    return F.round(col(x) / F.lit(step)) * F.lit(step)


def lowest_bit(x) -> Column:
    return col(x).bitwiseAND(-col(x))


def with_bit(x, bit: int, on: bool) -> Column:
    return col(x).bitwiseOR(F.lit(1 << bit)) if on else col(x).bitwiseAND(F.lit(~(1 << bit)))


def flip_bit(x, bit: int) -> Column:
    return col(x).bitwiseXOR(F.lit(1 << bit))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v) -> Column:
    """v over its length; the zero vector stays."""
    n = norm(v)
    return F.transform(col(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def cross(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def rotate2(v, radians) -> Column:
    v, c, s = col(v), F.cos(col(radians)), F.sin(col(radians))
    return F.array(v[0] * c - v[1] * s, v[0] * s + v[1] * c)


def reflect(v, n) -> Column:
    d = dot(v, n)
    return F.zip_with(col(v), col(n), lambda x, y: x - 2 * d * y)


def bezier2(a, b, c, t) -> Column:
    t = col(t)
    first = F.zip_with(col(a), col(b), lambda x, y: x * (1 - t) * (1 - t) + y * 2 * t * (1 - t))
    return F.zip_with(first, col(c), lambda x, y: x + y * t * t)


def yaw(x, y) -> Column:
    """Degrees cut to a whole number, 0 up to 359; 0 for the zero vector."""
    d = F.degrees(F.atan2(col(y), col(x))).cast("int")
    return F.when((col(x) == 0) & (col(y) == 0), F.lit(0)).otherwise(F.when(d < 0, d + 360).otherwise(d))


def angle_between(a, b) -> Column:
    """a - b in degrees, from -180 up to 180."""
    return F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180


def roots(a, b, c) -> Column:
    """Real roots of ax² + bx + c, the lesser first, and whether there are any; a line has its one root twice, and 0 = 0 has 0 for one."""
    a, b, c = map(col, (a, b, c))
    d = b * b - 4 * a * c
    r = F.sqrt(F.when(d >= 0, d))
    line = F.coalesce(F.try_divide(-c, b), F.when(c == 0, F.lit(0.0)))
    x, y = (F.when(a == 0, line).otherwise(F.try_divide(-b + sign * r, 2 * a)) for sign in (-1, 1))
    real = F.when(a != 0, d >= 0).otherwise((b != 0) | (c == 0))
    return F.struct(F.least(x, y).alias("x0"), F.greatest(x, y).alias("x1"), real.alias("real"))


def boxes_touch(lo_a, hi_a, lo_b, hi_b, gap: float = 0.0) -> Column:
    """Whether closed boxes meet on each of three axes, up to a gap."""
    out = F.lit(True)
    for k in range(3):
        out = out & (col(hi_a)[k] + gap >= col(lo_b)[k]) & (col(lo_a)[k] - gap <= col(hi_b)[k])
    return out


def box_within(lo_a, hi_a, lo_b, hi_b) -> Column:
    out = F.lit(True)
    for k in range(3):
        out = out & (col(lo_a)[k] >= col(lo_b)[k]) & (col(hi_a)[k] <= col(hi_b)[k])
    return out


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def silu(x) -> Column:
    return col(x) * sigmoid(x)


def relu(x) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def gelu(x) -> Column:
    """The form by tanh."""
    x = col(x)
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def _crc16_table() -> list[int]:
    out = []
    for b in range(256):
        crc = b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


def crc16(s) -> Column:
    """CRC-16 of the UTF-8 bytes: polynomial 0x1021, first value 0xffff."""
    digits = F.hex(F.encode(col(s), "UTF-8"))
    n = F.floor(F.length(digits) / 2).cast("int")
    byte = lambda k: F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("int")
    table = F.array(*map(F.lit, _crc16_table()))
    step = lambda crc, k: F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte(k))))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0xFFFF), step)).when(n == 0, F.lit(0xFFFF))


def morton2(x, y, bits: int = 16) -> Column:
    """The bits of two whole numbers interleaved, x lowest."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(col(x).cast("long"), k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(col(y).cast("long"), k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return out

"""Random numbers from counters: Threefry 4x64 with 20 rounds as Column expressions, the same on every layout of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator: the key's parity word, and the rotations of each of eight rounds for its two pairs of words.
PARITY = 0x1BD11BDAA9FC1A22
ROTATIONS = ((14, 16), (52, 57), (23, 40), (5, 37), (25, 33), (46, 12), (58, 22), (32, 32))
_LOW = 0xFFFFFFFF


def signed(word: int) -> int:
    """A 64-bit word as a signed number."""
    return word - (1 << 64) if word >= 1 << 63 else word


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, from sums of 32-bit halves, which never overflow."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def threefry(counter: list[Column], key: tuple[int, int, int, int]) -> Column:
    """An array of four 64-bit words, signed, for a counter of four whole numbers and a key of four words (0 to 2**64 - 1)."""
    ks = [*key, key[0] ^ key[1] ^ key[2] ^ key[3] ^ PARITY]
    word = lambda w: F.lit(signed(w % (1 << 64))).cast("long")
    state = F.array(*[wrapping_add(c.cast("long"), word(k)) for c, k in zip(counter, ks)])
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluates value a single time

    def turned(n: int):
        pairs = ((0, 1), (2, 3)) if n % 2 == 0 else ((0, 3), (2, 1))

        def turn(x: Column) -> Column:
            out: list = [None] * 4
            for (a, b), r in zip(pairs, ROTATIONS[n % 8]):
                out[a] = wrapping_add(x[a], x[b])
                out[b] = F.shiftleft(x[b], r).bitwiseOR(F.shiftrightunsigned(x[b], 64 - r)).bitwiseXOR(out[a])
            return F.array(*out)

        return turn

    def keyed(s: int):
        add = [ks[(s + k) % 5] + (s if k == 3 else 0) for k in range(4)]
        return lambda x: F.array(*[wrapping_add(x[k], word(add[k])) for k in range(4)])

    for n in range(20):
        state = once(state, turned(n))
        if n % 4 == 3:
            state = once(state, keyed(n // 4 + 1))
    return state

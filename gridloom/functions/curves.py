"""Space-filling curves as column expressions.

Coordinates are non-negative integers: below 2**32 in two dimensions, 2**21 in three.
A code must fit a signed BIGINT to keep its order, so two-dimensional coordinates are
held to 2**31 - 1. Other dimensions raise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {2: 32, 3: 21}

#: Shifts and masks that spread the bits of a number apart.
SPREAD = {
    2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)),
    3: ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)),
}


def _spread(c: Column, d: int) -> Column:
    c = c.cast("long")
    for shift, mask in SPREAD[d]:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _dims(p: Sequence[Column]) -> int:
    if len(p) not in BITS:
        raise ValueError(f"curves have 2 or 3 dimensions, not {len(p)}")
    return len(p)


def morton(p: Sequence[Column]) -> Column:
    """Bits of the coordinates interleaved, those of the first lowest."""
    d = _dims(p)
    code = _spread(p[0], d)
    for i in range(1, d):
        code = code.bitwiseOR(F.shiftleft(_spread(p[i], d), i))
    return code


def morton_decode(code: Column, d: int) -> list[Column]:
    if d not in BITS:
        raise ValueError(f"curves have 2 or 3 dimensions, not {d}")
    bits = BITS[d] - (d == 2)

    def gather(i: int) -> Column:
        bit = lambda b: F.call_function("shiftright", code, b * d + i).bitwiseAND(F.lit(1).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", bit(b), b)))

    return [gather(i) for i in range(d)]


def _hilbert(d: int, decode: bool):
    """A vectorised function over whole columns: bits of a code depend on all higher bits, which no built-in function follows in a fixed number of steps."""
    bits, digit_mask = BITS[d], (1 << d) - 1
    #: By how much a digit turns the frame: by one, and as far again as its lowest bit stands, unless that is the last dimension's.
    turns = [1 + (low if (low := (digit & -digit).bit_length()) < d else 0) for digit in range(1 << d)]
    every_d = sum(1 << (d * k) for k in range(bits)) >> 1

    def run(*given: pd.Series) -> pd.Series | pd.DataFrame:
        x = [c.to_numpy().astype(np.uint64) for c in given]
        one, width, mask, turn = np.uint64(1), np.uint64(d), np.uint64(digit_mask), np.array(turns, np.uint64)
        n = len(x[0])
        frame, flip, above, out = (np.zeros(n, np.uint64) for _ in range(4))
        coords = [np.zeros(n, np.uint64) for _ in range(d)]
        if decode:
            code = x[0] ^ x[0] >> one ^ np.uint64(every_d)
        for k in range(bits - 1, -1, -1):
            if decode:
                digit = code >> np.uint64(k * d) & mask
                above = above ^ flip ^ ((digit << frame | digit >> (width - frame)) & mask)
                for i in range(d):
                    coords[i] |= (above >> np.uint64(i) & one) << np.uint64(k)
            else:
                here = np.zeros(n, np.uint64)
                for i in range(d):
                    here |= (x[i] >> np.uint64(k) & one) << np.uint64(i)
                digit = here ^ above ^ flip
                digit = (digit >> frame | digit << (width - frame)) & mask
                out = out << width | digit
                above = here
            flip = one << frame
            frame = (frame + turn[digit]) % width
        if decode:
            return pd.DataFrame({f"x{i}": c.astype(np.int64) for i, c in enumerate(coords)})
        out ^= np.uint64(every_d)
        for k in (1, 2, 4, 8, 16, 32):
            out ^= out >> np.uint64(k)
        return pd.Series(out.astype(np.int64))

    return run


def hilbert(p: Sequence[Column]) -> Column:
    """Place along the Hilbert curve, 32 bits a coordinate in two dimensions and 21 in three."""
    return F.pandas_udf(_annotated(_hilbert(_dims(p), False), len(p)), "long")(*[c.cast("long") for c in p])


def hilbert_decode(code: Column, d: int) -> list[Column]:
    """The coordinates of a place along the Hilbert curve."""
    if d not in BITS:
        raise ValueError(f"curves have 2 or 3 dimensions, not {d}")
    point = F.pandas_udf(_annotated(_hilbert(d, True), 1, pd.DataFrame), ", ".join(f"x{i} long" for i in range(d)))(code.cast("long"))
    return [point[f"x{i}"] for i in range(d)]


def _annotated(run: Callable, n: int, result: type = pd.Series) -> Callable:
    """run with n arguments and the type hints by which a function over columns is known."""

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    def code(a: pd.Series) -> pd.DataFrame:
        return run(a)

    return {1: code, 2: two, 3: three}[n]


def precedes(p: Sequence[Column], q: Sequence[Column], name: str = "hilbert") -> Column:
    """Whether a point comes before another along a curve."""
    return encode(name, p) < encode(name, q)


def corner(code: int, d: int, name: str = "hilbert") -> list[int]:
    """The point at a place of the curve, for a code in the driver's hand."""
    if name == "hilbert":
        row = _hilbert(d, True)(pd.Series([code])).iloc[0]
        return [int(v) for v in row]
    return [sum((code >> (d * k + i) & 1) << k for k in range(BITS[d])) for i in range(d)]


def code_ranges(lo: Sequence[int], hi: Sequence[int], name: str = "hilbert", most: int = 64) -> list[tuple[int, int]]:
    """Ranges of codes, in order, that cover a box and, with `most` ranges to spare, nothing else.

    A curve fills a square of side 2**k (a cube) with consecutive codes, so squares that lie in the box count whole, those apart
    from it are dropped, and the largest of the others are split until there would be too many."""
    d = len(lo)
    todo, done = [(BITS[d] - (d == 2), 0)], []
    while todo:
        k, start = todo.pop(0)  # the largest squares come first
        side = 1 << k
        at = [v & ~(side - 1) for v in corner(start, d, name)]
        if any(a > h or a + side - 1 < b for a, b, h in zip(at, lo, hi, strict=True)):
            continue
        if k == 0 or all(b <= a and a + side - 1 <= h for a, b, h in zip(at, lo, hi, strict=True)) or len(todo) + len(done) >= most:
            done.append((start, start + (1 << d * k) - 1))
        else:
            todo += [(k - 1, start + (j << d * (k - 1))) for j in range(1 << d)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def next_in_box(code: int, lo: Sequence[int], hi: Sequence[int], name: str = "hilbert") -> int | None:
    """The first place at or after code whose point is in the box; from 0, the first in the box."""
    d = len(lo)
    top = BITS[d] - (d == 2)

    def seek(k: int, start: int) -> int | None:
        size, side = 1 << d * k, 1 << k
        if start + size <= code:
            return None
        at = [v & ~(side - 1) for v in corner(start, d, name)]
        if any(a > h or a + side - 1 < b for a, b, h in zip(at, lo, hi, strict=True)):
            return None
        if all(b <= a and a + side - 1 <= h for a, b, h in zip(at, lo, hi, strict=True)):
            return max(start, code)
        return next((found for j in range(1 << d) if (found := seek(k - 1, start + (j << d * (k - 1)))) is not None), None)

    return seek(top, 0)


def in_code_ranges(code: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """A filter on a code column, as ranges that the statistics of a curve-sorted table can prune by."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | code.between(a, b)
    return out


CURVES: dict[str, Callable[[Sequence[Column]], Column]] = {"morton": morton, "hilbert": hilbert}


def encode(name: str, p: Sequence[Column]) -> Column:
    return CURVES[name](p)

"""Geometry of points and boxes as column expressions; all of them stay in generated code.

A point is a tuple of columns, one for each dimension. A box is a pair (lo, hi) of such
tuples, closed on every side; a box whose lo exceeds hi somewhere is empty, not an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Coords = Sequence[Column]


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def lits(values: Sequence[int | float]) -> list[Column]:
    return [F.lit(v) for v in values]


def in_box(p: Coords, lo: Coords, hi: Coords) -> Column:
    return reduce(and_, (c.between(a, b) for c, a, b in zip(p, lo, hi, strict=True)))


def same_point(p: Coords, q: Coords) -> Column:
    return reduce(and_, (a == b for a, b in zip(p, q, strict=True)))


def box_in_box(lo: Coords, hi: Coords, outer_lo: Coords, outer_hi: Coords) -> Column:
    return reduce(and_, ((a >= c) & (b <= d) for a, b, c, d in zip(lo, hi, outer_lo, outer_hi, strict=True)))


def boxes_intersect(lo: Coords, hi: Coords, lo2: Coords, hi2: Coords) -> Column:
    return reduce(and_, ((a <= d) & (b >= c) for a, b, c, d in zip(lo, hi, lo2, hi2, strict=True)))


def same_box(lo: Coords, hi: Coords, lo2: Coords, hi2: Coords) -> Column:
    return same_point(lo, lo2) & same_point(hi, hi2)


def box_is_empty(lo: Coords, hi: Coords) -> Column:
    return reduce(or_, (a > b for a, b in zip(lo, hi, strict=True)))


def box_is_flat(lo: Coords, hi: Coords, dim: int) -> Column:
    return lo[dim] == hi[dim]


def box_relation(lo: Coords, hi: Coords, lo2: Coords, hi2: Coords) -> Column:
    """1 if the first box lies in the second, -1 if they are apart, else 0."""
    return F.when(box_in_box(lo, hi, lo2, hi2), 1).when(~boxes_intersect(lo, hi, lo2, hi2), -1).otherwise(0)


def boxes_within(lo: Coords, hi: Coords, lo2: Coords, hi2: Coords, gap: Column) -> Column:
    """Whether two boxes come within gap of each other along every axis."""
    return reduce(and_, ((a - gap <= d) & (b + gap >= c) for a, b, c, d in zip(lo, hi, lo2, hi2, strict=True)))


def line_side(lo: Column, hi: Column, cut: Column) -> Column:
    """Where a cut across one axis lies: 'left' or 'right' of the box, on its 'edge', or 'through' it."""
    return F.when(cut < lo, "left").when(cut > hi, "right").when((cut == lo) | (cut == hi), "edge").otherwise("through")


def _half(c: Column) -> Column:
    """Half of an integer, towards zero, in whole numbers: exact beyond 2**53 too."""
    return F.call_function("div", c, F.lit(2))


def box_mid(lo: Column, hi: Column, integral: bool = True) -> Column:
    """The cut halfway through a box; for integers it rounds up, as a box with lo <= hi has it."""
    return lo + _half(hi - lo + 1) if integral else (lo + hi) / 2


def box_center(lo: Column, hi: Column, integral: bool = True) -> Column:
    """Half of lo + hi; of integers towards zero."""
    return _half(lo + hi) if integral else (lo + hi) / 2


def half_up(c: Column, integral: bool = True) -> Column:
    """(c + 1) / 2 of an integer, towards zero; half of a double, rounded up."""
    return _half(c + 1) if integral else F.ceil(c / 2)


#: The empty box: lo above every coordinate, hi below.
EMPTY = (2**63 - 1, -(2**63))


def box_is_legal(lo: Coords, hi: Coords) -> Column:
    """Not inverted, or the empty box."""
    return ~box_is_empty(lo, hi) | reduce(and_, ((a == EMPTY[0]) & (b == EMPTY[1]) for a, b in zip(lo, hi, strict=True)))


#: Doubles nearer than this count as equal in the comparisons below.
EPSILON = 2.0**-52


def eps_gt(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a - b > eps


def eps_lt(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a - b < -eps


def eps_eq(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.abs(a - b) < eps


def eps_geq(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return ~eps_lt(a, b, eps)


def eps_leq(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return ~eps_gt(a, b, eps)


def eps_min(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.when(eps_lt(a, b, eps), a).otherwise(b)


def eps_max(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.when(eps_gt(a, b, eps), a).otherwise(b)


def eps_abs(a: Column, eps: float = EPSILON) -> Column:
    return F.when(eps_lt(a, F.lit(0.0), eps), -a).otherwise(a)


def eps_is_zero(a: Column, eps: float = EPSILON) -> Column:
    return eps_eq(a, F.lit(0.0), eps)


def eps_in_box(p: Coords, lo: Coords, hi: Coords, eps: float = EPSILON) -> Column:
    """in_box for doubles that may miss an edge by eps."""
    return reduce(and_, (eps_geq(c, a, eps) & eps_leq(c, b, eps) for c, a, b in zip(p, lo, hi, strict=True)))


def min_coords(p: Coords, q: Coords) -> list[Column]:
    return [F.least(a, b) for a, b in zip(p, q, strict=True)]


def max_coords(p: Coords, q: Coords) -> list[Column]:
    return [F.greatest(a, b) for a, b in zip(p, q, strict=True)]


def box_of_boxes(names: Sequence[str]) -> list[Column]:
    """Aggregates for the bounding box of boxes in columns lo_c and hi_c."""
    return [e for c in names for e in (F.min(f"lo_{c}").alias(f"lo_{c}"), F.max(f"hi_{c}").alias(f"hi_{c}"))]


def child_boxes(lo: Coords, hi: Coords, cuts: Coords) -> list[tuple[list[Column], list[Column]]]:
    """The 2**d parts of a box by one cut a dimension, as orth_cell numbers them; both sides keep the cut."""
    out = [(list(lo), list(hi))]
    for i, cut in enumerate(cuts):
        out = [half for a, b in out for half in box_cut(a, b, i, cut)]
    return out


def find_bucket(p: Coords, pivots: Sequence[tuple[int, int | float]]) -> Column:
    """The leaf, from 0, to which a complete binary tree of (dimension, cut) pivots leads a point, given level by level; below a cut is left."""

    def walk(k: int) -> Column:
        if k > len(pivots):
            return F.lit(k - len(pivots) - 1)
        dim, cut = pivots[k - 1]
        return F.when(p[dim] < F.lit(cut), walk(2 * k)).otherwise(walk(2 * k + 1))

    return walk(1)


def box_cut(lo: Coords, hi: Coords, dim: int, cut: Column) -> tuple[tuple[list, list], tuple[list, list]]:
    """The two halves of a box; both keep the cut."""
    left_hi, right_lo = list(hi), list(lo)
    left_hi[dim], right_lo[dim] = cut, cut
    return (list(lo), left_hi), (right_lo, list(hi))


def box_union(lo: Coords, hi: Coords, lo2: Coords, hi2: Coords) -> tuple[list[Column], list[Column]]:
    return min_coords(lo, lo2), max_coords(hi, hi2)


def d2(p: Coords, q: Coords) -> Column:
    """Squared distance; of integers an integer."""
    return reduce(add, ((a - b) * (a - b) for a, b in zip(p, q, strict=True)))


def box_min_d2(p: Coords, lo: Coords, hi: Coords) -> Column:
    gaps = [F.greatest(a - c, F.lit(0), c - b) for c, a, b in zip(p, lo, hi, strict=True)]
    return reduce(add, (g * g for g in gaps))


def box_max_d2(p: Coords, lo: Coords, hi: Coords) -> Column:
    far = [F.greatest(F.abs(c - a), F.abs(b - c)) for c, a, b in zip(p, lo, hi, strict=True)]
    return reduce(add, (g * g for g in far))


def circle_gap(p: Coords, center: Coords, radius: Column) -> Column:
    """Distance from a point to a circle; negative inside."""
    return F.sqrt(d2(p, center)) - radius


def vector_d2(a: Column, b: Column) -> Column:
    """Squared distance of two array columns."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def precedes(p: Coords, q: Coords) -> Column:
    """Lexicographic order of points."""
    out, same = F.lit(False), F.lit(True)
    for a, b in zip(p, q, strict=True):
        out, same = out | (same & (a < b)), same & (a == b)
    return out

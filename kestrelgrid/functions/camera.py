"""Rotations, poses, lenses and covariances as column expressions.

Rotations are nine columns, row by row, that take camera directions (x right, y down, z ahead) to east, north and up. All is
built from sines, cosines and products, so a plan that uses it stays inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> list[Column]:
    """The direction of a vector; NULL where it has no length."""
    n = length(a)
    return [F.when(n > 1e-9, x / n) for x in a]


def rows(m: Vector) -> list[Vector]:
    return [m[0:3], m[3:6], m[6:9]]


def turned(m: Vector) -> list[Column]:
    """The transposed matrix: of a rotation, its inverse."""
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def product(a: Vector, b: Vector) -> list[Column]:
    across = rows(turned(b))
    return [dot(r, c) for r in rows(a) for c in across]


def rotated(m: Vector, v: Vector) -> list[Column]:
    return [dot(r, v) for r in rows(m)]


def degrees_between(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def gimbal_rotation(yaw: Column, pitch: Column, roll: Column) -> list[Column]:
    """The camera's rotation from degrees; yaw counterclockwise from north (a compass heading, negated), pitch 0 level and -90 straight down."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    side, up = [cr, -sr, F.lit(0.0)], [sp * sr, sp * cr, cp]
    return [*(cy * a - sy * b for a, b in zip(side, up)), *(sy * a + cy * b for a, b in zip(side, up)), -cp * sr, -cp * cr, sp]


def up_in_camera(pitch: Column, roll: Column) -> list[Column]:
    """The world's up in the camera's frame; it depends on no heading."""
    cp, sp, cr, sr = (f(F.radians(a)) for a in (pitch, roll) for f in (F.cos, F.sin))
    return [-cp * sr, -cp * cr, sp]


def ahead(heading: Column, pitch: Column) -> list[Column]:
    """Where a camera without roll looks."""
    cp = F.cos(F.radians(pitch))
    return [-F.sin(F.radians(heading)) * cp, F.cos(F.radians(heading)) * cp, F.sin(F.radians(pitch))]


def rotation_change(a: Vector, b: Vector) -> Column:
    """Degrees between two rotations."""
    return degrees_between((dot(a, b) - 1) / 2)


def gravity_error(relative: Vector, a: Vector, b: Vector) -> Column:
    """Degrees by which a rotation from camera a to camera b carries the up of a beside the up of b."""
    up_a, up_b = list(a[6:9]), list(b[6:9])
    carried = rotated(relative, up_a)
    return degrees_between(dot(carried, up_b) / (length(carried) * length(up_b)))


def in_camera(m: Vector, centre: Vector, point: Vector) -> list[Column]:
    """A world point in the camera's frame."""
    return rotated(turned(m), [p - c for p, c in zip(point, centre)])


def flat(seen: Vector) -> tuple[Column, Column, Column]:
    """(x / z, y / z, z) of a point in the camera's frame; NULL shares where it isn't in front."""
    front = seen[2] > 1e-6
    return F.when(front, seen[0] / seen[2]), F.when(front, seen[1] / seen[2]), seen[2]


def pixel(x: Column, y: Column, focal: Vector, centre: Vector, lens: Vector | None = None) -> tuple[Column, Column]:
    """Pixel of a flat direction through a lens of coefficients k1, k2, p1, p2, k3."""
    if lens is not None:
        k1, k2, p1, p2, k3 = lens
        r2 = x * x + y * y
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        x, y = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return focal[0] * x + centre[0], focal[1] * y + centre[1]


def focal_of_view(degrees: Column, width: Column) -> Column:
    """Focal length in pixels of a horizontal field of view."""
    return width / (2 * F.tan(F.radians(degrees) / 2))


def similar(scale: Column, m: Vector, shift: Vector, point: Vector) -> list[Column]:
    return [scale * x + t for x, t in zip(rotated(m, point), shift)]


def similar_covariance(scale: Column, m: Vector, cov: Vector) -> list[Column]:
    """Covariance, nine columns, of points moved by a similarity."""
    return [scale * scale * x for x in product(product(m, cov), turned(m))]


def semi_axes(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """One-sigma half axes of a covariance, the longest first: roots of the eigenvalues in closed form. An axis shorter than a ten-thousandth of the first is lost in its rounding."""
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (2 * p * p * p)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    first, last = mean + 2 * p * F.cos(turn), mean + 2 * p * F.cos(turn + 2 * math.pi / 3)
    values = [first, 3 * mean - first - last, last]
    return [F.sqrt(F.greatest(F.lit(0.0), F.when(p > 1e-12, v).otherwise(mean))) for v in values]


def axis_of(value: Column, xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """The direction of an eigenvalue that stands alone: the longest of the products of two rows of the matrix less the value."""
    a, b, c = [xx - value, xy, xz], [xy, yy - value, yz], [xz, yz, zz - value]
    offers = [cross(a, b), cross(a, c), cross(b, c)]
    best = F.array_max(F.array(*[F.struct(dot(o, o).alias("n"), *[x.alias(k) for x, k in zip(o, "xyz")]) for o in offers]))
    n = F.sqrt(best["n"])
    return [F.when(n > 0, best[k] / n) for k in "xyz"]


def directions_offered(worst: Vector, seen: Vector, path: Vector) -> Column:
    """What a further view's direction may be: the part of the worst axis across the mean ray, what is across ray and path, and what is across ray and up."""
    along = dot(worst, seen)
    offers = [[w - along * v for w, v in zip(worst, seen)], cross(seen, path), cross(seen, [F.lit(0.0), F.lit(0.0), F.lit(1.0)])]
    return F.array(*[F.struct(*[x.alias(k) for x, k in zip(o, "xyz")], length(o).alias("n")) for o in offers])


def new_direction(offers: Column, along: Column, parallel: float = 0.85) -> Column:
    """The direction of a further view that settles the worst axis best, as a struct: the first of directions_offered() that has a length, or the second where worst axis and mean ray are parallel."""
    usable = F.filter(offers, lambda o, i: (o["n"] >= 1e-9) & ((i > 0) | (F.abs(along) <= parallel)))
    best = F.get(usable, F.lit(0))
    return F.struct(*[F.coalesce(best[k] / best["n"], F.lit(x)).alias(k) for k, x in zip("xyz", (1.0, 0.0, 0.0))])


def settled_share(angle: Column) -> Column:
    """Share of the uncertainty that a further view at this angle (radians) settles, 0.9 at most."""
    return F.least(F.lit(0.9), F.pow(F.sin(angle), 2))

"""Hierarchical cell ids on the cube-projected Hilbert curve (the public S2 geometry).

Leaf ids come from a vectorised function; every coarser level is bit arithmetic
on the leaf id and stays in the JVM. Ids are unsigned in theory and signed longs
here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVEL = 30
#: Levels that the index keeps by default.
LEVELS = (0, *range(3, 18))
SIZE = 1 << MAX_LEVEL


def _curve_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and next orientation of a quadrant, and the inverse, from the curve's definition.

    Orientation bit 0 swaps the axes, bit 1 inverts them. In the canonical
    orientation quadrants follow 00, 01, 11, 10; the first is entered swapped
    and the last swapped and inverted.
    """
    order = np.array([0b00, 0b01, 0b11, 0b10])
    turn = np.array([1, 0, 0, 3])
    pos, after, quad = (np.zeros((4, 4), dtype=np.int64) for _ in range(3))
    for orientation in range(4):
        for p in range(4):
            ij = order[p]
            if orientation & 1:
                ij = (ij & 1) << 1 | ij >> 1
            if orientation & 2:
                ij ^= 0b11
            pos[orientation, ij], after[orientation, ij], quad[orientation, p] = p, orientation ^ turn[p], ij
    return pos, after, quad, turn


POS, AFTER, QUAD, TURN = _curve_tables()


def st_of_uv(u: np.ndarray) -> np.ndarray:
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def uv_of_st(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def leaf_ids(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Leaf cell ids as unsigned 64-bit integers."""
    phi, theta = np.radians(lat), np.radians(lon)
    p = np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)])
    axis = np.abs(p).argmax(axis=0)
    major = np.take_along_axis(p, axis[None], axis=0)[0]
    face = axis + 3 * (major < 0)
    x, y, z = p
    pick = lambda *cases: np.choose(face, cases)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = pick(y / x, -x / y, -x / z, z / x, z / y, -y / z)
        v = pick(z / x, z / y, -y / z, y / x, -x / y, -x / z)
    index = lambda t: np.clip(np.floor(st_of_uv(t) * SIZE).astype(np.int64), 0, SIZE - 1)
    i, j = index(u), index(v)
    orientation, out = face & 1, face.astype(np.uint64)
    for bit in range(MAX_LEVEL - 1, -1, -1):
        ij = (i >> bit & 1) << 1 | (j >> bit & 1)
        out = out << np.uint64(2) | POS[orientation, ij].astype(np.uint64)
        orientation = AFTER[orientation, ij]
    return out << np.uint64(1) | np.uint64(1)


def rings_of(cells: np.ndarray) -> np.ndarray:
    """The four (lon, lat) vertices of cells (unsigned 64-bit), not closed: an array of shape (cells, 4, 2)."""
    cells = cells.astype(np.uint64)
    lowest = cells & (~cells + np.uint64(1))
    level = MAX_LEVEL - np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 2
    face = (cells >> np.uint64(61)).astype(np.int64)
    orientation, i, j = face & 1, np.zeros(len(cells), dtype=np.int64), np.zeros(len(cells), dtype=np.int64)
    for k in range(MAX_LEVEL):
        deeper = k < level
        ij = QUAD[orientation, (cells >> np.uint64(59 - 2 * k) & np.uint64(3)).astype(np.int64)]
        orientation = np.where(deeper, AFTER[orientation, ij], orientation)
        i, j = np.where(deeper, i << 1 | ij >> 1, i), np.where(deeper, j << 1 | ij & 1, j)
    scale, out = 1.0 / (1 << level).astype(np.float64), []
    for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1)):
        u, v, one = uv_of_st((i + di) * scale), uv_of_st((j + dj) * scale), np.ones(len(cells))
        x = np.choose(face, [one, -u, -u, -one, v, v])
        y = np.choose(face, [u, one, -v, -v, -one, u])
        z = np.choose(face, [v, v, one, -u, -u, -one])
        out.append(np.stack([np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))], axis=1))
    return np.stack(out, axis=1)


def ring_of(cell: int) -> list[tuple[float, float]]:
    """The vertices of one cell."""
    return [tuple(p) for p in rings_of(np.array([cell & (1 << 64) - 1], dtype=np.uint64))[0].tolist()]


@F.pandas_udf(T.LongType())
def leaf_id(lat: pd.Series, lon: pd.Series) -> pd.Series:
    ok = (lat.notna() & lon.notna()).to_numpy()
    out = np.zeros(len(lat), dtype=np.int64)
    out[ok] = leaf_ids(lat.to_numpy()[ok], lon.to_numpy()[ok]).view(np.int64)
    return pd.Series(out).where(pd.Series(ok)).astype("Int64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])))
def cell_ring(cell: pd.Series) -> pd.Series:
    known = cell.dropna().astype(np.int64)
    rings = rings_of(known.to_numpy().view(np.uint64)).tolist()
    made = pd.Series([[{"lon": x, "lat": y} for x, y in ring] for ring in rings], index=known.index, dtype=object)
    return made.reindex(cell.index).where(cell.notna(), None)


def parent(cell: Column, level: int) -> Column:
    """The ancestor at a level, by masking."""
    lsb = 1 << 2 * (MAX_LEVEL - level)
    return cell.bitwiseAND(F.lit(-lsb)).bitwiseOR(F.lit(lsb))


def token(cell: Column) -> Column:
    """Hexadecimal without trailing zeros."""
    return F.rtrim(F.lower(F.lpad(F.hex(cell), 16, "0")), F.lit("0"))

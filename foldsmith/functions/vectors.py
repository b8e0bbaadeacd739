"""Vectors, bit strings and sequences as column expressions [F5-F8, F12, T6, T13, T14, A20]."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """F6."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column) -> Column:
    """A long whose bit i is set where element i is 0 or more; 64 elements."""
    bits = F.transform(v, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sigmoid(x: Column) -> Column:
    """F12."""
    return 1 / (1 + F.exp(-x))


def span_max(values: Column, start: Column, end: Column) -> Column:
    """Greatest of the values in [start, end)."""
    return F.array_max(F.slice(values, start + 1, end - start))


def lr_factor(step: Column, per_epoch: int, epochs: int, warm_epochs: int, base: float, floor: float) -> Column:
    """Linear warm-up, then cosine decay, never below floor / base."""
    warm, total = per_epoch * warm_epochs, per_epoch * epochs
    progress = (step - warm) / max(1, total - warm)
    decay = F.greatest(F.lit(floor / base), 0.5 * (1 + F.cos(math.pi * progress)))
    return F.when(step < warm, step / max(1, warm)).otherwise(decay)


def ema(values: Column, decay: float, first: float) -> Column:
    """Exponential moving average over an ordered array."""
    return F.aggregate(values, F.lit(first), lambda s, p: decay * s + (1 - decay) * p)


def ordered_fingerprint(lines: Column, size: int = 12) -> Column:
    """First characters of the MD5 of an array's lines."""
    return F.substring(F.md5(F.array_join(lines, "\n").cast("binary")), 1, size)


def _dihedral(m: np.ndarray) -> list[np.ndarray]:
    turned = [np.rot90(m, k) for k in range(4)]
    return turned + [np.fliplr(t) for t in turned]


def perceptual_hashes(pixels: list[float], side: int = 32, low: int = 8) -> list[int] | None:
    """F8: hashes of a grey square in its 8 orientations: signs of the low DCT coefficients about their median."""
    m = np.asarray(pixels, float)
    if m.size != side * side or not np.isfinite(m).all():
        return None
    k = np.arange(side)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * side))
    out = []
    for view in _dihedral(m.reshape(side, side)):
        block = (basis @ view @ basis.T)[:low, :low].ravel()
        bits = block > np.median(block[1:])
        out.append(int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64)))
    return out


#: The side of a grey square and of its low corner of cosine coefficients, as perceptual_hashes has them.
SIDE, LOW = 32, 8
_BASIS = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(SIDE)[:, None] / (2 * SIDE))


def _dihedral_of(squares: np.ndarray) -> list[np.ndarray]:
    """The 8 orientations of many squares."""
    turned = [np.rot90(squares, k, axes=(1, 2)) for k in range(4)]
    return turned + [t[:, :, ::-1] for t in turned]


@F.pandas_udf(T.ArrayType(T.LongType()))
def phash8(pixels: pd.Series) -> pd.Series:
    """perceptual_hashes of arrays of 1,024 pixels; null where they are no such array. A batch is a few matrix products."""
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    some = [i for i, p in enumerate(pixels) if p is not None and len(p) == SIDE * SIDE]
    if not some:
        return out
    m = np.stack([np.asarray(pixels.iloc[i], float) for i in some]).reshape(-1, SIDE, SIDE)
    ok = np.isfinite(m).all(axis=(1, 2))
    views = np.stack(_dihedral_of(m[ok]), axis=1)
    low = (_BASIS[:LOW] @ views @ _BASIS[:LOW].T).reshape(len(views), 8, LOW * LOW)
    bits = low > np.median(low[..., 1:], axis=2, keepdims=True)
    hashes = np.packbits(bits, axis=2).view(">u8")[..., 0].astype(np.uint64).view(np.int64)
    for i, h in zip(np.array(some)[ok].tolist(), hashes.tolist()):
        out.iloc[i] = h
    return out

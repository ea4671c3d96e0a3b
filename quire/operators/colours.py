"""The paper's and the ink's colour of a block, from the pixels of its page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest side that is looked at; bits of a channel that are dropped; how far from the paper's colour
#: ink is; the part of the ink's pixels that tells its colour; and from which luminance on paper is light.
SIDE, DROPPED, FAR, PART, LIGHT = 96, 3, 0.12, 4, 0.5
WHITE, BLACK = (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)
LUMINANCE = (0.2126, 0.7152, 0.0722)


def thumbnail(image: bytes | None, width: int, height: int, box: tuple[int, int, int, int]) -> np.ndarray | None:
    """Pixels (n, 3) of a box (x0, y0, x1, y1) of an image of 8-bit red, green, blue, no longer than SIDE each way.

    Pixels are picked, not averaged: averages hold no ink. Null where the box has under two pixels either way or the
    image is shorter than its size says.
    """
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3])
    w, h = x1 - x0, y1 - y0
    if w < 2 or h < 2 or image is None or len(image) < width * height * 3:
        return None
    scale = min(1.0, SIDE / max(w, h))
    across, down = (max(1, int(n * scale)) for n in (w, h))
    xs, ys = (a + ((2 * np.arange(k) + 1) * n) // (2 * k) for a, k, n in ((x0, across, w), (y0, down, h)))
    page = np.frombuffer(image, np.uint8, width * height * 3).reshape(height, width, 3)
    return page[ys[:, None], xs[None, :]].reshape(-1, 3).astype(np.int64)


def sampled(pixels: np.ndarray | None) -> tuple[tuple, tuple]:
    """(paper, ink): the mean of the fullest bucket of five bits a channel, and of the buckets farthest from it that
    together hold a quarter of what is far enough. Of equally full or far buckets the lower comes first."""
    if pixels is None or not len(pixels):
        return WHITE, BLACK
    q = pixels >> DROPPED
    key = (q[:, 0] << 10) | (q[:, 1] << 5) | q[:, 2]
    buckets, at, count = np.unique(key, return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(at, pixels[:, c], len(buckets)) for c in range(3)], axis=1)
    colour = sums / count[:, None] / 255
    top = int(np.argmax(count))
    far = np.sqrt(((colour - colour[top]) ** 2).sum(axis=1) / 3)
    ink = np.flatnonzero(far > FAR)
    paper = tuple(colour[top].tolist())
    if not len(ink):
        return paper, BLACK if sum(a * b for a, b in zip(LUMINANCE, paper, strict=True)) > LIGHT else WHITE
    ink = ink[np.argsort(-far[ink], kind="stable")]
    held = np.cumsum(count[ink])
    taken = ink[: int(np.searchsorted(held, max(1, int(held[-1]) // PART))) + 1]
    return paper, tuple((sums[taken].sum(axis=0) / count[taken].sum() / 255).tolist())


def sample(image: Column, width: Column, height: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(paper, ink) of arrays (red, green, blue in [0, 1]) of a box of each row's image (rows of RGB bytes).

    A box without pixels, or an image that is null or too short, is black on white. At most SIDE x SIDE pixels of a box
    are looked at.
    """

    @F.pandas_udf("struct<paper:array<double>,ink:array<double>>")
    def run(i: pd.Series, w: pd.Series, h: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [sampled(thumbnail(v[0], int(v[1]), int(v[2]), tuple(map(int, v[3:])))) for v in zip(i, w, h, a, b, c, d, strict=True)]
        return pd.DataFrame([[list(p), list(k)] for p, k in rows], columns=["paper", "ink"])

    return run(image, *[c.cast("int") for c in (width, height, x0, y0, x1, y1)])

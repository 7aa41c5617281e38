"""Vector expressions and image patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH = (80, 64)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a side is null or all zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def matrix(rows: list) -> np.ndarray:
    return np.array([list(r) for r in rows], np.float64)


def nearest_codeword(vector: Column, centres: np.ndarray) -> Column:
    """Place of the nearest centre (Euclid), the first of equals. The codebook is a few hundred rows by definition."""
    squares = (centres**2).sum(axis=1)

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(np.round(squares[None, :] - 2 * x @ centres.T, 9).argmin(axis=1).astype(np.int32))

    return run(vector)


def patches(image: np.ndarray, size: tuple[int, int] = PATCH, overlap: tuple[int, int] = (0, 0)) -> list[np.ndarray]:
    """Tiles of an image, row by row, the image zero-padded at the bottom and right to a whole number of steps."""
    step = [s - o for s, o in zip(size, overlap, strict=True)]
    if min(step) <= 0:
        raise ValueError("overlap must be less than the patch")
    pad = [(0, s - n if n < s else -(n - s) % d) for n, s, d in zip(image.shape, size, step, strict=False)]
    full = np.pad(image, pad + [(0, 0)] * (image.ndim - 2))
    tiles = np.lib.stride_tricks.sliding_window_view(full, size, axis=(0, 1))[:: step[0], :: step[1]]
    tiles = np.moveaxis(tiles, (-2, -1), (2, 3))
    return list(tiles.reshape(-1, *tiles.shape[2:]))


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red image; a grey one as it is."""
    return image if image.ndim == 2 else (image[..., :3] @ np.array([0.114, 0.587, 0.299])).round().astype(image.dtype)


def descriptors(images: DataFrame, decode: Callable[[bytes], np.ndarray | None], describe: Callable[[np.ndarray], np.ndarray], strict: bool = False) -> DataFrame:
    """doc_id, patch and descriptor of every descriptor of every patch.

    ``images``: doc_id and content. ``decode`` gives a matrix, or None for what
    is no image, which is skipped, or an error if ``strict`` as it is for the
    image of a query; ``describe`` gives the rows of a patch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame.doc_id, frame.content, strict=True):
                image = decode(bytes(content)) if content is not None else None
                if image is None and strict:
                    raise ValueError(f"the image of {doc_id} cannot be decoded")
                for i, tile in enumerate(patches(image) if image is not None else []):
                    rows += ((doc_id, i, [float(v) for v in d]) for d in describe(grey(tile)))
            yield pd.DataFrame(rows, columns=["doc_id", "patch", "descriptor"])

    return images.select("doc_id", "content").mapInPandas(run, "doc_id long, patch int, descriptor array<float>")

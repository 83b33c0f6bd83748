"""Signatures of images, and the same idea for texts. Kinds (iht): 1 histogram, 2 equalised, 3 difference, 4 average, 5 cosine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts whose characters are looked at together.
PIECE = 1 << 20
LUMA = np.array([299, 587, 114])  # red, green, blue in thousandths


def gray(pixels: np.ndarray) -> np.ndarray:
    """Height x width x channels (red first) or one channel as 8-bit gray."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2]).astype(np.float64)
    return (pixels[..., :3].astype(np.int64) @ LUMA // 1000).astype(np.float64)


def shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Area-weighted size x size copy, rounded to whole tones."""

    def weights(n: int) -> np.ndarray:
        edge = np.linspace(0, n, size + 1)
        return np.clip(np.minimum(edge[1:, None], np.arange(n) + 1) - np.maximum(edge[:-1, None], np.arange(n)), 0, None) * size / n

    return np.floor(weights(image.shape[0]) @ image @ weights(image.shape[1]).T + 0.5)


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.astype(bool)).tobytes().hex()


def histogram_signature(pixels: np.ndarray) -> str:
    """16 shares of tones for each of one or three channels, as hex numbers to ffff."""
    out = []
    for band in range(1 if pixels.ndim == 2 or pixels.shape[2] == 1 else 3):
        tones = np.bincount((pixels if pixels.ndim == 2 else pixels[..., band]).ravel().astype(int), minlength=256)
        total = float(tones.sum())
        for part in tones.reshape(16, 16):
            out.append(f"{int(65535 * sum(float(t) / total for t in part.tolist())):x}")
    return " ".join(out)


def _blur(image: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(image, radius, mode="edge")
    rows = np.apply_along_axis(np.convolve, 0, padded, kernel, "valid")
    return np.apply_along_axis(np.convolve, 1, rows, kernel, "valid")


def equalised_signature(pixels: np.ndarray) -> str:
    """Gray 160 x 160, blurred, stretched, equalised, 8 x 8, bright half."""
    g = gray(pixels)
    at = lambda n: np.arange(160) * n // 160
    g = _blur(g[np.ix_(at(g.shape[0]), at(g.shape[1]))], 15, 19.0)
    low, high = g.min(), g.max()
    tone = np.floor((g - low) / (high - low) * 255 if high > low else g).astype(int).clip(0, 255)
    share = np.cumsum(np.bincount(tone.ravel(), minlength=256)) / tone.size
    small = share[tone][10::20, 10::20]
    return _hex((small >= 0.5).ravel())


def difference_signature(pixels: np.ndarray) -> str:
    """Along a winding path over 8 x 8 tones: not darker than the one before; the first follows the last row's first."""
    tones = shrink(gray(pixels), 8)
    start = tones[7, 0]
    tones[1::2] = tones[1::2, ::-1].copy()
    path = tones.ravel()
    return _hex(path >= np.concatenate([[start], path[:-1]]))


def average_signature(pixels: np.ndarray) -> str:
    tones = shrink(gray(pixels), 8)
    return _hex((tones >= tones.mean()).ravel())


def cosine_signature(pixels: np.ndarray) -> str:
    """Signs of the 8 x 8 lowest cosine coefficients, the constant ones apart, around their median."""
    tones = shrink(gray(pixels), 32)
    basis = np.cos(np.pi / 64 * np.outer(np.arange(1, 9), 2 * np.arange(32) + 1))
    low = basis @ tones @ basis.T
    return _hex((low > np.median(low)).ravel())


@dataclass(frozen=True)
class Signature:
    function: Callable[[np.ndarray], str]
    kind: str  # how two of them compare: hamming or histogram
    divisor: float  # of a distance, for the similarity


REGISTRY = {
    1: Signature(histogram_signature, "histogram", 100.0), 2: Signature(equalised_signature, "hamming", 64.0), 3: Signature(difference_signature, "hamming", 64.0),
    4: Signature(average_signature, "hamming", 64.0), 5: Signature(cosine_signature, "hamming", 64.0),
}


def signature_column(iht: int) -> Callable[[Column, Column, Column, Column], Column]:
    """A column function of (height, width, nChannels, data) as Spark's image source has them; null if it fails."""
    function = REGISTRY[iht].function

    @F.pandas_udf(T.StringType())
    def of(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, raw in zip(height, width, channels, data, strict=True):
            try:
                pixels = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c))
                out.append(function(pixels[..., 2::-1] if c >= 3 else pixels[..., 0]))  # the source is blue first
            except (ValueError, TypeError, IndexError, ZeroDivisionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return of


def image_signatures(images: DataFrame, kinds: list[int]) -> DataFrame:
    """(contentid, iht, hash) of rows with contentid and image; failures are null hashes."""
    out = None
    for iht in kinds:
        part = images.select("contentid", F.lit(iht).alias("iht"), signature_column(iht)("image.height", "image.width", "image.nChannels", "image.data").alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def missing_signatures(contents: DataFrame, hashes: DataFrame, kinds: list[int], *, retry_failed: bool = False, strict_compat: bool = False) -> DataFrame:
    """(contentid, iht) still to compute for image contents; strict_compat: not if the content has any signature."""
    wanted = contents.where("isimage").select(F.col("id").alias("contentid"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("iht"))
    done = hashes.where("hash is not null") if retry_failed else hashes
    return wanted.join(done.select("contentid", "iht").distinct(), ["contentid"] if strict_compat else ["contentid", "iht"], "left_anti").select("contentid", "iht")


def histogram_bins(text: Column) -> Column:
    """``"ffff 0 …"`` as 8-bit bins."""
    return F.transform(F.split(text, " "), lambda x: F.floor(F.conv(x, 16, 10).cast("int") / 256).cast("int"))


def points_of(texts: pa.Array, points: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(texts x points, characters): characters at equal distances from each text's first, as code points.

    Rows of texts with fewer characters than points mean nothing.
    """
    column = texts.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets, data = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1], column.buffers()[2]
    data = np.concatenate([np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # of characters, and of the zeros
    first = np.searchsorted(begins, offsets)
    size = np.diff(first)
    at = begins[np.minimum(first[:-1, None] + np.arange(points) * size[:, None] // points, len(begins) - 4)]
    lead, rest = data[at], [data[at + i] & 63 for i in (1, 2, 3)]
    code = np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, (lead & 31) << 6 | rest[0], (lead & 15) << 12 | rest[0] << 6 | rest[1]], (lead & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    )
    return code, size


@F.arrow_udf(T.LongType())
def text_signature(texts: pa.Array) -> pa.Array:
    """64 points of a text against their mean, the first in the highest bit; null below 64 characters."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    out, mask, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), 0
    while at < len(texts):  # some texts at a time, for a character takes many bytes here
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        code, size = points_of(texts.slice(at, to - at))
        bits = np.packbits(code * 64 >= code.sum(1, keepdims=True), axis=1)
        out[at:to], mask[at:to], at = np.ascontiguousarray(bits).view(">i8").ravel(), size < 64, to
    return pa.array(out, mask=mask)

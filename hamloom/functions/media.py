"""Perceptual tags of grey images and videos given as pixel arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from hamloom.functions.crypto import fields_hash

# Terms of a projection, frequencies they are drawn from, and the shifts of the generator that draws them.
TERMS, LOW_FREQUENCIES, SHIFTS = 24, 1024, (13, 7, 17)
#: Domain of the secret projections; pass another system's to reproduce its representations.
PROJECTION_DOMAIN = "media-projection/v1"


@lru_cache(4)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def area_resize(pixels: np.ndarray, size: int = 64) -> np.ndarray:
    """Every output pixel is the mean of the input area that it covers."""

    def weights(n: int) -> np.ndarray:
        lo = np.arange(size)[:, None] * n / size
        hi = lo + n / size
        at = np.arange(n)[None, :]
        return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) * size / n

    h, w = pixels.shape
    return weights(h) @ pixels.astype(float) @ weights(w).T


def _spectrum(pixels: np.ndarray) -> np.ndarray:
    c = _cosines(64)
    return c @ area_resize(pixels) @ c.T


def public_tag(pixels: np.ndarray) -> bytes:
    """256 bits: the 16 x 16 lowest frequencies, set where at least the median of the 255 without the mean."""
    low = _spectrum(pixels)[:16, :16].ravel()
    middle = np.sort(low[1:])[127]
    return np.packbits(low >= middle, bitorder="little").tobytes()


@lru_cache(4)
def _projections(domain: str) -> np.ndarray:
    out = np.zeros((256, LOW_FREQUENCIES))
    mask = (1 << 64) - 1
    for b in range(256):
        s = int.from_bytes(fields_hash(domain, str(b).encode())[:8], "big")
        for _ in range(TERMS):
            s ^= s << SHIFTS[0] & mask
            s ^= s >> SHIFTS[1]
            s ^= s << SHIFTS[2] & mask
            out[b, s % LOW_FREQUENCIES] += 1 if s >> 63 else -1
    return out


def private_representation(pixels: np.ndarray, domain: str = PROJECTION_DOMAIN) -> bytes:
    """256 signs of secret projections of the 32 x 32 lowest frequencies less their mean."""
    low = _spectrum(pixels)[:32, :32].ravel()
    return np.packbits(_projections(domain) @ (low - low.mean()) >= 0, bitorder="little").tobytes()


def video_tag(frames: list[bytes]) -> bytes:
    """Per bit the majority over the tags of at most 32 evenly spaced frames, ties set."""
    if not frames:
        raise ValueError("a video needs a frame")
    take = min(32, len(frames))
    chosen = [frames[i * len(frames) // take] for i in range(take)]
    ones = np.unpackbits(np.frombuffer(b"".join(chosen), np.uint8).reshape(take, -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones >= take, bitorder="little").tobytes()


def as_image(values: np.ndarray) -> np.ndarray:
    """All values of a vector as rows of a picture as near to a square as its length allows."""
    n = len(values)
    high = next(h for h in range(max(1, int(n**0.5)), 0, -1) if n % h == 0) if n else 0
    return np.asarray(values, float).reshape(high, -1) if n else np.zeros((1, 1))

"""Waveform samples: ten interpretations, interleaved by channel."""

from __future__ import annotations

import numpy as np

# Fixed values of the standard: sample interpretations and their numpy types; MB and AB are coded as μ-law and A-law bytes.
TYPES = {"SB": "i1", "UB": "u1", "SS": "<i2", "US": "<u2", "SL": "<i4", "UL": "<u4", "SV": "<i8", "UV": "<u8", "MB": "u1", "AB": "u1"}


def decode(data: bytes, interpretation: str, channels: int) -> np.ndarray:
    """Samples as (channels, samples); an incomplete last sample set is left out."""
    if interpretation not in TYPES:
        raise ValueError(f"unknown sample interpretation {interpretation!r}")
    if channels <= 0:
        return np.zeros((0, 0), np.int64)
    t = np.dtype(TYPES[interpretation])
    x = np.frombuffer(data, t, len(data) // t.itemsize)
    return x[: len(x) // channels * channels].reshape(-1, channels).T


def encode(samples: np.ndarray, interpretation: str) -> bytes:
    """The bytes of (channels, samples); raises where a sample does not fit."""
    t = np.dtype(TYPES[interpretation])
    if not fits(samples, interpretation):
        raise ValueError(f"samples do not fit {interpretation}")
    return np.ascontiguousarray(samples.T).astype(t).tobytes()


def fits(samples: np.ndarray, interpretation: str) -> bool:
    info = np.iinfo(np.dtype(TYPES[interpretation]))
    return samples.size == 0 or (int(samples.min()) >= info.min and int(samples.max()) <= info.max)


def expanded(samples: np.ndarray, interpretation: str) -> np.ndarray:
    """μ-law and A-law bytes as linear 16-bit values; others as they are."""
    if interpretation == "MB":
        x = ~samples.astype(np.uint8)
        value = (((x & 0x0F).astype(np.int32) << 3) + 0x84 << ((x & 0x70) >> 4)) - 0x84
        return np.where(x & 0x80, -value, value)
    if interpretation == "AB":
        x = samples.astype(np.uint8) ^ 0x55
        step, low = ((x & 0x70) >> 4).astype(np.int32), ((x & 0x0F).astype(np.int32) << 4) + 8
        value = np.where(step == 0, low, (low + 0x100) << np.maximum(step - 1, 0))
        return np.where(x & 0x80, value, -value)
    return samples

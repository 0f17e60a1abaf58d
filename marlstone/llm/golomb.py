"""Golomb-Rice coding of sorted, distinct 64-bit hashes, with the quotients and remainders in separate streams."""

from __future__ import annotations

import numpy as np


def parameter(n: int, span: int) -> int:
    """Bits of the remainder for n values spread over a span: about log2 of ln 2 times the mean gap."""
    return max(0, int(span * 0.6931471805599453 / max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray, origin: int, span: int) -> tuple[int, bytes, bytes]:
    """values: uint64, strictly rising, in [origin, origin + span)."""
    k = parameter(len(values), span)
    gaps = np.diff(values, prepend=np.uint64(origin))
    q = (gaps >> np.uint64(k)).astype(np.int64) if k < 64 else np.zeros(len(values), np.int64)
    stops = np.cumsum(q + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def decode(n: int, k: int, unary: bytes, rest: bytes, origin: int) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(origin)

"""Media columns: 8-bit WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

Each payload is stored as an 8-bit mono WAV by the `wave` module and read back by it.  Frames of FRAME samples, one
every HOP samples, give power spectra (Hann window, real FFT); the strongest bin of each of BANDS frequency bands in a
frame is a peak if it stands above the band's mean by PROMINENCE.  Each peak is paired with the peaks of the
next REACH frames in the same or the neighbouring band: a fingerprint is (frame of the first peak, code) with
code = first bin, second bin and distance in frames.  One pass over the table, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 576
RATE = 8000
FRAME, HOP = 576, 288
BANDS = 6
REACH = 3
PROMINENCE = 4.0
#: Frames transformed at a time.
CHUNK = 2048

MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FULL = MEDIA + ", times array<int>, codes array<int>"


def to_wav(payload: bytes) -> bytes:
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    import io
    import wave

    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples):
    """Bin of the peak of each frame and band, or -1: (frames, BANDS) int16."""
    import numpy as np

    n = max(0, (len(samples) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if n else None
    window = np.hanning(FRAME).astype(np.float32)
    edges = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)
    out = np.empty((n, BANDS), np.int16)
    for a in range(0, n, CHUNK):
        x = frames[a : a + CHUNK].astype(np.float32)
        spectrum = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b in range(BANDS):
            band = power[:, edges[b] : edges[b + 1]]
            top = band.argmax(axis=1)
            strong = band[np.arange(len(band)), top] > PROMINENCE * band.mean(axis=1) + 1e-3
            out[a : a + len(x), b] = np.where(strong, top + edges[b], -1)
    return out


def pairs(found):
    """Time-coded fingerprints of peaks: (frame, code), in order of time, band, distance, second band."""
    import numpy as np

    n = len(found)
    times, codes, order = [], [], []
    for d in range(1, min(REACH, n - 1) + 1):
        for b in range(BANDS):
            for c in (b - 1, b, b + 1):
                if 0 <= c < BANDS:
                    first, second = found[:-d, b].astype(np.int32), found[d:, c].astype(np.int32)
                    at = np.flatnonzero((first >= 0) & (second >= 0))
                    times.append(at.astype(np.int32))
                    codes.append((first[at] * 512 + second[at]) * 4 + d)
                    order.append(np.full(len(at), (b * 4 + d) * 8 + c, np.int32))
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    times, codes, order = np.concatenate(times), np.concatenate(codes), np.concatenate(order)
    ranked = np.lexsort((order, times))
    return times[ranked], codes[ranked]


def _worker(arrays: bool):
    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in (FULL if arrays else MEDIA).split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                ids = part.column("doc_id").to_pylist()
                for doc, data in zip(ids, part.column("text")):
                    data = (data.as_py() or "").encode()
                    payload = data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))
                    media = to_wav(payload)
                    back = from_wav(media)
                    times, codes = pairs(peaks(np.frombuffer(back, np.uint8)))
                    digest = zlib.crc32(codes.astype("<i4").tobytes(), zlib.crc32(times.astype("<i4").tobytes()))
                    row = (doc, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"pairs={len(codes)};frames={(len(back) - FRAME) // HOP + 1};crc={digest:08x}")
                    rows.append((*row, times, codes) if arrays else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def media_columns(docs: DataFrame, *, arrays: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the digest columns and, with `arrays`, the fingerprints as times and codes.

    A null text counts as empty and becomes one block of 255s, which has no peak; null ids stay null; repeated
    rows give repeated rows; an empty table gives none; other columns are ignored.  feature is
    `pairs=<fingerprints>;frames=<frames>;crc=<crc32 of times, then codes>`, equal for equal texts.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_worker(arrays), FULL if arrays else MEDIA)


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"))

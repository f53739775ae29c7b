"""Operator 2: audio columns and their features.

A payload of bytes is stored losslessly as 8-bit mono samples of a WAV file in a binary column.
Features come from the stored samples: polyphase resampling from 24 to 16 kHz, log-mel energies
of overlapped frames, and segments by energy with hysteresis. The log-mel frames are kept as
Arrow fixed-shape tensors [BLOCK, MELS] with their time spans, in an Arrow stream per row.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow, slices

RATE, TARGET, UP, DOWN = 24_000, 16_000, 2, 3
WINDOW, HOP, FFT, MELS, BLOCK = 400, 160, 512, 40, 16
#: Input samples on each side of an output sample that its filter reads.
HALF = 16
#: A segment starts within ON decibels of the loudest frame and ends below OFF.
ON_DB, OFF_DB = 3.0, 9.0
PAD_TO, PAD_BYTE = 192, b" "
BATCH_BYTES = 1 << 21
#: Samples and frames handled at a time.
CHUNK_FRAMES = 1024


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of one channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def decode_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a file as encode_wav writes it; chunks are walked, unknown ones skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _phases() -> list[tuple[int, np.ndarray]]:
    """For each output phase its whole input offset and its taps (windowed sinc, unit sum)."""
    out = []
    for p in range(UP):
        whole, part = divmod(p * DOWN, UP)
        t = np.arange(-HALF + 1, HALF + 1) - part / UP
        taps = np.sinc(t * UP / DOWN) * np.cos(np.pi * t / (2 * HALF + 2)) ** 2
        out.append((whole, taps / taps.sum()))
    return out


def _mel_filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * TARGET / FFT
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None)


_PHASES, _MEL, _HANN = _phases(), _mel_filters(), np.hanning(WINDOW)


def resample(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """Output samples [first, first + n) of the unsigned 8-bit signal x; first must be a multiple of UP. Silence surrounds x."""
    lo = first // UP * DOWN - HALF + 1
    hi = lo + -(-n // UP) * DOWN + 2 * HALF
    part = (x[max(0, lo) : max(0, hi)].astype(np.float64) - 128) / 128
    part = np.pad(part, (max(0, -lo), max(0, hi - lo - len(part) - max(0, -lo))))
    out = np.empty(-(-n // UP) * UP)
    for p, (whole, taps) in enumerate(_PHASES):
        windows = np.lib.stride_tricks.sliding_window_view(part, 2 * HALF)[whole::DOWN]
        out[p::UP] = windows[: len(out) // UP] @ taps
    return out[:n]


def n_resampled(n: int) -> int:
    return -(-n * UP // DOWN)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies [frames, MELS], frame energies in dB) of unsigned 8-bit samples; frames overlap by WINDOW - HOP."""
    x = np.frombuffer(samples, np.uint8)
    total = n_resampled(len(x))
    frames = -(-max(0, total - WINDOW) // HOP) + 1
    mels, energy = [], []
    for at in range(0, frames, CHUNK_FRAMES):
        n = min(CHUNK_FRAMES, frames - at)
        y = resample(x, at * HOP, (n - 1) * HOP + WINDOW)
        y[max(0, total - at * HOP) :] = 0
        y = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * _HANN
        power = np.abs(np.fft.rfft(y, FFT)) ** 2
        mels.append(np.log(power @ _MEL + 1e-8).astype(np.float32))
        energy.append(10 * np.log10((y * y).mean(1) + 1e-10))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame spans: a span begins where energy reaches the upper threshold and lasts until it falls below the lower one."""
    peak = energy.max()
    mark = np.where(energy >= peak - ON_DB, 1, np.where(energy < peak - OFF_DB, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _seconds(first: int, end: int) -> tuple[float, float]:
    return first * HOP / TARGET, ((end - 1) * HOP + WINDOW) / TARGET


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [BLOCK, MELS])


def tensor_stream(mels: np.ndarray) -> bytes:
    """Arrow stream of logmel (tensors [BLOCK, MELS], the last one padded with zeros), frames, start_s, end_s."""
    blocks = -(-len(mels) // BLOCK)
    flat = np.zeros((blocks * BLOCK, MELS), np.float32)
    flat[: len(mels)] = mels
    spans = [_seconds(b * BLOCK, min(len(mels), (b + 1) * BLOCK)) for b in range(blocks)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), BLOCK * MELS)),
            pa.array([min(BLOCK, len(mels) - b * BLOCK) for b in range(blocks)], pa.int32()),
            pa.array([s for s, _ in spans], pa.float64()),
            pa.array([e for _, e in spans], pa.float64()),
        ],
        names=["logmel", "frames", "start_s", "end_s"],
    )
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames without padding, [start_s, end_s] of each tensor) of a stream that tensor_stream made."""
    with pa.ipc.open_stream(stream) as r:
        batch = r.read_next_batch()
    storage = batch.column("logmel").storage
    mels = storage.flatten().to_numpy().reshape(-1, MELS)
    return mels[: sum(batch.column("frames").to_pylist())], np.stack([batch.column(n).to_numpy() for n in ("start_s", "end_s")], 1)


_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def audio_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (a WAV file), tensors (an Arrow stream), spans (start_s, end_s of energy segments).

    The payload is the text in UTF-8 with spaces appended to a positive multiple of 192 bytes.
    A null text is empty (192 spaces); null ids stay null; repeated rows give equal results; an
    empty table gives an empty result; other columns of docs, whatever their names, are not read. A map
    without a shuffle. A signal of any length is resampled and transformed in blocks of CHUNK_FRAMES
    frames; what grows with it is its row: the file and 40 numbers of 4 bytes for each 240 bytes of text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    return rows.transform(in_arrow, _features, "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start_s double, end_s double>>")


def _features(batches):
    for part in slices(batches, 1, BATCH_BYTES):
        sizes, media, tensors, spans = [], [], [], []
        for text in part.column(1).to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            media.append(encode_wav(data + PAD_BYTE * (-len(data) % PAD_TO if data else PAD_TO)))
            mels, energy = log_mel(decode_wav(media[-1])[1])
            tensors.append(tensor_stream(mels))
            spans.append([dict(zip(("start_s", "end_s"), _seconds(*s))) for s in segments(energy)])
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tensors, pa.binary()), pa.array(spans, _SPANS)],
            names=["doc_id", "n_bytes", "media", "tensors", "spans"],
        )


def media_digest(features: DataFrame) -> DataFrame:
    """Reads the stored bytes back: payload and media digests, and a short string of the features."""
    return features.transform(in_arrow, _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _digest(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for i, n, media, tensors, spans in zip(*(c.to_pylist() for c in batch.columns)):
            payload = decode_wav(media)[1]
            mels, _ = read_tensors(tensors)
            bands = np.rint(mels.mean(0, dtype=np.float64).reshape(8, -1).mean(1) * 4).astype(int).tolist()
            voiced = sum(round(1000 * (s["end_s"] - s["start_s"])) for s in spans)
            feature = f"frames={len(mels)};segments={len(spans)};voiced_ms={voiced};bands={','.join(map(str, bands))}"
            out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

"""Media columns: texts' bytes stored as 8-bit PCM audio, read back, and described.

A payload is a mono WAV file of unsigned 8-bit samples. Features come from the stored file: integer
polyphase resampling, overlapped log-mel filterbanks in tensors of a fixed shape, and speech-like
segments by hysteresis on frame energy, all with time spans. Frames are always computed in blocks of
one shape, so equal payloads give equal features wherever they lie.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

UNIT = 576
PAD = 255
RATE = 16000
UP, DOWN = 1, 2  # 16 kHz to 8 kHz
TAPS = 24  # of the prototype filter for each phase
FRAME, HOP, FFT = 200, 80, 256  # 25 ms every 10 ms at 8 kHz
MELS = 40
SHAPE = (32, MELS)  # frames in a tensor
OPEN, CLOSE = 0.6, 0.4  # of the range of a file's frame energies
SLICE = 128
SLICE_BYTES = 1 << 20


def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass as integers (sum 2^14 a phase), one row for each phase."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    phases = h.reshape(taps, up).T
    return np.round(phases / phases.sum(1, keepdims=True) * (1 << 14)).astype(np.int64)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Rational resampling of integers: only samples that are kept are computed, each from one phase; exact in integers."""
    phases = polyphase(up, down)
    taps = phases.shape[1]
    padded = np.r_[np.zeros(taps // 2, np.int32), x.astype(np.int32), np.zeros(taps, np.int32)]
    n_out = len(x) * up // down
    out = np.empty(n_out, np.int32)
    for p in range(min(up, n_out)):  # outputs p, p + up, ... share a phase and lie `down` samples apart
        k = len(range(p, n_out, up))
        first, phase = divmod(p * down, up)
        total = np.zeros(k, np.int32)
        for j in range(taps):
            weight = int(phases[phase, taps - 1 - j])
            if weight:
                total += padded[first + j : first + j + (k - 1) * down + 1 : down] * np.int32(weight)
        out[p::up] = total
    return out


def mel_bank(rate: int = RATE * UP // DOWN, mels: int = MELS, fft: int = FFT) -> np.ndarray:
    """Triangular filters, (fft / 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1)[:, None] * rate / fft
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


BANK = mel_bank()
HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of 576."""
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)


def features(payloads: list[bytes]) -> tuple[list[np.ndarray], list[list[tuple[float, float]]]]:
    """Log-mel frames (n, 40) as float16, in dB, and segments (start, end) in seconds, of each payload."""
    gap = 2 * TAPS * DOWN
    size = np.array([len(p) for p in payloads])
    start = np.cumsum(size + gap) - (size + gap)
    line = np.full(int((size + gap).sum()), 128, np.uint8)
    for s, p in zip(start, payloads):
        line[s : s + len(p)] = np.frombuffer(p, np.uint8)
    sound = resample(line.astype(np.int32) - 128)
    start, size = start * UP // DOWN, size * UP // DOWN
    count = 1 + np.maximum(0, size - FRAME) // HOP
    blocks = -(-count // SHAPE[0])
    doc = np.repeat(np.arange(len(size)), blocks * SHAPE[0])
    first = np.cumsum(blocks * SHAPE[0]) - blocks * SHAPE[0]
    number = np.arange(len(doc)) - first[doc]
    real = number < count[doc]
    at = np.where(real, start[doc] + number * HOP, 0)
    mel, energy = np.empty((len(doc), MELS), np.float16), np.zeros(len(doc), np.int64)
    for k in range(0, len(doc), SHAPE[0] * 32):
        rows = at[k : k + SHAPE[0] * 32]
        frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[rows]
        scaled = frames >> 10  # so that a frame's sum of squares fits 32 bits
        energy[k : k + len(rows)] = np.einsum("ij,ij->i", scaled, scaled)
        spectrum = np.fft.rfft(frames.astype(np.float32) * (HANN / np.float32(1 << 21)), FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32).reshape(-1, SHAPE[0], FFT // 2 + 1)
        bands = np.stack([block @ BANK for block in power]).reshape(-1, MELS)
        mel[k : k + len(rows)] = 10 * np.log10(np.maximum(bands, 1e-8))
    mel[~real] = -80
    out, segments = [], []
    for f, n, b in zip(first, count, blocks):
        out.append(mel[f : f + b * SHAPE[0]])
        e = energy[f : f + n]
        low, span = int(e.min()), int(e.max() - e.min())
        mark = np.where(e >= low + OPEN * span, 1, np.where(e < low + CLOSE * span, -1, 0))
        mark[0] = mark[0] or -1
        state = mark[np.maximum.accumulate(np.where(mark != 0, np.arange(n), 0))] > 0 if span else np.zeros(n, bool)
        edge = np.flatnonzero(np.diff(np.r_[False, state, False].astype(np.int8)))
        hop, frame = HOP * DOWN / UP / RATE, FRAME * DOWN / UP / RATE
        segments.append([(float(a * hop), float((z - 1) * hop + frame)) for a, z in zip(edge[::2], edge[1::2])])
    return out, segments


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: fixed-shape tensors of 32 frames with the time span of each."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(mel.ravel()), SHAPE[0] * SHAPE[1])
    kind = pa.fixed_shape_tensor(pa.float16(), SHAPE)
    hop = HOP * DOWN / UP / RATE
    at = np.arange(len(storage)) * SHAPE[0] * hop
    batch = pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(kind, storage), pa.array(at), pa.array(at + ((SHAPE[0] - 1) * HOP + FRAME) * DOWN / UP / RATE)], ["log_mel", "start_s", "end_s"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): texts as WAV files, written to the shared folder and read back.

    Null and empty texts are one unit of padding. Repeated rows are stored each; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "data", SLICE, SLICE_BYTES):
            raw = [x.as_py() for x in piece["data"]]
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array([encode_wav(padded(x)) for x in raw], pa.binary())})

    return C.write_scratch(C.data_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def describe_audio(media: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Adds, from the stored files: payload (binary, as read back), log_mel (Arrow stream of tensors), n_frames, segments, feature.

    feature sums up: frames, segments, seconds in segments, mean level and a checksum of the tensors.
    """
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "media", SLICE, SLICE_BYTES):
            files = [x.as_py() for x in piece["media"]]
            payloads = [decode_wav(x) for x in files]
            mel, segments = features(payloads)
            named = []
            for m, s, p in zip(mel, segments, payloads):
                n = 1 + max(0, len(p) * UP // DOWN - FRAME) // HOP
                level = float(m[:n].astype(np.float64).mean())
                named.append(f"frames={n};segments={len(s)};active={sum(b - a for a, b in s):.3f};level={level:.2f};crc={zlib.crc32(m.tobytes()):08x}")
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece["doc_id"], "n_bytes": piece["n_bytes"], "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads], "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array([len(x) for x in files], pa.int64()), "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
                "log_mel": pa.array([tensors(m) if with_tensors else None for m in mel], pa.binary()), "segments": pa.array([[{"start_s": a, "end_s": b} for a, b in s] for s in segments], kind), "feature": named,
            })

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, log_mel binary, segments array<struct<start_s:double,end_s:double>>, feature string",
    )


def store_features(media: DataFrame) -> DataFrame:
    """describe_audio() of stored files as a table in the shared folder: tensors and time spans are its columns log_mel and segments.

    Read tensors back by read_tensors(). A null doc_id stays null; repeated rows are described each; a
    file of any length is described whole, in a batch of its own. No rows: no rows.
    """
    return C.write_scratch(describe_audio(media), "features")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_features(store_audio(C.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

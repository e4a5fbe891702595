"""Audio features of media columns.

Bytes are stored as 8-bit mono WAV and read back.  The samples go through a polyphase resampler, overlapped
Hann frames, a log-mel filterbank and an energy segmentation with hysteresis.  The features of a clip are
patches of one fixed shape (frames x mel bands, the last one padded with the floor) with their time spans, as
Arrow fixed-shape tensors; `tensor_table` gives the typed Arrow table.

A clip is worked on in blocks of whole patches, resampling included: a first pass finds the frames' energies and from them
the segments, a second one makes the patches.  Besides the clip's bytes (as text, payload and file) only a block and an
energy per frame are held.

Cases: null text counts as empty; an empty clip is one block of padding; equal clips give equal values, since
each is computed alone; repeated rows give repeated rows; an empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192  # a payload is a positive multiple of this many bytes
FILL = 32
FLOOR = 1e-6


@dataclass(frozen=True)
class Audio:
    """Parameters: rates in Hz, lengths in samples at the target rate, thresholds in dB over the floor."""

    source_rate: int = 12_000
    target_rate: int = 8_000
    taps: int = 12
    frame: int = 256
    hop: int = 128
    bands: int = 24
    patch: int = 64
    enter_db: float = 3.0
    leave_db: float = 1.5
    #: Patches that are computed at once.
    block_patches: int = 16


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def wav_bytes(samples: bytes, rate: int) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """(samples, rate) of such a file, found by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE data")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono samples are expected")
        elif name == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases(up: int, taps: int, cutoff: float) -> np.ndarray:
    """The windowed-sinc low-pass, one row of `taps` coefficients per phase, each of unit sum."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / up * cutoff) * np.hamming(n)
    rows = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled(x: np.ndarray, first: int, count: int, up: int, down: int, taps: int) -> np.ndarray:
    """Samples first .. first + count of `x` at up/down times its rate: each needs one phase of the filter at one input
    place.  Before its beginning and after its end `x` holds its edge samples."""
    begin = first - first % up
    lead = begin // up * down - taps // 2
    places = np.arange(lead, lead + ((count + first - begin) // up + 2) * down + 2 * taps)
    near = x[np.clip(places, 0, len(x) - 1)].astype(np.float32)
    if x.dtype == np.uint8:
        near = (near - 128) / 128
    if up == down:
        return near[taps // 2 : taps // 2 + count]
    rows = _phases(up, taps, min(1.0, up / down))
    windows = np.lib.stride_tricks.sliding_window_view(near, taps)
    out = np.empty(count + first - begin, np.float32)
    for k in range(up):  # outputs k, k + up, ... share a phase
        n = len(range(k, len(out), up))
        at, phase = divmod(k * down, up)
        out[k::up] = windows[at :: down][:n] @ rows[phase]
    return out[first - begin :]


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """The whole of `x` at up/down times its rate."""
    return resampled(x, 0, -(-len(x) * up // down), up, down, taps)


@cache
def _mel(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangular filters, equally wide in mel, as a (bins x bands) matrix."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def _frames(samples: np.ndarray, rate: int, p: Audio) -> Iterator[np.ndarray]:
    """Blocks of overlapped, windowed frames at the target rate, without constant offset; a short clip has one frame."""
    g = int(np.gcd(rate, p.target_rate))
    up, down = p.target_rate // g, rate // g
    length = -(-len(samples) * up // down)
    total = 1 + max(0, length - p.frame) // p.hop
    window = np.hanning(p.frame).astype(np.float32)
    block = p.block_patches * p.patch
    for at in range(0, total, block):
        n = min(block, total - at)
        want = (n - 1) * p.hop + p.frame
        y = resampled(samples, at * p.hop, min(want, length - at * p.hop), up, down, p.taps)
        if len(y) < want:
            y = np.concatenate((y, np.zeros(want - len(y), np.float32)))
        part = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop]
        yield (part - part.mean(axis=1, keepdims=True)) * window


def _energy(frames: np.ndarray) -> np.ndarray:
    return (10 * np.log10(np.maximum((frames * frames).mean(axis=1), 1e-9))).astype(np.float32)


def _log_mel(frames: np.ndarray, p: Audio) -> np.ndarray:
    spectrum = np.fft.rfft(frames, axis=1)
    return np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel(p.target_rate, p.frame, p.bands), FLOOR))


def segments(energy: np.ndarray, enter_db: float, leave_db: float) -> list[tuple[int, int]]:
    """Runs of frames above the lower threshold that reach the upper one; both lie over the clip's tenth
    percentile.  End exclusive."""
    floor = np.percentile(energy, 10)
    on = np.concatenate(([False], energy >= floor + leave_db, [False]))
    edges = np.flatnonzero(on[1:] != on[:-1])
    high = np.concatenate(([0], np.cumsum(energy >= floor + enter_db)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if high[b] > high[a]]


@dataclass
class Patches:
    """Patches first, first + 1, ... of a clip: their times in seconds, shares of frames in segments, and tensors."""

    first: int
    starts: np.ndarray
    ends: np.ndarray
    voiced: np.ndarray
    tensors: np.ndarray


@dataclass
class Clip:
    """A clip's frames and segments (frame numbers, end exclusive), and its patches, made block by block as they are read."""

    frames: int
    spans: list[tuple[int, int]]
    patches: Iterator[Patches]

    def seconds(self, p: Audio) -> list[tuple[float, float]]:
        """The segments as time spans."""
        return [(a * p.hop / p.target_rate, ((b - 1) * p.hop + p.frame) / p.target_rate) for a, b in self.spans]


def clip_features(samples: bytes, rate: int, p: Audio) -> Clip:
    x = np.frombuffer(samples, np.uint8)
    energy = np.concatenate([_energy(f) for f in _frames(x, rate, p)])
    spans, total = segments(energy, p.enter_db, p.leave_db), len(energy)
    del energy

    def patches() -> Iterator[Patches]:
        on = np.zeros(-(-total // p.patch) * p.patch, bool)
        for a, b in spans:
            on[a:b] = True
        first = 0
        for frames in _frames(x, rate, p):
            n = -(-len(frames) // p.patch)
            full = np.full((n * p.patch, p.bands), np.log(FLOOR), np.float32)
            full[: len(frames)] = _log_mel(frames, p)
            number = np.arange(first, first + n)
            starts = number * p.patch * p.hop / p.target_rate
            ends = (np.minimum((number + 1) * p.patch, total) - 1) * p.hop + p.frame
            yield Patches(first, starts, ends / p.target_rate, on[first * p.patch : (first + n) * p.patch].reshape(n, -1).mean(axis=1), full.reshape(n, p.patch, p.bands))
            first += n

    return Clip(total, spans, patches())


def summary(clip: Clip, p: Audio) -> str:
    """frames | patches | segments | voiced frames | SHA-256 of the segments' time spans (little-endian doubles) | SHA-256 of
    the patches: time span, share of voiced frames and tensor (little-endian) one after the other | mean log-mel per band over
    all patches, to one decimal."""
    tensors, count, sums = hashlib.sha256(), 0, np.zeros(p.bands)
    for x in clip.patches:
        for row in zip(x.starts, x.ends, x.voiced, x.tensors):
            tensors.update(np.array(row[:3], "<f8").tobytes() + row[3].astype("<f4").tobytes())
        count += len(x.starts)
        sums += x.tensors.sum(axis=(0, 1), dtype=np.float64)
    spans = hashlib.sha256(np.array(clip.seconds(p), "<f8").tobytes()).hexdigest()
    means = ",".join(f"{m + 0.0:.1f}" for m in np.round(sums / (count * p.patch), 1))
    return f"{clip.frames}|{count}|{len(clip.spans)}|{sum(b - a for a, b in clip.spans)}|{spans}|{tensors.hexdigest()}|{means}"


def audio_patches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Audio = Audio()) -> DataFrame:
    """One row per patch: id, patch, start_s, end_s, voiced (share of frames in segments) and tensor, a flat
    array of patch x bands floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                samples, rate = wav_samples(wav_bytes(payload(batch.column(1)[row].as_py())[0], p.source_rate))
                for x in clip_features(samples, rate, p).patches:
                    n = len(x.starts)
                    tensors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.patch * p.bands, pa.int32()), pa.array(x.tensors.ravel()))
                    ids = batch.column(0).take(pa.array(np.full(n, row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(x.first + np.arange(n), pa.int64()), pa.array(x.starts), pa.array(x.ends), pa.array(x.voiced), tensors], names)

    names = [id_col, "patch", "start_s", "end_s", "voiced", "tensor"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, patch long, start_s double, end_s double, voiced double, tensor array<float>")


def tensor_table(table: pa.Table, p: Audio = Audio()) -> pa.Table:
    """An Arrow table of patches with the tensor column typed as fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (p.patch, p.bands), dim_names=("frame", "band"))
    flat = table["tensor"].combine_chunks().flatten().cast(pa.float32())
    storage = pa.FixedSizeListArray.from_arrays(flat, p.patch * p.bands)
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, storage))


def audio_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Audio = Audio()) -> DataFrame:
    """Per document the stored form's digests and the summary of its segments and patches, which holds their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data, n = payload(text.as_py())
                media = wav_bytes(data, p.source_rate)
                back, rate = wav_samples(media)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), summary(clip_features(back, rate, p), p)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

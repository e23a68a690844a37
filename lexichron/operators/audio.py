"""Landed audio to speech spans and samples. Codecs are functions the caller may replace; the defaults read and write WAV,
which the standard library knows. All else takes 16 kHz mono 16-bit samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 16_000
FRAME = RATE // 50
MIN_SILENCE_MS, PAD_MS, MAX_MS = 500, 200, 600_000


def wav_samples(content: bytes) -> np.ndarray:
    """16 kHz mono samples of a 16-bit WAV file: channels are averaged, other rates resampled linearly."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("16-bit samples are required")
        raw, channels, rate = np.frombuffer(f.readframes(f.getnframes()), "<i2"), f.getnchannels(), f.getframerate()
    mono = raw.reshape(-1, channels).mean(1)
    if rate != RATE and len(mono):
        at = np.arange(int(len(mono) * RATE / rate)) * rate / RATE
        mono = np.interp(at, np.arange(len(mono)), mono)
    return np.round(mono).astype("<i2")


def wav_bytes(samples: bytes) -> bytes:
    """A WAV file of 16 kHz mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def _coded(df: DataFrame, column: str, code: Callable[[bytes], bytes]) -> DataFrame:
    """df with a binary column passed through a codec, row by row; null stays null, and an error fails the job."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time in memory
                row = batch.slice(i, 1)
                value = row.column(at)[0].as_py()
                made = pa.array([None if value is None else code(value)], pa.binary())
                yield pa.RecordBatch.from_arrays([made if k == at else row.column(k) for k in range(row.num_columns)], names=row.schema.names)

    return df.mapInArrow(run, df.schema)


def load_audio(files: DataFrame, decode: Callable[[bytes], np.ndarray] = wav_samples) -> DataFrame:
    """files(…, audio) with the content of each file decoded to 16 kHz mono 16-bit samples."""
    return _coded(files, "audio", lambda content: decode(content).astype("<i2").tobytes())


def encode_audio(chunks: DataFrame, encode: Callable[[bytes], bytes] = wav_bytes) -> DataFrame:
    """chunks(…, audio) with the samples of each chunk encoded for a recogniser."""
    return _coded(chunks, "audio", encode)


#: Seconds to either side that the noise floor and the loudness of speech are taken from; decibels that count as silence.
AROUND_S, SILENT_DB = 10, -60.0
#: Decibels over the floor that speech has at least, and its place between floor and loudness.
OVER_DB, BETWEEN = 6.0, 0.3
#: Decibels of a unit of log odds, their bound, and the cost of a change between speech and pause.
ODDS_DB, MOST_ODDS, CHANGE = 4.0, 3.0, 4.0


def frame_odds(samples: np.ndarray) -> np.ndarray:
    """Log odds that each frame of 20 ms is speech, by its loudness against what is around it.

    The noise floor is the least of the low tenths of the seconds around, so that it follows a room that gets louder; the
    loudness of speech is the greatest of their high tenths.
    """
    n = len(samples) // FRAME
    power = (samples[: n * FRAME].reshape(n, FRAME).astype(float) ** 2).mean(1) / 32_768**2
    db = np.maximum(SILENT_DB, 10 * np.log10(power + 1e-12))
    second = RATE // FRAME
    blocks = np.pad(db, (0, -n % second), mode="edge").reshape(-1, second)
    low, high = np.percentile(blocks, 10, axis=1), np.percentile(blocks, 90, axis=1)
    around = lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, AROUND_S, mode="edge"), 2 * AROUND_S + 1)
    floor, loud = around(low).min(1), around(high).max(1)
    edge = np.repeat(floor + np.maximum(OVER_DB, BETWEEN * (loud - floor)), second)[:n]
    return np.clip((db - edge) / ODDS_DB, -MOST_ODDS, MOST_ODDS)


def smoothed(odds: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """Whether each frame is speech on the likeliest path through two states that costs `change` for each step between them."""
    off, on, came_off, came_on = 0.0, 0.0, [], []
    for o in odds.tolist():
        stay_off, stay_on = off >= on - change, on >= off - change
        off, on = (off if stay_off else on - change), (on if stay_on else off - change) + o
        came_off.append(stay_off)
        came_on.append(stay_on)
    out, speech = np.zeros(len(odds), bool), on > off
    for i in range(len(odds) - 1, -1, -1):
        out[i] = speech
        speech = came_on[i] if speech else not came_off[i]
    return out


def speech_spans(samples: np.ndarray) -> list[tuple[int, int]]:
    """(start_ms, end_ms) of speech: pauses under MIN_SILENCE_MS are bridged, ends are padded by PAD_MS."""
    if len(samples) < FRAME:
        return []
    loud = np.flatnonzero(smoothed(frame_odds(samples)))
    if not len(loud):
        return []
    cut = np.flatnonzero(np.diff(loud) > MIN_SILENCE_MS // 20)
    first, last = loud[np.r_[0, cut + 1]], loud[np.r_[cut, len(loud) - 1]]
    total = len(samples) * 1000 // RATE
    spans: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        s, e = max(0, a * 20 - PAD_MS), min(total, (b + 1) * 20 + PAD_MS)
        if spans and s <= spans[-1][1]:
            s = spans.pop()[0]
        spans.append((s, e))
    return spans


def find_speech(recordings: DataFrame) -> DataFrame:
    """episode_id, start_ms, end_ms of recordings(episode_id, audio); row-wise, by loudness over an adaptive noise floor
    and a two-state path; another detector is a function over the same frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one recording at a time in memory
                audio = batch.column(1)[i].as_py()
                spans = speech_spans(np.frombuffer(audio[: len(audio) // 2 * 2], "<i2")) if audio else []
                ids = pa.array([batch.column(0)[i].as_py()] * len(spans), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], names=["episode_id", "start_ms", "end_ms"])

    kind = recordings.schema["episode_id"].dataType.simpleString()
    return recordings.select("episode_id", "audio").mapInArrow(run, f"episode_id {kind}, start_ms bigint, end_ms bigint")


def cut_samples(audio: Column, start_ms: Column, end_ms: Column) -> Column:
    """The samples of [start, end), as bytes."""
    at = F.floor(start_ms * RATE / 1000).cast("int")
    return F.substring(audio, at * 2 + 1, (F.floor(end_ms * RATE / 1000).cast("int") - at) * 2)


def duration_seconds(audio: Column) -> Column:
    return F.round(F.octet_length(audio) / 2 / RATE).cast("int")

"""Audio files: discovery, probing, decoding and writing.

WAV is read with the standard library; other formats go to ffprobe and ffmpeg
where those are installed, and are failures (as data) where not.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import subprocess
import tempfile
import uuid
import wave
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Ingestion
from tessera.functions import kernels

#: Amplitude that is still silence.
SILENCE = 1e-4


class SourceError(Exception):
    def __init__(self, reason: str, detail: str = ""):
        super().__init__(detail)
        self.reason, self.detail = reason, detail


def matches(path: Column, extensions: tuple[str, ...] = Ingestion().extensions) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*extensions)


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = Ingestion().extensions) -> DataFrame:
    """audio_path (relative) and path of every file by extension, hidden names left out, empty files and _names included.

    A listing on the driver: the built-in binary reader skips empty files and
    names that start with an underscore, which must be seen to be failed.
    """
    base = Path(root).expanduser().resolve()
    if not base.is_dir():
        raise NotADirectoryError(f"audio library directory not found: {base}")
    found = sorted(p for p in base.rglob("*") if p.is_file() and not p.name.startswith(".") and p.suffix.lower() in extensions)
    return spark.createDataFrame([(p.relative_to(base).as_posix(), str(p)) for p in found], "audio_path string, path string")


def stored(spark: SparkSession, root: str, extensions: tuple[str, ...] = Ingestion().extensions) -> DataFrame:
    """audio_path, content, content_hash from any store that Spark reads (that reader's own rules on names hold)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split("://")[-1] + "/")
    rel = F.element_at(F.split("path", F.concat(F.lit("\\Q"), base, F.lit("\\E")), 2), -1)
    return files.where(matches(F.col("path"), extensions)).select(rel.alias("audio_path"), "content", F.sha2("content", 256).alias("content_hash"))


def _with_file(data: bytes, use: Callable[[str], bytes]) -> bytes:
    """``use`` of a temporary file of the task with the bytes: a pipe can't be sought in, as some containers need."""
    with tempfile.NamedTemporaryFile(prefix="tessera-") as f:
        f.write(data)
        f.flush()
        return use(f.name)


def _tool(*command: str, timeout: float) -> bytes:
    try:
        done = subprocess.run(command, stdin=subprocess.DEVNULL, capture_output=True, timeout=timeout)
    except FileNotFoundError:
        raise SourceError("TOOL_MISSING", command[0]) from None
    except subprocess.TimeoutExpired:
        raise SourceError("TIMEOUT", command[0]) from None
    if done.returncode:
        tail = " ".join(done.stderr.decode(errors="replace").split())[-400:]
        raise SourceError("PROBE_FAILED" if command[0] == "ffprobe" else "DECODE_FAILED", tail)
    return done.stdout


def _number(x, kind=float):
    """The number that a tool wrote, or nothing where it wrote none."""
    try:
        found = kind(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return found if np.isfinite(found) and found > 0 else None


def described(output: bytes) -> dict:
    """The facts in ffprobe's JSON."""
    try:
        out = json.loads(output)
    except ValueError as e:
        raise SourceError("UNREADABLE_PROBE_OUTPUT", str(e)) from None
    streams, form = (out.get("streams") or [], out.get("format") or {}) if isinstance(out, dict) else (None, None)
    if not isinstance(streams, list) or not isinstance(form, dict):
        raise SourceError("UNREADABLE_PROBE_OUTPUT", "not the expected JSON")
    stream = next((s for s in streams if isinstance(s, dict) and s.get("codec_type") == "audio"), None)
    if stream is None:
        raise SourceError("NO_AUDIO_STREAM")
    tags = {k.strip().lower(): str(v) for t in (stream.get("tags") or {}, form.get("tags") or {}) for k, v in t.items()}
    duration = _number(stream.get("duration")) or _number(form.get("duration"))
    rate, channels = _number(stream.get("sample_rate"), int), _number(stream.get("channels"), int)
    if duration is None:
        raise SourceError("INVALID_DURATION", f"{stream.get('duration')}, {form.get('duration')}")
    if rate is None or channels is None:
        raise SourceError("INVALID_SAMPLE_FORMAT", f"{stream.get('sample_rate')} Hz, {stream.get('channels')} channels")
    return {"duration": duration, "sample_rate": rate, "channels": channels, "codec": stream.get("codec_name"), "bit_rate": _number(form.get("bit_rate"), int), "tags": tags}


def probe(data: bytes, timeout: float = 120.0) -> dict:
    """duration, sample_rate, channels, codec, bit_rate, tags of the first audio stream."""
    if (plain := float_wav(data)) is not None:
        x, rate = plain
        found = {"duration": len(x) / rate if rate else 0.0, "sample_rate": rate, "channels": x.shape[1], "codec": f"pcm_f{8 * x.dtype.itemsize}le", "bit_rate": rate * x.shape[1] * x.dtype.itemsize * 8, "tags": {}}
    elif data[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(data)) as w:
                rate, n, c, width = w.getframerate(), w.getnframes(), w.getnchannels(), w.getsampwidth()
        except (wave.Error, EOFError) as e:
            raise SourceError("PROBE_FAILED", str(e)) from None
        found = {"duration": n / rate if rate else 0.0, "sample_rate": rate, "channels": c, "codec": f"pcm_s{8 * width}le", "bit_rate": rate * c * width * 8, "tags": {}}
    else:
        found = described(_with_file(data, lambda path: _tool("ffprobe", "-v", "error", "-of", "json", "-show_format", "-show_streams", path, timeout=timeout)))
    if not np.isfinite(found["duration"]) or found["duration"] <= 0:
        raise SourceError("INVALID_DURATION")
    if found["sample_rate"] <= 0 or found["channels"] <= 0:
        raise SourceError("INVALID_SAMPLE_FORMAT")
    return found


def float_wav(data: bytes) -> tuple[np.ndarray, int] | None:
    """(frames, channels) and rate of a WAV file of floating-point samples, which the standard library doesn't read; None for any other file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16:
            form = np.frombuffer(data, "<u2", 8, at + 8).tolist() if at + 24 <= len(data) else None
            if form is None or form[0] != 3 or form[7] not in (32, 64) or not form[1]:  # 3: floating point
                return None
        if name == b"data" and form is not None:
            width, rate = form[7] // 8, form[2] | form[3] << 16
            raw = data[at + 8 : at + 8 + size]
            raw = raw[: len(raw) - len(raw) % (width * form[1])]
            return np.frombuffer(raw, f"<f{width}").reshape(-1, form[1]), rate
        at += 8 + size + size % 2
    return None


def decode(data: bytes, rate: int, channels: int = 1, seconds: float | None = None, timeout: float = 120.0) -> np.ndarray:
    """float32 (n, channels) at ``rate``, the first ``seconds`` if given."""
    if (plain := float_wav(data)) is not None:
        x, own = plain
        x = (x if seconds is None else x[: int(seconds * own)]).astype(np.float32)
        x = kernels.resampled(x.mean(1, keepdims=True) if channels == 1 else kernels.channels(x, channels), own, rate)
    elif data[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(data)) as w:
                own, c, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                raw = w.readframes(w.getnframes() if seconds is None else int(seconds * own))
        except (wave.Error, EOFError) as e:
            raise SourceError("DECODE_FAILED", str(e)) from None
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
        else:
            x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
        x = x.reshape(-1, c).astype(np.float32)
        x = x.mean(1, keepdims=True) if channels == 1 else kernels.channels(x, channels)
        x = kernels.resampled(x, own, rate)
    else:
        limit = () if seconds is None else ("-t", str(seconds))
        raw = _with_file(data, lambda path: _tool("ffmpeg", "-v", "error", "-i", path, *limit, "-f", "f32le", "-ac", str(channels), "-ar", str(rate), "-", timeout=timeout))
        if len(raw) % (4 * channels):
            raise SourceError("DECODE_FAILED", "odd number of samples")
        x = np.frombuffer(raw, "<f4").reshape(-1, channels)
    if not len(x):
        raise SourceError("EMPTY_AUDIO")
    if not np.isfinite(x).all():
        raise SourceError("NON_FINITE_SAMPLES")
    return x


def validated(data: bytes, rules: Ingestion, rate: int = 22050) -> dict:
    """The probe of a usable source.  Only a file that starts silent is decoded further before it is called silent."""
    if not data:
        raise SourceError("EMPTY_FILE")
    found = probe(data, rules.timeout_seconds)
    if found["duration"] < rules.min_duration_seconds:
        raise SourceError("TOO_SHORT", f"{found['duration']:.2f}s is below the {rules.min_duration_seconds:g}s minimum")
    if np.abs(decode(data, rate, 1, rules.validation_seconds, rules.timeout_seconds)).max() <= SILENCE:
        peak = np.abs(decode(data, rate, 1, min(rules.silence_scan_seconds, found["duration"]), rules.timeout_seconds)).max()
        if peak <= SILENCE:
            raise SourceError("SILENT_AUDIO", f"peak amplitude {peak:.2e} is inaudible")
    return found


def hashed(files: DataFrame, read_paths: bool = False) -> DataFrame:
    """``files`` with content_hash, from the bytes alone: nothing is probed."""
    if not read_paths:
        return files.withColumn("content_hash", F.sha2(F.coalesce("content", F.expr("cast('' as binary)")), 256))

    def run(batches):
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                with open(path, "rb") as f:
                    digests.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("audio_path"), batch.column("path"), pa.array(digests, pa.string())], ["audio_path", "path", "content_hash"])

    return files.select("audio_path", "path").mapInArrow(run, "audio_path string, path string, content_hash string")


PROBED = "audio_path string, content_hash string, duration_seconds double, native_sample_rate int, channels int, codec_name string, bit_rate bigint, tags map<string,string>, failure_reason string, failure_detail string"


def probe_files(files: DataFrame, rules: Ingestion = Ingestion(), read_paths: bool = False) -> DataFrame:
    """One row for each file: its facts, or a failure; ``files`` holds audio_path and content, or path if the folder is on every executor."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = Path(r["path"]).read_bytes() if read_paths else r["content"] or b""
                row = dict.fromkeys(("duration_seconds", "native_sample_rate", "channels", "codec_name", "bit_rate", "failure_reason", "failure_detail"))
                row |= {"audio_path": r["audio_path"], "content_hash": hashlib.sha256(data).hexdigest(), "tags": []}
                try:
                    p = validated(data, rules)
                    row |= {"duration_seconds": p["duration"], "native_sample_rate": p["sample_rate"], "channels": p["channels"], "codec_name": p["codec"], "bit_rate": p["bit_rate"], "tags": list(p["tags"].items())}
                except SourceError as e:
                    row |= {"failure_reason": e.reason, "failure_detail": e.detail}
                rows.append(row)
            kinds = {"audio_path": pa.string(), "content_hash": pa.string(), "duration_seconds": pa.float64(), "native_sample_rate": pa.int32(), "channels": pa.int32(), "codec_name": pa.string(), "bit_rate": pa.int64(), "tags": pa.map_(pa.string(), pa.string()), "failure_reason": pa.string(), "failure_detail": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return files.mapInArrow(run, PROBED)


def wav_bytes(audio: np.ndarray, rate: int) -> bytes:
    """16-bit WAV of (n, channels), rounded half to even and clipped."""
    pcm = np.clip(np.round(np.asarray(audio, np.float32) * 32767.0), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(pcm.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def write_new(path: str, data: bytes) -> bool:
    """Whole or not at all, and never over another file: false if the name is taken by other bytes."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    staged = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
    try:
        staged.write_bytes(data)
        os.link(staged, to)
    except FileExistsError:
        return to.read_bytes() == data
    finally:
        staged.unlink(missing_ok=True)
    return True


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all: written beside its place, then moved there."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f".{to.name}.{os.getpid()}.tmp")
    try:
        part.write_bytes(data)
        part.replace(to)
    except Exception:
        part.unlink(missing_ok=True)
        raise


def write_wavs(mixes: DataFrame, folder: str) -> DataFrame:
    """(name, samples: interleaved floats, channels, rate) -> name, path, bytes; ``folder`` is one that executors share."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = wav_bytes(np.array(r["samples"], np.float32).reshape(-1, r["channels"]), r["rate"])
                write_file(f"{folder}/{r['name']}", data)
                out.append((r["name"], f"{folder}/{r['name']}", len(data)))
            names, paths, sizes = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["name", "path", "bytes"])

    return mixes.select("name", "samples", "channels", "rate").mapInArrow(run, "name string, path string, bytes bigint")

"""Binary recordings: header, raw and delta-compressed chunks, event logs; and encoders for tests.

Files come through Spark's ``binaryFile`` source; a chunk has 256 ticks. The decoders run in ``mapInPandas``, one file
after the other, and emit rows chunk by chunk.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.functions.data_format import DataFormat
from evoked.operators.intervals import DELETE, PAUSE

# Fixed values of the format.
RAW_MAGIC, COMPRESSED_MAGIC = 0x17A5, 0x97A5
HEADER_BYTES, CHUNK = 512, 256
DATA_ERROR, REJECTED, POLINV = 0o100, 0o40, 0o20
LOG_RECORD = "<HHHBB"


# Fixed places in the header: channels, ticks in units of 10 microseconds, and the texts that hold names and descriptions.
N_CHANNELS_AT, PERIOD_AT, DELAY_AT = 4, 18, 14
NAMES_AT = ((128, 128), (440, 40), (488, 24))
SUBJECT_AT, EXPERIMENT_AT = (256, 40), (376, 40)
#: Fixed: the letters of 6-bit names, from 1 on; 0 is no letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def decode_names(raw: bytes, n: int) -> list[str]:
    """Channel names: 8 bytes each up to 16 channels, 4 up to 32, else four 6-bit letters in 3 bytes."""
    if n <= 32:
        size = 8 if n <= 16 else 4
        return [raw[i * size : (i + 1) * size].split(b"\0")[0].decode("ascii") for i in range(n)]
    words = [int.from_bytes(raw[3 * i : 3 * i + 3], "big") for i in range(n)]
    return ["".join(LETTERS[k - 1] for s in (18, 12, 6, 0) if 0 < (k := w >> s & 63) <= len(LETTERS)) for w in words]


def encode_names(names: list[str]) -> bytes:
    n = len(names)
    if n <= 32:
        size = 8 if n <= 16 else 4
        out = b"".join(x.encode("ascii").ljust(size, b"\0")[:size] for x in names)
    else:
        out = b""
        for x in names:
            codes = [LETTERS.find(c) + 1 for c in x[:4]]
            codes += [0] * (4 - len(codes))
            out += sum(k << s for k, s in zip(codes, (18, 12, 6, 0), strict=True)).to_bytes(3, "big")
    if decode_names(out, n) != names:
        raise ValueError("channel names cannot be written")
    return out


def read_log(raw: bytes) -> list[tuple]:
    """(code, tick, condition, flag, data_error, rejected, polinv) of each record."""
    out = []
    for code, hi, lo, condition, flag in struct.iter_unpack(LOG_RECORD, raw):
        out.append((code, hi << 16 | lo, condition, flag, bool(flag & DATA_ERROR), bool(flag & REJECTED), bool(flag & POLINV)))
    return out


def make_log(codes) -> bytes:
    """A log of the nonzero codes; the condition grows at pauses and deletions."""
    out, condition = b"", 0
    for tick, code in enumerate(codes):
        if code:
            out += struct.pack(LOG_RECORD, int(code), tick >> 16, tick & 0xFFFF, condition, 0)
            condition += int(code) in (PAUSE, DELETE)
    return out


def sign_extend(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> bits - 1 else value


class Nibbles:
    """Four-bit units of little-endian words, highest first."""

    def __init__(self, words: np.ndarray):
        self.units = np.stack([words >> 12, words >> 8 & 15, words >> 4 & 15, words & 15], 1).ravel().tolist()
        self.at = 0

    def take(self) -> int:
        self.at += 1
        return self.units[self.at - 1]


def next_sample(nibbles: Nibbles, before: int) -> int:
    """One sample: 0xxx is a 3-bit difference, 10xx and a nibble one of 6 bits, 110x and two nibbles one of 9, and 1110 before
    three nibbles a 12-bit value by itself."""
    n = nibbles.take()
    if n < 8:
        return before + sign_extend(n, 3)
    if n < 12:
        return before + sign_extend((n & 3) << 4 | nibbles.take(), 6)
    if n < 14:
        return before + sign_extend((n & 1) << 8 | nibbles.take() << 4 | nibbles.take(), 9)
    if n == 15:
        raise ValueError("no sample begins like this")
    return sign_extend(nibbles.take() << 8 | nibbles.take() << 4 | nibbles.take(), 12)


def decompress(words: np.ndarray, ticks: int, channels: int) -> np.ndarray:
    nibbles, before, out = Nibbles(words), [0] * channels, np.zeros((ticks, channels), np.int16)
    for t in range(ticks):
        for c in range(channels):
            before[c] = next_sample(nibbles, before[c])
            out[t, c] = before[c]
    return out


def compress(samples: np.ndarray) -> bytes:
    units, before = [], [0] * samples.shape[1]
    for row in samples.tolist():
        for c, x in enumerate(row):
            d = x - before[c]
            if -4 <= d < 4:
                units.append(d & 7)
            elif -32 <= d < 32:
                units += [8 | (d & 63) >> 4, d & 15]
            elif -256 <= d < 256:
                units += [12 | (d & 511) >> 8, d >> 4 & 15, d & 15]
            else:
                units += [14, x >> 8 & 15, x >> 4 & 15, x & 15]
            before[c] = x
    units += [0] * (-len(units) % 4)
    return b"".join(struct.pack("<H", units[i] << 12 | units[i + 1] << 8 | units[i + 2] << 4 | units[i + 3]) for i in range(0, len(units), 4))


def parse_header(raw: bytes) -> dict:
    """magic, n_channels, hz, names. The period is in units of 10 microseconds."""
    if len(raw) < HEADER_BYTES:
        raise ValueError("the header is cut off")
    (magic,), (n,), (period,) = (struct.unpack_from("<H", raw, at) for at in (0, N_CHANNELS_AT, PERIOD_AT))
    if magic not in (RAW_MAGIC, COMPRESSED_MAGIC):
        raise ValueError("not a recording of this format")
    hz = 100_000 / period if period else 0.0
    if not period or abs(hz - round(hz)) > 1e-6:
        raise ValueError("the sample rate is no whole number")
    names = decode_names(b"".join(raw[at : at + size] for at, size in NAMES_AT), n)
    subject, experiment = (raw[at : at + size].split(b"\0")[0].decode("latin-1") for at, size in (SUBJECT_AT, EXPERIMENT_AT))
    (delay,) = struct.unpack_from("<h", raw, DELAY_AT)
    return {"compressed": magic == COMPRESSED_MAGIC, "n_channels": n, "hz": float(round(hz)), "names": names, "subject": subject, "experiment": experiment, "odelay": delay}


def write_recording(samples: np.ndarray, codes, names: list[str], hz: int, compressed: bool = False) -> bytes:
    """The bytes of a recording, for tests. Ticks are filled up to whole chunks."""
    head, texts = bytearray(HEADER_BYTES), encode_names(names)
    for at, value in ((0, COMPRESSED_MAGIC if compressed else RAW_MAGIC), (N_CHANNELS_AT, len(names)), (PERIOD_AT, 100_000 // hz)):
        struct.pack_into("<H", head, at, value)
    for at, size in NAMES_AT:
        head[at : at + size], texts = texts[:size].ljust(size, b"\0"), texts[size:]
    out = bytes(head)
    pad = -len(samples) % CHUNK
    samples, codes = np.vstack([samples, np.zeros((pad, samples.shape[1]), samples.dtype)]), np.concatenate([codes, np.zeros(pad, int)]).astype(np.uint16)
    for k in range(len(samples) // CHUNK):
        own, part = codes[k * CHUNK : (k + 1) * CHUNK].copy(), samples[k * CHUNK : (k + 1) * CHUNK].astype(np.int16)
        own[0] = k
        if not compressed:
            out += own.astype("<u2").tobytes() + part.astype("<i2").tobytes()
            continue
        i, runs, n_runs = 0, b"", 0
        while i < CHUNK:
            j = i
            while j < CHUNK and own[j] == own[i]:
                j += 1
            runs += struct.pack("<BH", j - i - 1, own[i])
            n_runs += 1
            i = j
        body = compress(part)
        out += struct.pack("<B", n_runs - 1) + runs + struct.pack("<H", len(body) // 2) + body
    return out


def chunks(raw: bytes):
    """(first tick, codes, samples) of each chunk."""
    head, at, k = parse_header(raw), HEADER_BYTES, 0
    n = head["n_channels"]
    while at < len(raw):
        if head["compressed"]:
            codes, left = [], raw[at] + 1
            at += 1
            while left:
                left -= 1
                count, code = struct.unpack_from("<BH", raw, at)
                codes += [code] * (count + 1)
                at += 3
            (words,) = struct.unpack_from("<H", raw, at)
            samples = decompress(np.frombuffer(raw, "<u2", words, at + 2).astype(np.int64), CHUNK, n)
            at += 2 + 2 * words
        else:
            codes = np.frombuffer(raw, "<u2", CHUNK, at).tolist()
            samples = np.frombuffer(raw, "<i2", CHUNK * n, at + 2 * CHUNK).reshape(CHUNK, n)
            at += 2 * CHUNK * (1 + n)
        if len(codes) != CHUNK or codes[0] != k & 0xFFFF:
            raise ValueError(f"chunk {k} is damaged")
        codes[0] = 0
        yield k * CHUNK, codes, samples
        k += 1


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """path, tick, code, and samples: an array in the order of the header's channels."""

    def decode(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                for first, codes, samples in chunks(raw):
                    yield pd.DataFrame({"path": p, "tick": np.arange(first, first + CHUNK), "code": codes, "samples": list(samples.astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, tick long, code int, samples array<double>")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """path, code, tick, condition, flag, data_error, rejected, polinv."""

    def decode(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in read_log(raw)], columns=["path", "code", "tick", "condition", "flag", "flag_data_error", "flag_rejected", "flag_polinv"])

    kind = "path string, code int, tick long, condition int, flag int, flag_data_error boolean, flag_rejected boolean, flag_polinv boolean"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, kind)


def check_log(codes: DataFrame, log: DataFrame) -> None:
    """The codes of log and track must agree at every tick, but for the sign bit."""
    own = codes.where("code <> 0").select("tick", F.col("code").bitwiseAND(0x7FFF).alias("a"))
    other = log.select("tick", F.col("code").bitwiseAND(0x7FFF).alias("b"))
    if not own.join(other, "tick", "full").where("NOT a <=> b").isEmpty():
        raise ValueError("the log does not fit the recording")


def load(spark: SparkSession, raw_path: str, log_path: str, calibration_events: object = "condition == 0", **calibration):
    """A Dataset of one recording and its log."""
    from evoked.dataset import Dataset
    from evoked.operators.timeline import Timeline, numbered

    head = parse_header(bytes(spark.read.format("binaryFile").load(raw_path).select(F.expr(f"substring(content, 1, {HEADER_BYTES})").alias("h")).first().h))
    rows, log = read_recordings(spark, raw_path), read_logs(spark, log_path)
    check_log(rows, log)
    codes = rows.select("tick", "code").join(log.select("tick", F.col("code").alias("log_code")), "tick", "left").select("tick", F.coalesce("log_code", F.lit(0)).alias("code"))
    # Breaks are few: spans come from the log alone, and ticks are located in them.
    total = codes.agg(F.max("tick") + 1).first()[0]
    breaks = sorted(r.tick + 1 for r in log.where(F.col("code").isin(PAUSE, DELETE)).select("tick").collect())
    edges = [0, *[b for b in breaks if b < total], total]
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "recspan_id long, start long, stop long")
    at = (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("stop"))
    placed = rows.join(F.broadcast(spans), at)
    names = head["names"]
    signal = placed.select("recspan_id", (F.col("tick") - F.col("start")).alias("tick"), *(F.col("samples")[i].alias(n) for i, n in enumerate(names)))
    found = log.join(F.broadcast(spans), at)
    keys = ["code", "condition", "flag", "flag_data_error", "flag_rejected", "flag_polinv"]
    # Ticks of a log differ, so a repeated task numbers them alike.
    found = numbered(found, "event_id", "tick", "code")
    events = found.select("event_id", "recspan_id", (F.col("tick") - F.col("start")).alias("start_tick"), (F.col("tick") - F.col("start") + 1).alias("stop_tick"), *keys)
    deleted = found.where(F.col("code") == DELETE).select("recspan_id", F.lit(True).alias("deleted")).distinct()
    info = spans.select("recspan_id", (F.col("stop") - F.col("start")).alias("ticks")).join(deleted, "recspan_id", "left").withColumn("deleted__present", F.col("deleted").isNotNull())
    t = Timeline.from_columns(events, info, keys, ["deleted"])
    where = F.coalesce(t.predicate(calibration_events)[0], F.lit(False))
    events = events.withColumn("calibration_pulse", where).withColumn("calibration_pulse__present", F.col("calibration_pulse"))
    for k in keys:
        events = events.withColumn(f"{k}__present", ~F.col("calibration_pulse"))
    t = Timeline.from_columns(events, info, [*keys, "calibration_pulse"], ["deleted"])
    ds = Dataset(DataFormat(head["hz"], "RAW", tuple(names)), signal, t)
    return ds.calibrated(**calibration) if calibration.pop("calibrate", False) else ds


__all__ = ["check_log", "chunks", "load", "make_log", "parse_header", "read_log", "read_logs", "read_recordings", "write_recording"]

"""Chroma audio fingerprints and the alignment of recordings.

Sound becomes frames of energy in the twelve pitch classes. Haar-like filters, each a
difference of two rectangle sums over (time, pitch class) that an integral image gives in four
lookups, are quantised to two bits; sixteen of them pack into one 32-bit integer per position.
Recordings that share integers are aligned: the histogram of their offsets names the shifts to
compare, the bits that differ over the overlap say how alike they are.

Recordings with equal fingerprints form one class first, so a group of copies takes part in the
search once. The search is a join on the integers, grouped by pair and offset.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CLASSES, RATE, WINDOW, HOP = 12, 11025, 4096, 1024
WIDTH = 16  # frames that one integer looks at
#: Filters: kind, first pitch class, pitch classes, frames. Kinds: 0 sum, 1 upper less lower half,
#: 2 later less earlier half, 3 checkerboard, 4 middle less outer thirds in pitch, 5 in time.
FILTERS = [(k % 6, (5 * k) % (CLASSES - h + 1), h, w) for k, (h, w) in enumerate([(12, 16), (6, 4), (4, 16), (6, 8), (6, 12), (4, 9), (3, 8), (8, 6), (6, 6), (4, 8), (9, 15), (12, 12), (2, 16), (12, 10), (10, 4), (8, 14)])]
EDGES = (-0.2, 0.0, 0.2)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)  # neighbouring levels differ in one bit


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12): each frame's energy by pitch class, of unit length. Sound shorter than a window gives none."""
    x = np.asarray(samples, dtype=np.float64)
    n = (len(x) - WINDOW) // HOP + 1
    if n <= 0:
        return np.zeros((0, CLASSES))
    pitch = np.fft.rfftfreq(WINDOW, 1 / rate)
    ok = (pitch > 60) & (pitch < min(4000, rate / 2))
    where = np.round(12 * np.log2(pitch[ok] / 440.0)).astype(int) % CLASSES
    out = np.empty((n, CLASSES))
    window = np.hanning(WINDOW)
    for at in range(0, n, 256):  # a bounded number of frames at a time
        rows = np.arange(at, min(n, at + 256))
        energy = np.abs(np.fft.rfft(x[rows[:, None] * HOP + np.arange(WINDOW)] * window, axis=1)[:, ok]) ** 2
        for c in range(CLASSES):
            out[rows, c] = energy[:, where == c].sum(1)
    return unit(out)


def wav_samples(data: bytes | None, rate: int = RATE) -> np.ndarray:
    """Samples from -1 to 1 of a WAV file's bytes (PCM of 8 to 32 bits, channels averaged), at ``rate`` by linear
    interpolation. What is no such file gives none."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128
    else:  # little-endian; the sign is in the last byte
        wide = np.zeros((len(raw) // width, 4), dtype=np.uint8)
        wide[:, 4 - width :] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
        x = wide.view("<i4")[:, 0] / 2.0 ** (8 * (4 - width))
    x = x.reshape(-1, channels).mean(1) / 2.0 ** (8 * width - 1)
    if own == rate or not len(x) or not own:
        return x
    return np.interp(np.arange(0, len(x), own / rate), np.arange(len(x)), x)


def wav_chroma(data: bytes | None) -> np.ndarray:
    return chroma(wav_samples(data))


def unit(frames: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(frames, axis=1, keepdims=True)
    return np.where(size > 1e-9, frames / np.maximum(size, 1e-9), 0.0)


def codes(frames: np.ndarray) -> np.ndarray:
    """The packed integers of (frames, 12), one per position that has WIDTH frames ahead."""
    frames = np.nan_to_num(np.asarray(frames, dtype=np.float64).reshape(-1, CLASSES))
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[t + t1, c1] - image[t + t0, c1] - image[t + t1, c0] + image[t + t0, c0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        whole = area(0, w, c, c + h)
        if kind == 0:
            a, b = whole, np.full(n, w * h * CLASSES**-0.5 * 0.8)
        elif kind == 1:
            a = area(0, w, c + h // 2, c + h)
            b = whole - a
        elif kind == 2:
            a = area(w // 2, w, c, c + h)
            b = whole - a
        elif kind == 3:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = whole - a
        elif kind == 4:
            a = area(0, w, c + h // 3, c + 2 * h // 3)
            b = (whole - a) / 2
        else:
            a = area(w // 3, 2 * w // 3, c, c + h)
            b = (whole - a) / 2
        level = np.searchsorted(EDGES, np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))))
        out |= GRAY[level] << np.uint32(2 * k)
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """The share of differing bits where a[i + offset] stands by b[i], and the positions compared."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo + offset : hi + offset] ^ b[lo:hi]).sum()) / (32 * (hi - lo)), hi - lo


def fingerprint(recordings: DataFrame, media_col: str, *, to_frames=chroma, name: str = "codes") -> DataFrame:
    """``recordings`` with their integers (array<int>). ``media_col``: what ``to_frames`` turns into (frames, 12): by
    default an array of samples at RATE, with ``wav_chroma`` a binary column of WAV files. Null, broken or
    too short recordings have none; a column of the new one's name keeps it."""
    common.small_batches(recordings.sparkSession)
    (name,) = common.fresh(recordings, name)

    @F.pandas_udf("array<int>")
    def make(values: pd.Series) -> pd.Series:
        none = np.zeros(0)
        held = (v if isinstance(v, bytes) else none if v is None else np.asarray(v, dtype=np.float64) for v in values)
        return pd.Series([codes(to_frames(b"" if to_frames is wav_chroma and not isinstance(v, bytes) else v)).view(np.int32) for v in held], dtype=object)

    return recordings.withColumn(name, make(F.col(media_col)))


def best_shift(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, votes: np.ndarray) -> tuple[int, float, int, int]:
    """Of the offsets the one of highest score (bits alike less bits that differ), with its bit error, the positions
    compared and the score. ``votes``: equal positions; as the others differ in a bit at least, they bound a score."""
    compared = np.minimum(len(b), len(a) - offsets) - np.maximum(0, -offsets)
    bound = 32 * compared - 2 * (compared - votes)
    best = None
    for k in np.lexsort((offsets, -bound)):
        if best is not None and bound[k] < best[0]:
            break
        error, n = bit_error(a, b, int(offsets[k]))
        rank = (32 * n - 2 * round(32 * n * error), -error, -int(offsets[k]), n)
        best = rank if best is None else max(best, rank)
    return -best[2], -best[1], best[3], best[0]


@F.pandas_udf(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("bit_error", T.DoubleType()), T.StructField("compared", T.IntegerType()), T.StructField("score", T.LongType())]))
def _best(a: pd.Series, b: pd.Series, offsets: pd.Series, votes: pd.Series) -> pd.DataFrame:
    rows = [best_shift(np.asarray(x, dtype=np.int32).view(np.uint32), np.asarray(y, dtype=np.int32).view(np.uint32), o.astype(np.int64), v) for x, y, o, v in zip(a, b, offsets, votes, strict=True)]
    return pd.DataFrame(rows, columns=["offset", "bit_error", "compared", "score"])


def align(prints: DataFrame, is_query, *, id_col: str = "rec_id", codes_col: str = "codes", least: int = 1) -> DataFrame:
    """One row per recording: rec_id, n_codes, digest, class_id (smallest rec_id of equal fingerprints), and
    for those that ``is_query`` picks the best other class: match_id, offset (its position less the
    query's), bit_error, compared. Every offset of every pair at which one position is equal (``least``) is
    compared, and the one with most bits alike, less those that differ, wins; of equal ones the least bit error, the
    smallest id, the smallest offset. Empty fingerprints match nothing, repeated ids are rows of their own."""
    common.small_batches(prints.sparkSession)
    rows = common.materialise(prints.select(F.col(id_col).alias("rec_id"), F.col(codes_col).alias("codes"), is_query.alias("query")), "audio-prints")
    rows = rows.withColumn("digest", F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256))
    classes = common.materialise(
        rows.filter(F.size("codes") > 0).groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.max("query").alias("query"), F.first("codes").alias("codes")), "audio-classes")
    # A run of equal integers is one row with its length; two runs overlap by up to the shorter at each offset.
    starts = classes.withColumn("starts", F.expr("filter(sequence(0, size(codes) - 1), i -> i = 0 OR codes[greatest(i - 1, 0)] <> codes[i])"))
    runs = starts.select("class_id", "query", F.expr("inline(transform(starts, (s, k) -> struct(s AS pos, coalesce(get(starts, k + 1), size(codes)) - s AS len, codes[s] AS code)))"))
    q = runs.filter("query").select(F.col("class_id").alias("a"), F.col("pos").alias("at_a"), F.col("len").alias("len_a"), "code")
    o = runs.select(F.col("class_id").alias("b"), F.col("pos").alias("at_b"), F.col("len").alias("len_b"), "code")
    met = q.join(o, "code").filter("a <> b").select("a", "b", "at_a", "at_b", "len_a", "len_b", F.explode(F.expr("sequence(at_b - at_a - len_a + 1, at_b - at_a + len_b - 1)")).alias("offset"))
    equal = F.least(F.col("at_b") + F.col("len_b"), F.col("at_a") + F.col("len_a") + F.col("offset")) - F.greatest(F.col("at_b"), F.col("at_a") + F.col("offset"))
    bins = met.groupBy("a", "b", "offset").agg(F.sum(equal).alias("votes")).filter(F.col("votes") >= least)
    pairs = bins.groupBy("a", "b").agg(F.collect_list(F.struct("offset", "votes")).alias("bins"))
    of = classes.select("class_id", "codes")
    both = pairs.join(of.toDF("a", "codes_a"), "a").join(of.toDF("b", "codes_b"), "b")
    # best_shift shifts its first list, so that is the match.
    best = both.select("a", "b", _best("codes_b", "codes_a", F.col("bins").offset, F.col("bins").votes).alias("e"))
    top = best.groupBy("a").agg(F.min_by(F.struct("b", "e"), F.struct((-F.col("e.score")).alias("s"), "e.bit_error", "b")).alias("m"))
    named = rows.join(classes.select("digest", "class_id"), "digest", "left").withColumn("class_id", F.coalesce("class_id", "rec_id"))
    found = named.join(top, (named.class_id == top.a) & named.query, "left")
    return found.select("rec_id", F.size("codes").cast("long").alias("n_codes"), "digest", "class_id", F.col("m.b").alias("match_id"), F.col("m.e.offset").alias("offset"), F.col("m.e.bit_error").alias("bit_error"), F.col("m.e.compared").alias("compared"))


def tune(vector: np.ndarray) -> np.ndarray:
    """A vector played as a tune: each value is one frame's note, its pitch going round the twelve classes."""
    return np.maximum(0.0, np.cos(2 * np.pi * (np.arange(CLASSES) / CLASSES - 3 * np.asarray(vector)[:, None])))


def op7(spark, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each row of ``embeddings`` is played as a tune of one frame a value.
    Queries are the rows whose id is divisible by 20."""
    tunes = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), "embedding")
    return align(fingerprint(tunes, "embedding", to_frames=tune).drop("embedding"), F.coalesce(F.col("rec_id") % 20 == 0, F.lit(False)))

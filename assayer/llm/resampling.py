"""Importance resampling towards a target distribution (hashed n-gram features, Gumbel noise, exact top scores).

Documents become arrays of feature buckets, stored once. How much more frequent a bucket is in the target than in the
corpus gives its gain; a document's weight is the sum over its array, and seeded Gumbel noise makes drawing the highest
scores a draw without replacement in proportion to the weights. The cutoff comes from bisection: jobs that count the
stored scores at midpoints, exactly; then, among rows at the cutoff, the same over doc_id. The drawn rows alone are
range-partitioned, for their ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table
from assayer.llm.tokens import LOWER, TERM, as_text, split_words, text_slices
from assayer.operators.ranks import numbered

#: Words of a feature at most, buckets, seed of the noise, share drawn in per cent, words that a drawn document has at least.
MOST_WORDS, BUCKETS, SEED, PER_CENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Midpoints that a counting job takes at once: six halvings of the range.
MIDPOINTS = 63
#: Longer words are hashed one by one.
STEPS = 48
_LAST = 2**63 - 1


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] for all spans, as zlib gives it; before: the crc32 of what comes ahead of each span."""
    size = end - start
    state = np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)
    short = np.flatnonzero(size <= STEPS)
    order = short[np.argsort(-size[short], kind="stable")]
    crc, first, sizes = state[order] ^ np.uint32(0xFFFFFFFF), start[order], size[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # spans of more than k bytes
        crc[:n] = _CRC[(crc[:n] ^ data[first[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > STEPS):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def feature_buckets(texts: pa.Array, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features in a row, features per text, words per text)."""
    data, start, end, doc, words = split_words(texts, TERM)
    data = LOWER[data]
    rows, values, before = [], [], None
    first = np.arange(len(start))
    for k in range(most_words):
        if k:  # every run of k words that has a word behind it in its text goes on by a space and that word
            on = first[first + k < len(start)]
            keep = doc[on] == doc[np.minimum(on + k, max(len(start) - 1, 0))]
            before, first = before[: len(on)][keep], on[keep]
            state = before ^ np.uint32(0xFFFFFFFF)
            before = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        before = crc32_spans(data, start[first + k], end[first + k], before)
        rows.append(doc[first])
        values.append(before % np.uint32(buckets))
    row, value = np.concatenate(rows), np.concatenate(values).astype(np.int32)
    if most_words > 1:
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return value, np.bincount(row, minlength=len(texts)), words


def _feature_batches(most_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(1))
            for lo, hi in text_slices(texts):
                value, size, words = feature_buckets(texts[lo:hi], most_words, buckets)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], ["doc_id", "n_words", "features"])

    return run


def hashed_features(docs: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features): the bucket of every run of 1 to most_words words of each whole text, repeats included."""
    return docs.select("doc_id", "text").mapInArrow(_feature_batches(most_words, buckets), "doc_id long, n_words long, features array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; the driver gets one row per bucket that occurs, at most `buckets`."""
    counts = np.zeros(buckets, np.int64)
    for r in features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's share over the corpus's share), one added to every count."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weight_batches(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.asarray(lists.value_lengths(), np.int64)
            total = np.concatenate([[0], np.cumsum(gain[np.asarray(lists.flatten())])])
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(total[end] - total[end - size])], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noisy(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """weight plus 1000 times Gumbel noise, rounded down, from a hash of seed and doc_id; a null id hashes as no text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def threshold(rows: DataFrame, column: str, wanted: int) -> tuple[int, int]:
    """(value, below): the smallest value of an integer column at or below which there are `wanted` rows, and the rows below it.

    Bisection with exact counts: every job counts the rows at or below MIDPOINTS places of the range that is left and
    sends back that many numbers. There must be at least `wanted` rows, and wanted at least 1.
    """
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    below = 0  # rows below lo
    while lo < hi:
        step = max(1, (hi - lo + MIDPOINTS) // (MIDPOINTS + 1))
        mids = list(range(lo, hi, step))[:MIDPOINTS]
        inside = rows.where(F.col(column).between(lo, hi))
        counts = list(inside.agg(*(F.count_if(F.col(column) <= F.lit(m).cast("long")) for m in mids)).first())
        k = next((k for k, n in enumerate(counts) if below + n >= wanted), len(mids))
        if k:
            lo, below = mids[k - 1] + 1, below + counts[k - 1]
        hi = mids[k] if k < len(mids) else hi
    return lo, below


def resample(docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text): rank 1, 2, ... for drawn rows, else null.

    The highest scores among texts of at least least_words words are drawn, equal ones by ascending doc_id, rows without
    an id last, rows of one id and score by number of features, then as stored. Null and empty texts have no features and
    weight 0 and are not drawn; repeated rows count and are drawn each for itself; extra columns are not read. Without
    target texts all buckets count as one there; an empty docs table gives an empty result. Texts are read once: what is
    stored are buckets, then scores. The driver sees counts per bucket and per midpoint.
    """
    features = stored(hashed_features(docs, most_words, buckets), "features")
    aims = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most_words, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aims, buckets))
    weighed = features.mapInArrow(_weight_batches(gain), "doc_id long, n_words long, n_features long, weight long")
    scores = stored(
        weighed.withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed))
        .withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(_LAST)), "_row": F.monotonically_increasing_id()}), "scores")
    fit = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    wanted = scores.where(fit).count() * per_cent // 100
    if not wanted:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn, tied = F.lit(False), fit
    for column in ("_down", "_id", "n_features", "_row"):
        value, below = threshold(scores.where(tied), column, wanted)
        drawn, tied, wanted = drawn | (tied & (F.col(column) < value)), tied & (F.col(column) == value), wanted - below
        if scores.where(tied).count() == wanted:  # no tie is left to break
            break
    drawn = drawn | tied
    order = [F.col(c).asc() for c in ("_down", "_id", "n_features", "_row")]
    ranked = numbered(scores.where(drawn).withColumn("_all", F.lit(0)), "_all", order, "rank")
    return ranked.select(*columns, "rank").unionByName(scores.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Toxicity scores from a factorization machine over all hashed terms: a table of 2**TERM_BITS slots, one code path at every size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table
from assayer.llm.tokens import as_text, hash_spans, mix, split_words, text_slices

#: Labelled rows that fitting reads at most, distinct terms that these rows have together at most (whole rows are left out beyond it), bits of a hashed term.
MAX_ROWS, MAX_PAIRS, TERM_BITS = 20_000, 1 << 24, 20
PREFIX, PUNCTUATION = 5, np.isin(np.arange(256), list(b".,;:!?\"')"))


@dataclass(frozen=True)
class FactorizationMachine:
    """terms: ascending hashed terms; bias + sum of weights + half of (|sum of factors|**2 - sum of |factors|**2)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The score before the sigmoid of n rows, from (term index, row) pairs sorted by row."""
        out = self.bias + np.bincount(row, self.weights[index], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[index, k]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def hashed_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term, row) of every word, without closing punctuation, and of every word's first five bytes or more, up to the end of a character."""
    data, start, end, doc, _ = split_words(texts)
    for _ in range(3):
        cut = PUNCTUATION[data[end - 1]] & (end - start > 1)
        end = end - cut
    long = end - start >= PREFIX
    shift = np.uint64(64 - TERM_BITS)
    whole = hash_spans(data, start, end, 1) >> shift
    cut = start[long] + PREFIX
    for _ in range(3):
        cut = cut + ((cut < end[long]) & (data[np.minimum(cut, len(data) - 1)] >> 6 == 2)) if len(cut) else cut
    front = hash_spans(data, start[long], cut, 2) >> shift
    return np.concatenate([whole, front]).astype(np.int64), np.concatenate([doc, doc[long]])


def distinct_pairs(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((row.astype(np.int64) << TERM_BITS) | term)
    both = both[np.diff(both, prepend=-1) != 0]
    return (both & ((1 << TERM_BITS) - 1)).astype(np.int32), (both >> TERM_BITS).astype(np.int32)


def _index_terms(terms: np.ndarray):
    slot = np.full(1 << TERM_BITS, -1, np.int32)
    slot[terms] = np.arange(len(terms))

    def index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        term, row = distinct_pairs(*hashed_terms(texts))
        at = slot[term]
        return at[at >= 0], row[at >= 0]

    return index


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct hashed term of each text."""
    for batch in batches:
        texts = as_text(batch.column(0))
        for lo, hi in text_slices(texts):
            term, row = distinct_pairs(*hashed_terms(texts[lo:hi]))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32)))], ["label", "terms"])


def evidence(at: np.ndarray, row: np.ndarray, label: np.ndarray, terms: int) -> np.ndarray:
    """By how many standard errors each term's share of toxic rows differs from its share of the others."""
    n, ones = np.bincount(at, minlength=terms), np.bincount(at, label[row], terms)
    n1, n0 = label.sum(), len(label) - label.sum()
    share = n / len(label)
    z = (ones / n1 - (n - ones) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    return np.where(n < len(label), z, 0.0)


def shrunk(z: np.ndarray) -> np.ndarray:
    """(z**2 / (z**2 + 2 ln n))**2 of n standardised numbers: among so many without meaning the farthest is expected at z**2 = 2 ln n.

    What chance alone explains, which abounds where rows are few, comes out near 0, and what is far beyond it near 1.
    """
    square = z * z
    return (square / (square + 2 * np.log(len(z) + 1))) ** 2


def descend(at: np.ndarray, size: np.ndarray, label: np.ndarray, value: np.ndarray, rank: int, epochs: int, steps: int, rate: float, decay: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(a weight and `rank` factors per term, the same before the first step, bias): AdaGrad on the logistic loss.

    at: the term numbers of all rows in a row; value: what stands for each term that a row has. So many epochs, and at least
    so many steps, of 128 rows; a step touches the terms of its rows only.
    """
    rng = np.random.default_rng(seed)
    share = np.clip(label.mean(), 0.01, 0.99)
    table_, squares, bias, bias_square = np.zeros((len(value), rank + 1)), np.full((len(value), rank + 1), 1e-8), np.log(share / (1 - share)), 1e-8
    table_[:, 1:] = rng.normal(0, 0.02, (len(value), rank))
    start, first = table_.copy(), np.cumsum(size) - size
    for _ in range(max(epochs, -(-steps * 128 // len(label)))):
        order = rng.permutation(len(label))
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            own = np.concatenate([at[first[r] : first[r] + size[r]] for r in rows])
            row = np.repeat(np.arange(len(rows)), size[rows])
            slots, place = np.unique(own, return_inverse=True)
            v = value[own]
            x = table_[slots][place] * v[:, None]
            sums = np.stack([np.bincount(row, c, len(rows)) for c in x.T], 1)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.bincount(row, (x[:, 1:] ** 2).sum(1), len(rows)))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            part = np.concatenate([np.ones((len(own), 1)), sums[row, 1:] - x[:, 1:]], axis=1) * (slope[row] * v)[:, None]
            g = np.stack([np.bincount(place, c, len(slots)) for c in part.T], 1) + decay * table_[slots]
            squares[slots] += g * g
            table_[slots] -= rate * g / np.sqrt(squares[slots])
            bias_square += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(bias_square)
    return table_, start, float(bias)


def fit_rows(flat: np.ndarray, size: np.ndarray, label: np.ndarray) -> FactorizationMachine:
    """The machine over all hashed terms of rows: their distinct terms one row after the other, and how many each row has.

    No term is left out, but each enters with a value of its own instead of 1, which is multiplied into its weight and
    factors in the end: the larger of what it tells alone (its evidence) and of what a first machine, for which all terms
    are equal, has learned of it in company (how far its factors have grown, which counts the less the fewer rows hold the
    term); both standardised over all terms and shrunk.
    """
    terms = np.unique(flat)
    at = np.searchsorted(terms, flat).astype(np.int32)
    alone = shrunk(evidence(at, np.repeat(np.arange(len(size), dtype=np.int32), size), label, len(terms)))
    learned, start, _ = descend(at, size, label, np.ones(len(terms)), 4, 1, 120, 0.05, 1e-4)
    grown = np.linalg.norm(learned[:, 1:], axis=1) - np.linalg.norm(start[:, 1:], axis=1)
    middle = np.median(grown)
    spread = 1.4826 * np.median(np.abs(grown - middle)) + 1e-12
    n = np.bincount(at, minlength=len(terms))
    value = np.maximum(alone, shrunk(np.maximum(grown - middle, 0) / spread) * (n / (n + 2 * np.log(len(terms) + 1))) ** 2)
    table_, _, bias = descend(at, size, label, value, 6, 4, 300, 0.4, 1e-4)
    table_ *= value[:, None]
    return FactorizationMachine(terms.astype(np.int32), bias, table_[:, 0].copy(), table_[:, 1:].copy())


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(text, label) of at most max_rows labelled documents, chosen by a hash of doc_id; null labels and ids are left out.

    One document per id, that whose text has the smallest hash, and one label, the largest: rows that repeat an id
    cannot make the sample larger.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return once.select("text", F.col("label").cast("double").alias("label"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_pairs: int = MAX_PAIRS) -> FactorizationMachine:
    """Fits on labelled_sample(docs, labels): the driver gets its rows as lists of hashed terms, at most max_rows of them.

    Rows are taken in the order of a hash while they have no more than max_pairs distinct terms together, so the driver's
    memory is bounded whatever the length of texts. No labelled row, or one label only: a constant.
    """
    rows = labelled_sample(docs, labels, "toxic", max_rows).mapInArrow(_list_terms, "label double, terms array<int>")
    rows = stored(rows.withColumn("_order", F.xxhash64("terms", "label")), "toxicity_rows")
    sizes = rows.select("_order", F.size("terms").alias("n")).toArrow()  # two numbers per row
    order, n = (np.asarray(sizes.column(c).combine_chunks(), np.int64) for c in ("_order", "n"))
    by = np.argsort(order, kind="stable")
    fits = np.cumsum(n[by]) <= max_pairs
    if not fits.all():
        rows = rows.where(F.col("_order") < F.lit(int(order[by][int(np.argmin(fits))])))
    found = rows.select("label", "terms").toArrow()
    label, terms = found.column("label").to_numpy(), found.column("terms").combine_chunks()
    del found
    ones, zeros = label.sum(), len(label) - label.sum()
    flat = np.asarray(terms.values)[terms.offsets[0].as_py() : terms.offsets[-1].as_py()] if len(label) else np.zeros(0, np.int32)
    size = np.diff(np.asarray(terms.offsets)).astype(np.int64) if len(label) else np.zeros(0, np.int64)
    if not (ones and zeros and len(flat)):
        return FactorizationMachine(np.zeros(1, np.int64), float(np.log((ones + 0.5) / (zeros + 0.5))), np.zeros(1), np.zeros((1, 1)))
    parts = np.split(flat, np.cumsum(size)[:-1])
    order = np.lexsort(([int(mix(p.astype(np.uint64)).sum()) for p in parts], size, label))  # whatever the order of arrival
    flat = np.concatenate([parts[k] for k in order])
    del parts, terms
    return fit_rows(flat, size[order], label[order])


def _score_batches(model: FactorizationMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_terms(model.terms)
        for batch in batches:
            texts = as_text(batch.column(batch.num_columns - 1))
            for lo, hi in text_slices(texts, 1 << 20):
                raw = model.raw(*index(texts[lo:hi]), hi - lo)
                score = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), pa.array(score)], [*batch.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """docs' columns (text last) with score, one row per input row; only the text counts. Null text: as empty."""
    keep = [c for c in docs.columns if c not in ("text", "score")]
    out = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(_score_batches(model), f"{schema}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels.where(~held_out))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""Ranked lexical search over a length-stratified index.

Documents whose lengths give the same normaliser m are a stratum; what a term adds to a score then depends on its count
tf alone, so a stratum's postings are kept by term and tf and the impact is computed once per tf, not per posting. A
stratum is cut into segments of bounded size, one row of the index each: (m, segment, docs, terms, tfs, ends, places).
terms and tfs are equally long, by term and falling tf; the documents of run k are docs at places[ends[k-1] : ends[k]].

A search takes its items in blocks. The highest tf of each term bounds what a segment can add to an item. The segments
with the highest bounds are visited first and give each item a score that its last place has at least; then only
segments whose bound reaches that score are visited. Ties with it are visited too, so nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table
from assayer.llm.tokens import TERM, as_text, hash_spans, split_words, text_slices

#: Documents returned per item; documents and terms (with repeats) that a segment has about; items and distinct terms of a block; segments visited first.
DEPTH, SEGMENT_DOCS, SEGMENT_TERMS, BLOCK_ITEMS, BLOCK_TERMS, FIRST_VISITS = 50, 2048, 1 << 18, 4096, 1 << 18, 8
#: Postings that are summed at once: so few that their sums are exact in doubles.
AT_ONCE = 1 << 18
INDEX = "m long, segment int, docs array<long>, terms array<long>, tfs array<int>, ends array<int>, places array<int>"


@dataclass(frozen=True)
class LexicalIndex:
    segments: DataFrame
    n_docs: int
    n_terms: int


def _length_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_text(batch.column(0))
        for lo, hi in text_slices(texts):
            yield pa.RecordBatch.from_arrays([pa.array(split_words(texts[lo:hi], TERM)[4].astype(np.int64))], ["n"])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_text(batch.column(1))
        for lo, hi in text_slices(texts):
            data, start, end, doc, words = split_words(texts[lo:hi], TERM)
            code = hash_spans(data, start, end).view(np.int64)
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(code)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=hi - lo))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[first])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32)))],
                [batch.schema.names[0], "n", "terms", "tfs"])


def document_terms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, terms, tfs): the length of each whole text and its distinct terms, as hashes of 64 bits, with their counts."""
    return docs.select(key, "text").mapInArrow(_term_batches, f"`{key}` {dict(docs.dtypes)[key]}, n long, terms array<long>, tfs array<int>")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then the same for the next."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def _segment(key: tuple, group: pa.Table) -> pa.Table:
    """One row of the index from the documents of a segment."""
    group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls last
    lists = group.column("terms").combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    term, tf = np.asarray(lists.flatten()), np.asarray(group.column("tfs").combine_chunks().flatten())
    place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    last = np.ones(len(term), bool)
    last[:-1] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    end = np.flatnonzero(last)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.table({
        "m": pa.array([key[0].as_py()], pa.int64()), "segment": pa.array([key[1].as_py()], pa.int32()), "docs": pa.array([group.column("doc_id").to_pylist()], pa.list_(pa.int64())),
        "terms": one(term[end], pa.int64()), "tfs": one(tf[end], pa.int32()), "ends": one((end + 1).astype(np.int32), pa.int32()), "places": one(place, pa.int32())})


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_terms: int = SEGMENT_TERMS) -> LexicalIndex:
    """The index of all rows of docs (doc_id, text) that have a term, written to the shared folder.

    Lengths are counted first, as m needs their sum; strata beyond the size of a segment are dealt over several by a hash
    of the row, so documents of one length, copies too, never meet in one task. Null, empty and termless texts are left
    out; repeated rows and rows without an id are documents each for itself; extra columns are not read.
    """
    lengths = stored(docs.select("text").mapInArrow(_length_batches, "n long").where("n > 0").groupBy("n").agg(F.count("*").alias("docs")), "lengths")
    total = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    if not n_docs:
        return LexicalIndex(docs.sparkSession.createDataFrame([], INDEX), 0, 0)
    m = F.expr(f"100L - 50L + (50L * n * {n_docs}L) div {n_terms}L")
    parts = F.greatest(F.ceil(F.sum("docs") / segment_docs), F.ceil(F.sum(F.col("n") * F.col("docs")) / segment_terms))
    strata = stored(lengths.groupBy(m.alias("m")).agg(parts.cast("int").alias("parts")), "strata")
    rows = document_terms(docs).where("n > 0").select("doc_id", F.monotonically_increasing_id().alias("row"), m.alias("m"), "terms", "tfs")
    dealt = rows.join(strata, "m").withColumn("segment", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    return LexicalIndex(stored(dealt.groupBy("m", "segment").applyInArrow(_segment, INDEX), "segments"), n_docs, n_terms)


class Asked:
    """The items of a block: their distinct terms in order, and per term the items that have it."""

    def __init__(self, items: pa.Array, item: np.ndarray, term: np.ndarray, kind: str):
        order = np.lexsort((item, term))
        self.items, self.kind, self.item, self.terms = items, kind, item[order], np.unique(term)
        self.first = np.append(np.searchsorted(term[order], self.terms), len(term))
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.tolist()], np.int64)

    def runs(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place of its term here) of the runs of a segment whose terms are asked for."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        run = np.flatnonzero(self.terms[at] == terms)
        return run, at[run]

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in at, item) for every item of every term."""
        size = self.first[at + 1] - self.first[at]
        return np.repeat(np.arange(len(at)), size), self.item[_spread(self.first[at], size)]

    def bounds(self, m: int, terms: np.ndarray, tfs: np.ndarray, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per item the most that a document of the segment can score: every term with its highest tf, which comes first."""
        top = np.ones(len(run), bool)
        top[1:] = at[1:] != at[:-1]
        run, at = run[top], at[top]
        pair, item = self.pairs(at)
        bound = np.zeros(len(self.items), np.int64)
        np.add.at(bound, item, (self.weight[at] * _impacts(m, tfs[run]))[pair])
        return bound


def _impacts(m: int, tfs: np.ndarray) -> np.ndarray:
    """What one unit of weight adds, computed once per distinct tf."""
    known, at = np.unique(tfs.astype(np.int64), return_inverse=True)
    return ((1_000_000_000 * known) // (1000 * known + 20 * m))[at]


def _lists(batch: pa.RecordBatch, k: int, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(name)[k].values) for name in names]


def _frequency_batches(asked: Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for k in range(len(batch)):
                terms, ends = _lists(batch, k, "terms", "ends")
                own, at = asked.runs(terms)
                np.add.at(df, at, np.diff(ends, prepend=0)[own])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(asked.terms[some]), pa.array(df[some])], ["term", "df"])

    return run


def _bound_batches(asked: Asked, most: int):
    """Of all segments of a task, the `most` with the highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 4), np.int64)  # item, m, segment, bound
        for batch in batches:
            found = [best]
            for k in range(len(batch)):
                m = batch.column("m")[k].as_py()
                terms, tfs = _lists(batch, k, "terms", "tfs")
                bound = asked.bounds(m, terms, tfs, *asked.runs(terms))
                item = np.flatnonzero(bound)
                found.append(np.stack([item, np.full(len(item), m), np.full(len(item), batch.column("segment")[k].as_py()), bound[item]], 1))
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 3], rows[:, 0]))]
            first = np.searchsorted(rows[:, 0], rows[:, 0])
            best = rows[np.arange(len(rows)) - first < most]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.T.copy()], ["item", "m", "segment", "bound"])

    return run


def _score_batches(asked: Asked, depth: int, least: np.ndarray, visits: dict[tuple[int, int], np.ndarray] | None):
    """The highest documents of each segment: of the items in visits, or of all items whose bound reaches their least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                m, segment = batch.column("m")[k].as_py(), batch.column("segment")[k].as_py()
                if visits is not None and (m, segment) not in visits:
                    continue
                terms, tfs = _lists(batch, k, "terms", "tfs")
                own, at = asked.runs(terms)
                active = visits[m, segment] if visits is not None else np.flatnonzero(asked.bounds(m, terms, tfs, own, at) >= least)
                if not len(active):
                    continue
                ends, places = _lists(batch, k, "ends", "places")
                docs = batch.column("docs")[k].values
                scores = _scores(asked, active, len(docs), asked.weight[at] * _impacts(m, tfs[own]), ends[own].astype(np.int64), np.diff(ends, prepend=0)[own].astype(np.int64), places, at)
                item, place = [], []
                for i, s in zip(active.tolist(), scores, strict=True):
                    some = np.flatnonzero(s >= least[i])
                    if len(some) > depth:
                        cut = np.partition(s[some], -depth)[-depth]
                        some = some[s[some] >= cut]
                        some = some[np.argsort(-s[some], kind="stable")[:depth]]
                    item.append(np.full(len(some), i))
                    place.append(some)
                item, place = np.concatenate(item), np.concatenate(place)
                row = np.searchsorted(active, item)
                yield pa.RecordBatch.from_arrays(
                    [asked.items.take(pa.array(item)), pa.array(item), docs.take(pa.array(place)), pa.array(scores[row, place]), pa.array(np.full(len(item), m)), pa.array(np.full(len(item), segment, np.int32)), pa.array(place.astype(np.int32))],
                    ["item_id", "item", "doc_id", "score", "m", "segment", "place"])

    return run


def _scores(asked: Asked, active: np.ndarray, n_docs: int, value: np.ndarray, ends: np.ndarray, sizes: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of all documents of a segment (columns) for the active items (rows)."""
    row_of = np.full(len(asked.items), -1)
    row_of[active] = np.arange(len(active))
    run, item = asked.pairs(at)
    row = row_of[item]
    run, row = run[row >= 0], row[row >= 0]
    scores = np.zeros(len(active) * n_docs, np.int64)
    before = np.cumsum(sizes[run]) - sizes[run]
    turn = before // AT_ONCE  # a run is never longer than a segment has documents
    cuts = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(run))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        r, size = run[lo:hi], sizes[run[lo:hi]]
        cell = np.repeat(row[lo:hi] * n_docs, size) + places[_spread(ends[r] - size, size)]
        base = int(cell.min())
        sums = np.bincount(cell - base, np.repeat(value[r], size).astype(np.float64))
        scores[base : base + len(sums)] += sums.astype(np.int64)
    return scores.reshape(len(active), n_docs)


def _search_block(index: LexicalIndex, asked: Asked, depth: int) -> DataFrame:
    segments = index.segments
    counts = segments.select("terms", "ends").mapInArrow(_frequency_batches(asked), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked.weigh(index.n_docs, {r.term: r.df for r in counts.collect()})
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "segment")
    bounds = segments.select("m", "segment", "terms", "tfs").mapInArrow(_bound_batches(asked, FIRST_VISITS), "item long, m long, segment long, bound long")
    visits: dict[tuple[int, int], list[int]] = {}
    for r in bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_VISITS).select("item", "m", "segment").collect():
        visits.setdefault((r.m, r.segment), []).append(r.item)
    first = {key: np.array(sorted(items)) for key, items in visits.items()}
    schema = f"item_id {asked.kind}, item long, doc_id long, score long, m long, segment int, place int"
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "m", "segment", "place")
    least = np.ones(len(asked.items), np.int64)
    strata = sorted({m for m, _ in first})
    seen = segments.where(F.col("m").between(strata[0], strata[-1])) if strata else segments.limit(0)
    tried = seen.mapInArrow(_score_batches(asked, depth, least, first), schema).withColumn("place", F.row_number().over(by)).where(F.col("place") == depth)
    for r in tried.select("item", "score").collect():
        least[r.item] = r.score
    found = segments.mapInArrow(_score_batches(asked, depth, least, None), schema).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= depth)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: LexicalIndex, items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the `depth` highest documents of every item (item_id, text), scores above 0 only.

    Equal scores rank by ascending doc_id, null ids last, then by the place in the index. Rows that share an item_id, or
    have none, are one item with the terms of all; items without terms that occur have no rows; extra columns are not read.
    Items go in blocks of about BLOCK_ITEMS items and BLOCK_TERMS terms; the driver and the tasks hold one block's terms,
    first visits and least scores, never postings.
    """
    spark, kind = items.sparkSession, dict(items.dtypes)["item_id"]
    pairs = stored(document_terms(items, "item_id").select("item_id", F.explode("terms").alias("term")).distinct(), "items")
    size = pairs.agg(F.count("*").alias("terms"), F.count_distinct(F.xxhash64("item_id")).alias("items")).first()
    if not size.terms or not index.n_docs:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = max(-(-size.items // BLOCK_ITEMS), -(-size.terms // BLOCK_TERMS))
    results = []
    for b in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not len(block):
            continue
        names = block.column("item_id").combine_chunks().dictionary_encode("encode")
        asked = Asked(names.dictionary, np.asarray(names.indices, np.int64), np.asarray(block.column("term"), np.int64), kind)
        found = _search_block(index, asked, depth)
        results.append(found if blocks == 1 else stored(found, f"block{b}"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT rn, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rn, doc_id, text FROM documents)),
tfs AS (SELECT rn, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY rn, term),
lens AS (SELECT rn, sum(tf)::BIGINT AS n FROM tfs GROUP BY rn),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM lens),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (SELECT a.item_id, a.term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked a JOIN dfs USING (term), total),
scored AS (
  SELECT w.item_id, t.rn, any_value(t.doc_id) AS doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + ((50 * l.n * nd) // nt)))))::BIGINT AS score
  FROM weights w JOIN tfs t USING (term) JOIN lens l ON l.rn = t.rn, total GROUP BY w.item_id, t.rn),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rn)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

"""A Katz backoff language model of any order over words, fitted and evaluated as Spark jobs.

P(w | h) is the Good-Turing discounted share of h w where training saw that n-gram, else alpha(h) P(w | h'), where h'
is h without its first word; a history h that training lacks gives P(w | h') itself. P(w) is the discounted share of
w where training saw the word, else the mass left for all unseen words. alpha(h) is what the discounts leave of h
divided by 1 - sum of P(w | h') over the words seen after h, so that every distribution sums to one over the training
words, the end and one unseen word. The start of a document is padded with start marks.

Tokens are dealt to buckets by the word before them (w1, then w2 and so on, backwards; w is the token itself), so all
n-grams of a token, from two words up, and all its histories are in one bucket, and backing off never leaves it. A word
that makes up much of the corpus is spread over all buckets by the two words before a token; the counts of what follows
such a word are summed up once, at the word that follows. Only these, and counts of rare words, come from elsewhere.
The start mark, which every document has once, is spread by the token itself: nothing but start marks precedes it, so all
longer histories of it have the counts of the shortest one, and their totals and backoff weights follow from its sums.

A word is 63 bits of its hash. In n-grams the most frequent words, a bounded dictionary, are their ranks; all rows of a
kind travel in byte strings, one per task and bucket. The tables of a fit are bucketed, so that jobs over the same
buckets do not shuffle them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.blobs import ESCAPE, Codes, Near, dump, fixed, load, unfixed
from assayer.llm.scratch import cleaned, shared_dir, stored, table
from assayer.llm.tokens import as_text, hash_spans, mix, split_words, text_slices

#: Counts up to this are discounted; tokens that a task sorts at once; tokens of a bucket, about; a hot word has more than 1 / (HOT * buckets) of all tokens.
MOST_DISCOUNTED, CHUNK_TOKENS, BUCKET_TOKENS, HOT = 5, 2_000_000, 1_500_000, 4
#: Names of words are below 2**63. The codes of start and end are 0 and 1, other words of the dictionary have ranks below ESCAPE, all others are 2**63 and their name.
RARE = np.uint64(1 << 63)
END_NAME = np.uint64(1 << 63)
START, END = np.uint64(0), np.uint64(1)
PAIRS, DOCS, GRAMS, ASKED, REPLY, CONTEXT, HISTORIES, PART = range(8)
DATABASE = "assayer_katz"
ROW = "bucket int, target int, kind int, chunk long, data binary"


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's discount factor of the counts 0 to MOST_DISCOUNTED, from the number of types seen 1, 2, ... times.

    Factors that the formula puts outside (0, 1), as on tiny corpora, become (r - 1/2) / r.
    """
    n, k = [0, *seen], MOST_DISCOUNTED
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _factor(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= MOST_DISCOUNTED, d[np.minimum(count, MOST_DISCOUNTED).astype(np.int64)], 1.0)


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: the dictionary (ascending names, their codes, counts by code) and the totals of training."""

    order: int
    names: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    hot: np.ndarray
    tokens: int
    types: int
    d: np.ndarray
    total: int
    left: float
    word_buckets: int
    labels: np.ndarray

    def __reduce__(self) -> tuple:
        """In few bytes: counts fall with the codes."""
        by_code = self.names[np.argsort(self.codes)]
        rest = (self.order, self.hot, self.tokens, self.types, self.d, self.total, self.left, self.word_buckets, self.labels)
        return _vocabulary, (dump(by_code, self.counts), rest)

    def encode(self, names: np.ndarray) -> np.ndarray:
        """Codes of ascending or other names."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.codes[at], names | RARE)

    def is_hot(self, codes: np.ndarray) -> np.ndarray:
        return (codes < len(self.hot)) & self.hot[np.minimum(codes, np.uint64(len(self.hot) - 1)).astype(np.int64)]

    def known(self, codes: np.ndarray, rare: np.ndarray, rare_count: np.ndarray) -> np.ndarray:
        """Training counts of codes; those outside the dictionary are looked up among ascending `rare`."""
        small = codes < ESCAPE
        return np.where(small, self.counts[np.where(small, codes, 0).astype(np.int64)], _lookup(rare, rare_count, codes))

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) from training counts; left is the mass of all unseen words together."""
        return np.where(count > 0, _factor(count, self.d) * count / self.total, self.left)

    def word_bucket(self, codes: np.ndarray) -> np.ndarray:
        """Where a word's count is; for words of the dictionary, where the pairs that it ends are summed up."""
        return _bucket(codes & ~RARE, self.word_buckets)


def _vocabulary(data: bytes, rest: tuple) -> Vocabulary:
    by_code, counts = load(data)
    place = np.argsort(by_code)
    return Vocabulary(rest[0], by_code[place], place.astype(np.uint64) + np.uint64(1), counts.astype(np.int64), *rest[1:])


@dataclass(frozen=True)
class KatzModel:
    """The vocabulary, shared with all tasks; discounts d of orders 1 to order; words (target, data): all words with counts, by word bucket; tables: n-grams
    with counts, and histories with log10 of their total and of their backoff weight, by bucket; pairs: counts of what follows hot
    words, by word bucket; hot: per hot word log10 of its total and of its backoff weight; start: the same of histories of 1, 2, ...
    start marks, if the mark is hot."""

    shared: Broadcast
    d: list[np.ndarray]
    words: DataFrame
    tables: DataFrame
    pairs: DataFrame
    hot: np.ndarray
    start: np.ndarray

    @property
    def vocabulary(self) -> Vocabulary:
        return self.shared.value

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens


def _lookup(names: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float = 0) -> np.ndarray:
    """values of wanted among ascending names, default where absent."""
    if not len(names):
        return np.full(len(wanted), default, values.dtype)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, values[at], default)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(names + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges of equal values of an ascending array."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, target, kind, chunk, data)"""
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "target", "kind", "chunk", "data"])


def _of(rows: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True) if k == kind]


def _each(rows: pa.Table, *names: str) -> Iterator[tuple]:
    """Rows one at a time, so that only one byte string is out of Arrow."""
    columns = [rows.column(n) for n in names]
    for k in range(rows.num_rows):
        yield tuple(c[k].as_py() for c in columns)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(name of every word, words per text, rows) of some rows at a time; the text is the last column."""
    for batch in batches:
        texts = as_text(batch.column(batch.num_columns - 1))
        for lo, hi in text_slices(texts):
            data, start, end, _, count = split_words(texts[lo:hi])
            yield hash_spans(data, start, end, 3) >> np.uint64(1), count, batch.slice(lo, hi - lo)


# words


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(names: list[np.ndarray], docs: int) -> pa.RecordBatch:
            found, count = np.unique(np.concatenate([*names, np.full(docs, END_NAME)]), return_counts=True)
            bucket = _bucket(found, buckets)
            order = np.argsort(bucket, kind="stable")
            rows = [(b, dump(Near(found[order[s]]), count[order[s]])) for b, s in _split(bucket[order])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["target", "data"])

        names, docs, n = [], 0, 0
        for own, count, _ in _slices(batches):
            names.append(own)
            docs, n = docs + len(count), n + len(own) + len(count)
            if n >= CHUNK_TOKENS:
                yield counted(names, docs)
                names, docs, n = [], 0, 0
        if n:
            yield counted(names, docs)

    return run


def _merge_words(most: int):
    """One row per word bucket: all its words with counts, counts of counts, and its most frequent words, `most` of them."""

    def run(rows: pa.Table) -> pa.Table:
        names, counts = (np.concatenate(x) for x in zip(*(load(d) for d in rows.column("data").to_pylist()), strict=True))
        names, at = np.unique(names, return_inverse=True)
        counts = np.bincount(at, counts.astype(np.float64)).astype(np.uint64)
        top = np.argsort(counts, kind="stable")[::-1][:most]
        top = np.sort(top[(counts[top] > 1) | (names[top] == END_NAME)])
        seen = np.bincount(np.minimum(counts, MOST_DISCOUNTED + 2).astype(np.int64), minlength=MOST_DISCOUNTED + 3)
        return pa.table({
            "target": rows.column("target")[:1], "data": pa.array([dump(Near(names), counts)], pa.binary()), "tokens": pa.array([int(counts.sum())]),
            "types": pa.array([len(names)]), "seen": pa.array([seen[1 : MOST_DISCOUNTED + 2].tolist()]), "top": pa.array([dump(Near(names[top]), counts[top])], pa.binary())})

    return run


def _sum_lists(df: DataFrame, column: str, n: int) -> list[int]:
    row = df.agg(*(F.coalesce(F.sum(F.get(column, F.lit(k))), F.lit(0)) for k in range(n))).first()
    return [int(x) for x in row]


def _even_labels(spark: SparkSession, buckets: int) -> np.ndarray:
    """Numbers that Spark's hash partitioning deals one to a partition."""
    numbers = spark.range(40 * buckets + 400).select(F.col("id").cast("int").alias("n"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("p"))
    found = {r.p: r.n for r in numbers.groupBy("p").agg(F.min("n").alias("n")).collect()}
    spare = iter(range(40 * buckets + 400, 41 * buckets + 401))
    return np.array([found.get(p) if p in found else next(spare) for p in range(buckets)], np.int32)


def count_words(texts: DataFrame, order: int, buckets: int | None) -> tuple[Broadcast, DataFrame]:
    """The vocabulary of the column text of all rows, and the table of all words with counts.

    The driver gets the dictionary and broadcasts it: ESCAPE words at most, some ten megabytes.
    """
    spark = texts.sparkSession
    word_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "target int, data binary, tokens long, types long, seen array<long>, top binary"
    counted = stored(texts.select("text").mapInArrow(_count_words(word_buckets), "target int, data binary").groupBy("target").applyInArrow(_merge_words(-(-(ESCAPE - 3) // word_buckets)), kinds), "words")
    tokens, types = (int(x) for x in counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    seen = _sum_lists(counted, "seen", MOST_DISCOUNTED + 1)
    d1 = discounts(seen)
    freed = float(sum((1 - d1[r]) * r * seen[r - 1] for r in range(1, MOST_DISCOUNTED + 1)))
    total = tokens if freed else tokens + 1
    left = freed / tokens if freed else 1 / total
    top = [load(bytes(r.top)) for r in counted.select("top").collect()]
    names = np.concatenate([np.zeros(0, np.uint64), *(t[0] for t in top)])
    counts = np.concatenate([np.zeros(0, np.uint64), *(t[1] for t in top)]).astype(np.int64)
    docs = int(counts[names == END_NAME].sum())
    names, counts = names[names != END_NAME], counts[names != END_NAME]
    order_ = np.lexsort((names, -counts))[: ESCAPE - 3]
    names, counts = np.concatenate([[END_NAME], names[order_]]), np.concatenate([[docs], counts[order_]])
    codes = np.arange(1, len(names) + 1, dtype=np.uint64)
    ascending = np.argsort(names)
    counts = np.concatenate([[0], counts])
    n = buckets or max(word_buckets, -(-tokens // BUCKET_TOKENS))
    hot = counts * HOT * n > tokens
    hot[0], hot[1] = docs * HOT * n > tokens, False  # the end precedes nothing
    vocabulary = Vocabulary(order, names[ascending], codes[ascending], counts, hot[: int(np.flatnonzero(hot).max(initial=0)) + 1], tokens, types, d1, total, left, word_buckets, _even_labels(spark, n))
    return spark.sparkContext.broadcast(vocabulary), counted.select("target", "data")


# tokens to buckets


class Chunk:
    """The tokens of some documents in the order (bucket, w1, w, w2, w3, ...): bucket numbers, the columns as places among ascending codes, and documents."""

    def __init__(self, v: Vocabulary, names: list[np.ndarray], counts: list[np.ndarray]):
        self.count = np.concatenate(counts)
        last = np.cumsum(self.count + 1) - 1
        w = np.full(int(last[-1]) + 1 if len(last) else 0, END_NAME, np.uint64)
        inner = np.ones(len(w), bool)
        inner[last] = False
        w[inner] = np.concatenate(names)
        found, word = np.unique(w, return_inverse=True)
        codes = v.encode(found)
        place = np.argsort(codes)
        self.codes = np.concatenate([[START], codes[place]])
        rank = np.empty(len(place), np.int32)
        rank[place] = np.arange(1, len(place) + 1)
        word = rank[word]
        columns = [word]
        for _ in range(max(v.order - 1, 2)):
            before = np.empty_like(word)
            before[1:] = columns[-1][:-1]
            before[last - self.count] = 0
            columns.append(before)
        n, hot = np.uint64(len(v.labels)), v.is_hot(self.codes)[columns[1]]
        by_word = (mix(self.codes + np.uint64(7)) % n).astype(np.int32)
        bucket = by_word[columns[1]]
        beside = np.where(columns[1][hot] == 0, columns[0][hot], columns[2][hot])  # place 0 is the start mark
        bucket[hot] = (mix(self.codes[columns[1][hot]] * np.uint64(0x9E3779B97F4A7C15) ^ self.codes[beside]) % n).astype(np.int32)
        ordered = [columns[1], columns[0], *columns[2 : v.order]]
        bits = int(len(self.codes)).bit_length()
        if len(v.labels).bit_length() + 2 * bits > 63:
            order = np.lexsort((*ordered[::-1], bucket))
        else:
            key = (bucket.astype(np.int64) << 2 * bits) | (ordered[0].astype(np.int64) << bits) | ordered[1]
            order = np.argsort(key)
            for column in ordered[2:]:
                rank = np.empty(len(key), np.int64)
                rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
                key = (rank << bits) | column
                order = np.argsort(key)
        self.bucket, self.columns = bucket[order], [c[order] for c in ordered]
        self.doc = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count + 1)[order]


def _levels(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted columns, per number of leading columns: the rows where a new combination starts."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    out = []
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
        out.append(np.flatnonzero(change))
    return out


def _sizes(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """How many longer combinations every shorter one has."""
    return np.diff(np.append(np.searchsorted(inner, outer), len(inner)))


def _nest(columns: list[np.ndarray]) -> list[np.ndarray | Codes]:
    """Sorted distinct rows of codes for dump: each combination once, with how many longer ones it has."""
    firsts = _levels(columns)
    out: list[np.ndarray | Codes] = [Codes(columns[0][firsts[0]], True)]
    for k in range(1, len(columns)):
        out += [_sizes(firsts[k], firsts[k - 1]), Codes(columns[k][firsts[k]], k == 1)]
    return out


def _flat(parts: list[np.ndarray], width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(columns, what follows them in parts), the inverse of _nest for `width` columns."""
    columns = [parts[0]]
    for k in range(1, width):
        per = parts[2 * k - 1].astype(np.int64)
        columns = [np.repeat(c, per) for c in columns] + [parts[2 * k]]
    return columns, parts[2 * width - 1 :]


def _deal(shared: Broadcast):
    """One row per chunk and bucket: its n-grams, how often each occurs in training and altogether, and each token's document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value

        def dealt(number: int, names: list[np.ndarray], counts: list[np.ndarray], rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk, name = Chunk(v, names, counts), TaskContext.get().partitionId() << 24 | number
            train = np.concatenate([np.asarray(r.column(1).fill_null(False)) for r in rows])
            out = []
            for b, s in _split(chunk.bucket):
                columns = [c[s] for c in chunk.columns]
                at = _levels(columns)[-1]
                doc = chunk.doc[s]
                n, held = np.diff(np.append(at, len(doc))), np.add.reduceat((~train[doc]).astype(np.int64), at)
                out.append((int(v.labels[b]), 0, PAIRS, name, dump(*_nest([chunk.codes[c[at]] for c in columns]), n, held, doc)))
            ids = pa.concat_arrays([r.column(0) for r in rows]).cast(pa.int64())
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
            out.append((int(v.labels[name % len(v.labels)]), 0, DOCS, name, dump(ids, known, chunk.count + 1)))
            return _rows(out)

        names, counts, rows, n, number = [], [], [], 0, 0
        for own, count, part in _slices(batches):
            names.append(own)
            counts.append(count)
            rows.append(part)
            n += len(own) + len(count)
            if n >= CHUNK_TOKENS:
                yield dealt(number, names, counts, rows)
                names, counts, rows, n, number = [], [], [], 0, number + 1
        if n:
            yield dealt(number, names, counts, rows)

    return run


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, buckets: int, what: str) -> DataFrame:
    """df (rows of ROW and more) written once as a table of so many buckets by the column bucket, and read back.

    The tables are in a database of our own in the shared folder, so DROP TABLE takes their files away.
    """
    spark, name = df.sparkSession, f"{DATABASE}.{what}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_dir(spark)}/assayer/{DATABASE}'")
    with cleaned(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, "bucket").saveAsTable(name)
    return spark.table(name)


def deal_tokens(docs: DataFrame, train: Column, shared: Broadcast) -> DataFrame:
    """The tokens of docs (doc_id, text) by bucket; train tells which documents count in a fit (null: not)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text").mapInArrow(_deal(shared), ROW)
    n = len(shared.value.labels)
    return bucketed(rows.repartition(n, "bucket"), n, _name("tokens"))


# counts


def _dense(columns: list[np.ndarray], rare: np.ndarray) -> list[np.ndarray]:
    """Codes as numbers in the same order: those outside the dictionary follow it by their place in ascending rare."""
    return [np.where(c < ESCAPE, c, ESCAPE + np.searchsorted(rare, c)).astype(np.int64) for c in columns]


def _rare(columns: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([c[c >= ESCAPE] for c in columns]))


def _sorted_rows(columns: list[np.ndarray]) -> np.ndarray:
    bits = int(max(int(c.max(initial=0)) for c in columns)).bit_length()
    if bits * len(columns) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0]
    for c in columns[1:]:
        key = (key << bits) | c
    return np.argsort(key)


def _merge_grams(shared: Broadcast):
    """Per bucket: its n-grams with training counts, counts of counts of the orders from two, and what it asks of word buckets.

    It asks for the counts of words outside the dictionary, and of the pairs of a hot word and the word after it, of which
    it gives its own part. Pairs of hot words are counted where they are summed up.
    """
    def run(rows: pa.Table) -> pa.Table:
        v, width = shared.value, shared.value.order
        own_bucket = rows.column("bucket")[0].as_py()
        parts = [_flat(load(d), width) for kind, d in _each(rows, "kind", "data") if kind == PAIRS]
        parts = [(columns, rest[0] - rest[1]) for columns, rest in parts]
        out, seen = [], [0] * ((width - 1) * (MOST_DISCOUNTED + 1))
        if parts:
            columns = [np.concatenate([p[0][k] for p in parts]) for k in range(width)]
            c = np.concatenate([p[1] for p in parts]).astype(np.int64)
            parts = None
            place = _sorted_rows(_dense(columns, _rare(columns)))
            columns, c = [x[place] for x in columns], c[place]
            at, place = _levels(columns)[-1], None
            columns, c = [x[at] for x in columns], np.add.reduceat(c, at)
            first = _levels(columns[:2])[1]
            w1, w, two = columns[0][first], columns[1][first], np.add.reduceat(c, first)
            hot = v.is_hot(w1)
            rare = np.unique(w[w >= ESCAPE])
            asked = np.concatenate([np.zeros(len(rare), np.uint64), w1[hot] + np.uint64(1)])  # 0: the word alone
            word, part = np.concatenate([rare, w[hot]]), np.concatenate([np.zeros(len(rare), np.int64), two[hot]])
            target = v.word_bucket(word)
            order = np.lexsort((word, asked, target))
            for t, s in _split(target[order]):
                o = order[s]
                out.append((own_bucket, t, ASKED, 0, dump(asked[o], Codes(word[o]), part[o])))
            real = c > 0
            if real.any():
                columns, c = [x[real] for x in columns], c[real]
                out.append((own_bucket, 0, GRAMS, 0, dump(*_nest(columns), c)))
                seen = []
                for k, f in enumerate(_levels(columns)[1:], 1):
                    count = np.add.reduceat(c, f)
                    count = count[~v.is_hot(columns[0][f])] if k == 1 else count
                    seen += np.bincount(np.minimum(count, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2].tolist()
        table_ = pa.Table.from_batches([_rows(out)])
        return table_.append_column("seen", pa.array([seen] + [[]] * (len(out) - 1) if out else [], pa.list_(pa.int64())))

    return run


def _answer(shared: Broadcast):
    """Per word bucket: for every asking bucket the counts it wants; the sums of pairs, for other askers; and, per hot word,
    what its backoff weight needs: how many words follow it 1, 2, ... times, its total, and their unigram mass."""
    def run(key: tuple, words: pa.Table, asks: pa.Table) -> pa.Table:
        v, target = shared.value, key[0].as_py()
        hot_words = len(v.hot)
        names, counts = load(words.column("data")[0].as_py()) if words.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        parts = [load(d) for d in asks.column("data").to_pylist() if d]
        out, seen = [], np.zeros(MOST_DISCOUNTED + 1, np.int64)
        stats = np.zeros((hot_words, MOST_DISCOUNTED + 2))
        if parts:
            asked, word = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            part = np.concatenate([p[2] for p in parts]).astype(np.int64)
            place = np.lexsort((word, asked))
            change = np.concatenate([[True], (asked[place][1:] != asked[place][:-1]) | (word[place][1:] != word[place][:-1])])
            first = np.flatnonzero(change)
            one, two, total = asked[place][first], word[place][first], np.add.reduceat(part[place], first)
            small = two < ESCAPE
            count = np.where(small, v.counts[np.where(small, two, 0).astype(np.int64)], _lookup(names, counts, two & ~RARE).astype(np.int64))
            pair = one > 0
            total[~pair] = count[~pair]
            back = np.empty(len(place), np.int64)
            back[place] = np.cumsum(change) - 1
            edge = np.cumsum([0, *(len(p[0]) for p in parts)])
            for b, lo, hi in zip(asks.column("bucket").to_pylist(), edge[:-1], edge[1:], strict=True):
                out.append((b, target, REPLY, 0, dump(total[back[lo:hi]])))
            seen_pair = pair & (total > 0)
            h, c = (one[seen_pair] - np.uint64(1)).astype(np.int64), total[seen_pair]
            seen = np.bincount(np.minimum(c, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
            for r in range(1, MOST_DISCOUNTED + 1):
                stats[:, r - 1] = np.bincount(h[c == r], minlength=hot_words)
            stats[:, -2], stats[:, -1] = np.bincount(h, c, hot_words), np.bincount(h, v.unigram(count[seen_pair]), hot_words)
            out.append((-1, target, PAIRS, 0, dump(one[seen_pair], Codes(two[seen_pair]), c)))
        used = np.flatnonzero(stats[:, -2])
        table_ = pa.Table.from_batches([_rows(out)])
        empty = [[]] * (len(out) - 1) if out else []
        more = {"seen": [seen.tolist()] + empty, "hot": [used.tolist()] + empty, "stats": [stats[used].tolist()] + empty}
        for name, kind in (("seen", pa.int64()), ("hot", pa.int64()), ("stats", pa.list_(pa.float64()))):
            table_ = table_.append_column(name, pa.array(more[name] if out else [], pa.list_(kind)))
        return table_

    return run


def _recall(shared: Broadcast):
    """Per word bucket, for tokens that had no part in the fit: the same counts from the words and the sums of pairs."""

    def run(key: tuple, known: pa.Table, asks: pa.Table) -> pa.Table:
        target, out = key[0].as_py(), []
        words = [load(d) for d in _of(known, DOCS)]
        names, counts = words[0] if words else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        pairs = [load(d) for d in _of(known, PAIRS)]
        one, two, total = pairs[0] if pairs else (np.zeros(0, np.uint64),) * 3
        keys = mix(mix(one) + two)
        order = np.argsort(keys)
        for b, data in zip(asks.column("bucket").to_pylist(), asks.column("data").to_pylist(), strict=True):
            asked, word, _ = load(data)
            found = np.where(asked > 0, _lookup(keys[order], total[order], mix(mix(asked) + word)), _lookup(names, counts, word & ~RARE))
            out.append((b, target, REPLY, 0, dump(found)))
        return pa.Table.from_batches([_rows(out)])

    return run


# histories


def _context(v: Vocabulary, rows: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a bucket learned from word buckets: ascending rare words and their counts, ascending keys of hot pairs and their counts."""
    answers = dict(zip(replies.column("target").to_pylist(), replies.column("data").to_pylist(), strict=True))
    asked, word, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for kind, target, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "target", "data")), strict=True):
        if kind == ASKED:
            a, w, _ = load(data)
            asked.append(a)
            word.append(w)
            count.append(load(answers[target])[0])
    asked, word, count = np.concatenate(asked), np.concatenate(word), np.concatenate(count)
    alone = asked == 0
    rare = np.argsort(word[alone])
    keys = mix(mix(asked[~alone]) + word[~alone])
    pairs = np.argsort(keys)
    return word[alone][rare], count[alone][rare], keys[pairs], count[~alone][pairs]


def _backoff(total: np.ndarray, free: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the total, one more where discounts free nothing, and of the backoff weight."""
    bare = free <= 0
    total, free = total + bare, np.where(bare, 1.0, free)
    return np.log10(np.maximum(total, 1.0)), np.log10(free / np.maximum(total, 1.0) / np.maximum(1 - mass, 1e-300))


def _start_backoff(seen: np.ndarray, total: float, one: np.ndarray, d: list[np.ndarray]) -> np.ndarray:
    """Per number of start marks (from 1) log10 of their total and of their backoff weight, from how many words follow 1, 2, ... times.

    one: that of a single mark. The words after k marks have the counts that they have after one; only the discounts differ.
    """
    out = np.zeros((len(d), 2))
    out[1] = one
    free = [float((seen * np.arange(1, MOST_DISCOUNTED + 1) * (1 - f[1:])).sum()) for f in d]
    for k in range(2, len(d)):
        out[k] = np.stack(_backoff(np.array([total]), np.array([free[k]]), np.array([(total - free[k - 1]) / 10.0 ** out[k - 1, 0]])), 1)[0]
    return out


@dataclass
class _Tables:
    """A bucket's n-grams for lookups. The combination (w1, w, w2, ...) of k columns is the number id of (w1, w, ...) of k - 1 columns and one more word."""

    rare: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def find(self, ids: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
        """Numbers of combinations, -1 for those that training lacks (as where ids is)."""
        keys = self.keys[level]
        wanted = (ids << 32) | word
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((ids >= 0) & (word >= 0) & (keys[at] == wanted), at, -1)

    def dense(self, codes: np.ndarray) -> np.ndarray:
        """As _dense, -1 for words that the bucket's n-grams lack."""
        if not len(self.rare):
            return np.where(codes < ESCAPE, codes, np.uint64(0)).astype(np.int64) - (codes >= ESCAPE) * np.int64(1)
        at = np.minimum(np.searchsorted(self.rare, codes), len(self.rare) - 1)
        return np.where(codes < ESCAPE, codes.astype(np.int64), np.where(self.rare[at] == codes, ESCAPE + at, -1))


def _tables(columns: list[np.ndarray], c: np.ndarray | None = None) -> _Tables:
    """Lookups of ascending combinations, with counts if there are any."""
    t, firsts = _Tables(_rare(columns)), _levels(columns)
    for k, f in enumerate(firsts):
        keys = _dense([columns[k][f]], t.rare)[0]
        if k:
            keys |= np.repeat(np.arange(len(firsts[k - 1])) << 32, _sizes(f, firsts[k - 1]))
        t.keys.append(keys)
        if c is not None:
            t.counts.append(np.add.reduceat(c, f))
    return t


def _histories(shared: Broadcast, d: list[np.ndarray], hot: np.ndarray, start: np.ndarray):
    """Per bucket: its n-grams, what it learned from word buckets, and per length of history its words, log10 of totals and of backoff weights."""
    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        v, bucket = shared.value, key[0].as_py()
        order = v.order
        rare, rare_count, pairs, pair_count = _context(v, rows, replies)
        out = [(bucket, 0, CONTEXT, 0, dump(Codes(rare), rare_count, pairs, pair_count))]
        for data in _of(rows, GRAMS):
            columns, (c,) = _flat(load(data), order)
            c = c.astype(np.int64)
            firsts = _levels(columns)
            first, two = firsts[1], np.add.reduceat(c, firsts[1])
            w1, w = columns[0][first], columns[1][first]
            is_hot = v.is_hot(w1)
            two = np.where(is_hot, _lookup(pairs, pair_count, mix(mix(w1 + np.uint64(1)) + w)).astype(np.int64), two)
            each = _sizes(first, firsts[0])
            begin = np.cumsum(each) - each
            total = np.add.reduceat(two, begin).astype(np.float64)
            free = np.add.reduceat(np.where(two <= MOST_DISCOUNTED, (1 - _factor(two, d[1])) * two, 0.0), begin)
            mass = np.add.reduceat(v.unigram(v.known(w, rare, rare_count)), begin)
            deep, back = _backoff(total, free, mass)
            own = columns[0][firsts[0]]
            mine = v.is_hot(own)
            at = np.where(mine, own, np.uint64(0)).astype(np.int64)
            deep, back = np.where(mine, hot[at, 0], deep), np.where(mine, hot[at, 1], back)
            out.append((bucket, 1, HISTORIES, 0, dump(Codes(own, True), fixed(deep), fixed(back))))
            #: P(w | history) of the n-grams of the level before, by row of that level
            share = _factor(two, d[1]) * two / np.repeat(10.0**deep, each)
            for k in range(2, order):
                f = firsts[k]
                count = np.add.reduceat(c, f)
                words = [columns[0][f], *(x[f] for x in columns[2 : k + 1])]
                dense = _dense(words, _rare(words))
                place = _sorted_rows(dense)
                words = [x[place] for x in words]
                at = _levels(words)[-1]
                count, up = count[place], np.repeat(np.arange(len(firsts[k - 1])), _sizes(f, firsts[k - 1]))[place]
                total = np.add.reduceat(count, at).astype(np.float64)
                free = np.add.reduceat(np.where(count <= MOST_DISCOUNTED, (1 - _factor(count, d[k])) * count, 0.0), at)
                deep, back = _backoff(total, free, np.add.reduceat(share[up], at))
                marks = (words[0][at] == START) & v.is_hot(words[0][at])
                deep, back = np.where(marks, start[k, 0], deep), np.where(marks, start[k, 1], back)
                out.append((bucket, k, HISTORIES, 0, dump(*_nest([x[at] for x in words]), fixed(deep), fixed(back))))
                share = np.empty(len(place))
                share[place] = _factor(count, d[k]) * count / np.repeat(10.0**deep, np.diff(np.append(at, len(place))))
            out.append((bucket, 0, GRAMS, 0, data))
        return pa.Table.from_batches([_rows(out)])

    return run


def _asked_context(shared: Broadcast):
    """Per bucket, for tokens that had no part in the fit: what it learned from word buckets."""

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        rare, rare_count, pairs, pair_count = _context(shared.value, rows, replies)
        return pa.Table.from_batches([_rows([(key[0].as_py(), 0, CONTEXT, 0, dump(Codes(rare), rare_count, pairs, pair_count))])])

    return run


# scores


def _score(m: KatzModel) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For every chunk with tokens in this bucket: sums per document."""
    shared, d, hot, start, events = m.shared, m.d, m.hot, m.start, m.tokens + m.vocabulary.types + 1

    def run(key: tuple, rows: pa.Table, model: pa.Table) -> pa.Table:
        v, order = shared.value, shared.value.order
        rare, rare_count, pairs, pair_count = [np.zeros(0, np.uint64)] * 4
        tables, found = _Tables(np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * order, [np.zeros(0, np.int64)] * order), {}
        for kind, k, data in _each(model, "kind", "target", "data"):
            if kind == CONTEXT:
                rare, rare_count, pairs, pair_count = load(data)
            elif kind == GRAMS:
                words, (c,) = _flat(load(data), order)
                tables = _tables(words, c.astype(np.int64))
            elif kind == HISTORIES:
                words, values = _flat(load(data), k)
                found[k] = (_tables(words), *map(unfixed, values))
        histories, words = [found[k] for k in sorted(found)], None
        out = []
        for kind, chunk, data in _each(rows, "kind", "chunk", "data"):
            if kind == DOCS:
                out.append((0, 0, DOCS, chunk, data))
            if kind != PAIRS:
                continue
            columns, (n, _, doc) = _flat(load(data), order)
            n, doc = n.astype(np.int64), doc.astype(np.int64)
            firsts = _levels(columns)
            spread = lambda x, k: np.repeat(x, np.diff(np.append(firsts[k], len(columns[0]))))  # noqa: B023, E731
            dense = [tables.dense(x[f]) for x, f in zip(columns, firsts, strict=True)]
            w1, w = columns[0][firsts[1]], columns[1][firsts[1]]
            one = v.known(w, rare, rare_count).astype(np.float64)
            value = np.log10(v.unigram(one))
            ids = [tables.find(np.zeros(len(firsts[0]), np.int64), dense[0], 0)]
            for k in range(1, order):
                ids.append(tables.find(np.repeat(ids[-1], _sizes(firsts[k], firsts[k - 1])), dense[k], k))
            is_hot = v.is_hot(w1)
            two = np.where(ids[1] >= 0, tables.counts[1][ids[1]] if len(tables.counts[1]) else 0, 0)
            two = np.where(is_hot, _lookup(pairs, pair_count, mix(mix(w1 + np.uint64(1)) + w)).astype(np.int64), two)
            own = columns[0][firsts[0]]
            deep, back = np.zeros(len(w1)), np.zeros(len(w1))
            if histories:
                t, *values = histories[0]
                known = np.repeat(t.find(np.zeros(len(own), np.int64), t.dense(own), 0), _sizes(firsts[1], firsts[0]))
                deep, back = (np.where(known >= 0, x[known], 0.0) for x in values)
            at = np.where(is_hot, w1, np.uint64(0)).astype(np.int64)
            deep, back = np.where(is_hot, hot[at, 0], deep), np.where(is_hot, hot[at, 1], back)
            value = np.where(two > 0, np.log10(np.where(two > 0, _factor(two, d[1]) * two, 1.0)) - deep, value + back)
            value = spread(value, 1)
            for k in range(2, order):
                full = spread(np.where(ids[k] >= 0, tables.counts[k][ids[k]] if len(tables.counts[k]) else 0, 0), k)
                deep, back = np.zeros(len(full)), np.zeros(len(full))
                if len(histories) >= k:
                    t, *values = histories[k - 1]
                    known = spread(t.find(np.zeros(len(own), np.int64), t.dense(own), 0), 0)
                    for level in range(1, k):
                        known = t.find(known, t.dense(columns[level + 1]), level)
                    deep, back = (np.where(known >= 0, x[known], 0.0) for x in values)
                marks = spread((own == START) & v.is_hot(own), 0)
                deep, back = np.where(marks, start[k, 0], deep), np.where(marks, start[k, 1], back)
                value = np.where(full > 0, np.log10(np.where(full > 0, _factor(full, d[k]) * full, 1.0)) - deep, value + back)
            docs = int(doc.max()) + 1
            base, seen = spread(np.log10((one + 1) / events), 1), spread((one > 0).astype(np.float64), 1)
            sums = [np.bincount(doc, np.repeat(x, n), docs) for x in (value, base, seen)]
            own = np.flatnonzero(np.bincount(doc, minlength=docs))
            out.append((0, 0, PART, chunk, dump(Near(own), fixed(sums[0][own]), fixed(sums[1][own]), sums[2][own].astype(np.uint64))))
        return pa.Table.from_batches([_rows(out)])

    return run


def _finish_chunk(rows: pa.Table) -> pa.Table:
    ids, known, n = load(_of(rows, DOCS)[0])
    sums = np.zeros((3, len(ids)))
    for data in _of(rows, PART):
        own, score, base, known_words = load(data)
        for k, values in enumerate((unfixed(score), unfixed(base), known_words)):
            sums[k][own.astype(np.int64)] += values
    return pa.table({
        "doc_id": pa.array(ids.view(np.int64), mask=known == 0), "n_tokens": pa.array(n.astype(np.int64)),
        "n_known": pa.array(sums[2].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})


# the whole


def _fit(tokens: DataFrame, shared: Broadcast, words: DataFrame) -> KatzModel:
    """The model of the training tokens among `tokens`; its tables hold what all of them need."""
    v, n = shared.value, MOST_DISCOUNTED + 1
    merged = bucketed(tokens.groupBy("bucket").applyInArrow(_merge_grams(shared), f"{ROW}, seen array<long>"), len(v.labels), grams := _name("grams"))
    asks = merged.where(F.col("kind") == ASKED).select("target", "bucket", "data")
    answers = stored(words.groupBy("target").cogroup(asks.groupBy("target")).applyInArrow(_answer(shared), f"{ROW}, seen array<long>, hot array<long>, stats array<array<double>>"), "answers")
    seen, pairs_seen = _sum_lists(merged, "seen", (v.order - 1) * n), _sum_lists(answers, "seen", n)
    seen[:n] = [a + b for a, b in zip(seen[:n], pairs_seen, strict=True)]
    d = [v.d, *(discounts(seen[k * n : k * n + n]) for k in range(v.order - 1))]
    stats = np.zeros((len(v.hot), MOST_DISCOUNTED + 2))
    parts = answers.select(F.explode(F.arrays_zip("hot", "stats")).alias("z"))
    for r in parts.groupBy("z.hot").agg(F.array(*(F.sum(F.col("z.stats")[k]) for k in range(MOST_DISCOUNTED + 2))).alias("sums")).collect():  # a row per hot word
        stats[r.hot] = r.sums
    free = (stats[:, :MOST_DISCOUNTED] * np.arange(1, MOST_DISCOUNTED + 1) * (1 - d[1][1:])).sum(1)
    hot = np.stack(_backoff(stats[:, -2], free, stats[:, -1]), 1)
    hot[stats[:, -2] == 0] = 0.0
    start = _start_backoff(stats[0, :MOST_DISCOUNTED], float(stats[0, -2]), hot[0], d) if stats[0, -2] else np.zeros((len(d), 2))
    pairs = answers.where(F.col("kind") == PAIRS).select("target", "kind", "data")
    replies = answers.where(F.col("kind") == REPLY).select("bucket", "target", "data")
    tables = _with_histories(merged, replies, shared, d, hot, start)
    tokens.sparkSession.sql(f"DROP TABLE {DATABASE}.{grams}")  # its n-grams are in tables too
    return KatzModel(shared, d, words, tables, pairs, hot, start)


def _with_histories(rows: DataFrame, replies: DataFrame, shared: Broadcast, d: list[np.ndarray], hot: np.ndarray, start: np.ndarray) -> DataFrame:
    found = rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_histories(shared, d, hot, start), ROW)
    return bucketed(found, len(shared.value.labels), _name("tables"))


def _scored(tokens: DataFrame, tables: DataFrame, m: KatzModel) -> DataFrame:
    parts = tokens.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_score(m), ROW)
    return parts.groupBy("chunk").applyInArrow(_finish_chunk, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def fit_katz(texts: DataFrame, buckets: int | None = None, order: int = 3) -> KatzModel:
    """Learns from the column text of all rows of texts (null: empty). order: words of an n-gram, from 2. buckets: by default
    as many as the counted tokens need, and at least the shuffle partitions. Rows are counted within tasks first, so a
    frequent word or n-gram costs a task one entry. Repeated rows count as often as they occur; an empty table is a model in which
    no word was seen; other columns have no effect.
    """
    if order < 2:
        raise ValueError("order must be two or more")
    shared, words = count_words(texts, order, buckets)
    return _fit(deal_tokens(texts.select(F.lit(None).alias("doc_id"), "text"), F.lit(True), shared), shared, words)


def score_katz(docs: DataFrame, model: KatzModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per row of docs (doc_id, text; null text: empty).

    A document's tokens go to the buckets of the words before them, where every token is settled; sums come back per chunk
    of documents. Repeated rows are scored each for itself; an empty table gives an empty result.
    """
    shared = model.shared
    tokens = deal_tokens(docs, F.lit(False), shared)
    asked = tokens.groupBy("bucket").applyInArrow(_merge_grams(shared), f"{ROW}, seen array<long>").where(F.col("kind") == ASKED)
    asked = stored(asked.select("bucket", "target", "kind", "chunk", "data"), "asked")
    known = model.pairs.unionAll(model.words.select("target", F.lit(DOCS).alias("kind"), "data"))
    asks = asked.select("target", "bucket", "data")
    replies = stored(known.groupBy("target").cogroup(asks.groupBy("target")).applyInArrow(_recall(shared), ROW), "replies")
    context = asked.groupBy("bucket").cogroup(replies.select("bucket", "target", "data").groupBy("bucket")).applyInArrow(_asked_context(shared), ROW)
    # n-grams and histories are those of the fit, whose words these documents need not have
    tables = stored(model.tables.where(F.col("kind") != CONTEXT).unionAll(context), "tables")
    return _scored(tokens, tables, model)


def fit_and_score(docs: DataFrame, train: Column, order: int = 3, buckets: int | None = None) -> tuple[KatzModel, DataFrame]:
    """fit_katz on the rows of docs for which train holds, and score_katz on all rows, from one dealing of the tokens."""
    shared, words = count_words(docs.where(train), order, buckets)
    tokens = deal_tokens(docs, train, shared)
    model = _fit(tokens, shared, words)
    return model, _scored(tokens, model.tables, model)


def _held_out_scores(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, scored = fit_and_score(docs, ~held_out, order)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out_scores(spark, sf_dir, 3)


def op1_katz_bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out_scores(spark, sf_dir, 2)


def op1_katz_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out_scores(spark, sf_dir, 3)

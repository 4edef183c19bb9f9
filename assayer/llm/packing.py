"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table
from assayer.llm.slices import ranked
from assayer.llm.tokens import as_text, hash_spans, split_words, text_slices

#: Tokens of a sequence, the id after each document, words that a task's cache of token ids holds at most.
MOST_TOKENS, END_ID, CACHED_WORDS = 4096, 1, 1_000_000
STOPS = np.isin(np.arange(256), list(b".,;:!?"))
LETTERS = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


class WordTokenizer:
    """Ids of whole texts from the ids of their words.

    The vocabulary's rules drop white space and never join characters across it, nor letters or digits with the
    stops after them, so a text's ids are those of its stems and stops in order. Each distinct one is encoded
    once; the rest is numpy.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.encoder = Tokenizer.from_file(path)
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        self.ends[[i for token, i in self.encoder.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word). Words of letters only go through the encoder as one line."""
        size, parts = np.zeros(len(words), np.int64), [none := np.zeros(0, np.uint32)] * len(words)
        others = [i for i, w in enumerate(words) if not w.isalpha()]
        letters = np.array([i for i, w in enumerate(words) if w.isalpha()], np.int64)
        for k in range(0, len(letters), 4096):
            own = letters[k : k + 4096].tolist()
            ids = np.array(self.encoder.encode(" ".join([words[i] for i in own]), add_special_tokens=False).ids, np.uint32)
            edge = np.flatnonzero(self.ends[ids]) + 1
            if len(edge) != len(own):  # a letter that lower-casing takes apart
                others += own
                continue
            edge = [0, *edge.tolist()]
            for i, lo, hi in zip(own, edge, edge[1:], strict=False):
                parts[i] = ids[lo:hi]
        for i, e in zip(others, self.encoder.encode_batch_fast([words[i] for i in others], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        size[:] = [len(p) for p in parts]
        return np.concatenate([none, *parts]), size

    def _learn(self, codes: np.ndarray, words: list[str]) -> None:
        flat, size = self._encode(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, codes)
        self.known = np.insert(self.known, at, codes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(flat)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        data, start, end, doc, _ = split_words(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = data.tobytes()
        start, end, doc = _stems_and_stops(data, start, end, doc)
        special = b"<|" in raw  # the names of special tokens keep their case
        code = hash_spans(data, start, end, 9 if special else 0, fold=not special)
        found, first, each = np.unique(code, return_index=True, return_inverse=True)
        if len(self.known) + len(found) > CACHED_WORDS:
            self.clear()
        new = ~_among(self.known, found)
        if new.any():
            self._learn(found[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.known, found)[each]
        size = self.size[at]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[at] - (total - size), size) + np.arange(int(total[-1]))]
        return ids, np.bincount(doc, size, len(texts)).astype(np.int64)


def _among(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _stems_and_stops(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with up to four closing stops cut off, where a letter or digit (ASCII or of the block at U+00C0) precedes."""
    stem = end.copy()
    for _ in range(4):
        stem -= STOPS[data[stem - 1]] & (stem - start > 1)
    last, before = data[stem - 1], data[np.maximum(stem - 2, start)]
    letter = LETTERS[last] | ((before == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7))
    cut = (stem < end) & letter
    at = np.arange(len(start)) + np.cumsum(cut) - cut
    out = np.empty((2, len(start) + int(cut.sum())), np.int64)
    out[0, at], out[1, at] = start, np.where(cut, stem, end)
    out[0, at[cut] + 1], out[1, at[cut] + 1] = stem[cut], end[cut]
    return out[0], out[1], np.repeat(doc, 1 + cut)


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str | None) -> WordTokenizer:
    """One per Python process: a vocabulary read anew for each task leaves its worker's memory in pieces that grow task by task."""
    return WordTokenizer(path)


def _piece_batches(path: str | None, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(path)
        for batch in batches:
            texts = as_text(batch.column(1))
            for lo, hi in text_slices(texts, 1 << 20):
                ids, size = words.ids(texts[lo:hi])
                row, piece, length, crc = [], [], [], []
                at = 0
                for k, n in enumerate(size.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p in range(0, n + 1, most):
                        cut = own[p : p + most]
                        row.append(lo + k)
                        piece.append(p // most)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * most), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_slots(counts: dict[int, int], most: int = MOST_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, documents per sequence, offset): best fit over counts.

    Lengths go from long to short; all documents of one length are placed at once, each into the open sequences
    with the least room that takes them. Sequences with equal room are one range of numbers, so the work and the
    plan depend on the number of lengths, never on the number of documents.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    slots, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        room = length
        while left:
            while room <= most and not rooms.get(room):
                room += 1
            if room <= most:
                first, n = rooms[room].pop()
            else:
                room, first, n = most, opened, -(-left // (most // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, most - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, n = first + full, n - full
            if n and left and left < each:
                slots.append((length, rank, rank + left, first, left, most - room))
                put(room - left * length, first, 1)
                rank, left = rank + left, 0
                first, n = first + 1, n - 1
            put(room, first, n)
            room = length
    return slots


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = MOST_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are one token, the end. Longer documents than `most` are cut. The driver sees a count
    per length, at most `most` rows, and plans slots; pieces take them by their rank within their length, a join
    on length and a range of ranks. The plan is broadcast: its size depends on `most` alone. Ranks go by the numbers of the
    stored pieces, so rows that are equal in everything, however many, fall into all slices of their length alike. Repeated
    rows are packed each for itself; extra columns are not read; an empty table gives an empty result.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(_piece_batches(tokenizer, most, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stored(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.createDataFrame(plan_slots(counts, most), "slot_length long, low long, high long, first long, each long, begin long")
    slot = F.col("rank") - F.col("low")
    salts = max(64, max(counts.values(), default=0) // 1_000_000)  # slices of a hot length hold about a million pieces
    placed = ranked(pieces, "length", ["number"], salts).join(
        F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(slot / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("begin") + F.pmod(slot, F.col("each")) * F.col("length")).cast("long").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

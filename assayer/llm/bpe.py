"""Byte-pair encoding by backtracking over longest tokens, and decoding by an offset table.

The merges of a piece of text are the one row of tokens that covers it in which every two neighbours are compatible:
while both were being merged, no merge across their border came first. So a piece needs no queue of merges. An
Aho-Corasick automaton over all tokens tells the longest token that ends at each place; from the end of the piece the
encoder takes the longest token that is compatible with the one behind it, else the next shorter one, else it goes
back a token. A place that was left once is never entered again, as what follows it is the same whichever way it was
reached; a piece of n bytes is done in a number of steps proportional to n.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.packing import WordTokenizer
from assayer.llm.scratch import table
from assayer.llm.tokens import as_text, text_slices

#: Answers that the table of compatible pairs keeps at most, and ids that are decoded at once.
KNOWN_PAIRS, AT_ONCE = 4_000_000, 1 << 20
#: Added to the last character of a token that ends a word.
AT_END = 0x10000


def vocabulary_path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _special(spec: dict) -> dict[str, int]:
    """The added tokens by their text; only those that are found in the text as it stands are known here."""
    for t in spec["added_tokens"]:
        if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']} has options that are not supported")
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


class Merges:
    """Exact merges of pieces under a vocabulary with word ends. A symbol is one character, AT_END added to a piece's last."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("only byte-level BPE with word ends and without options is supported")
        self.suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = [-1] * (max(vocab.values()) + 1)
        self.left, self.right, self.merged = [-1] * len(self.rank), [-1] * len(self.rank), {}
        for k, (a, b) in enumerate(pairs):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank[x], self.rank[y]) >= k or self.rank[t] >= 0:
                raise ValueError("merges must follow those of their parts and name each token once")
            self.rank[t], self.left[t], self.right[t], self.merged[x, y] = k, x, y, k
        self.pairs: dict[tuple[int, int], bool] = {}
        symbols = {t: self._symbols(name) for name, t in vocab.items()}
        self.size = [0] * len(self.rank)
        # a token that its own merges do not lead to never occurs
        usable = {t for t in symbols if self.rank[t] < 0 or self._meet(self.left[t], self.right[t], self.rank[t])}
        for t in sorted(usable, key=lambda t: self.rank[t]):
            if self.rank[t] >= 0 and not (self.left[t] in usable and self.right[t] in usable):
                usable.discard(t)
        self.automaton, by_symbols = ahocorasick.Automaton(), {}
        for t in usable:
            by_symbols[symbols[t]] = t
            self.size[t] = len(symbols[t])
            self.automaton.add_word(symbols[t], t)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.rank)
        for t in usable:
            s = symbols[t]
            self.shorter[t] = next((by_symbols[s[k:]] for k in range(1, len(s)) if s[k:] in by_symbols), -1)

    def _symbols(self, token: str) -> str:
        core = token.removesuffix(self.suffix)
        return self.ended(core) if core and core != token else token

    @staticmethod
    def ended(piece: str) -> str:
        return piece[:-1] + chr(AT_END + ord(piece[-1]))

    def _meet(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a and b, next to each other, are both still there once all merges that rank below `before` are done.

        Goes back in time along the tokens at the border: each is there from its own merge to the merge that took it
        up. A merge across the border must not fall into the time that its two sides share; of equal merges the one
        more to the left comes first.
        """
        rank, a_until, b_until = self.rank, before, before
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < a_until and across <= b_until and across < before:
                return False
            if rank[a] > rank[b]:
                a_until, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_until, b = rank[b], self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._meet(a, b)
        return known

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece in byte characters."""
        longest, at = [0] * len(piece), -1
        for end, token in self.automaton.iter(self.ended(piece)):
            if end != at:  # the longest token comes first
                longest[end], at = token, end
        size, shorter, left, found = self.size, self.shorter, set(), []
        place, token = len(piece), longest[-1]
        while place:
            while token >= 0 and (place - size[token] in left or found and not self.compatible(token, found[-1])):
                token = shorter[token]
            if token >= 0:
                found.append(token)
                place -= size[token]
                token = longest[place - 1]
            else:
                left.add(place)
                token = found.pop()
                place += size[token]
                token = shorter[token]
        return found[::-1]


class BacktrackingTokenizer(WordTokenizer):
    """WordTokenizer whose distinct words are merged by Merges; the library only normalises and splits them."""

    def __init__(self, path: str | None):
        path = vocabulary_path(path)
        super().__init__(path)
        spec = _read(path)
        self.merges, self.special = Merges(spec["model"]), _special(spec)
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() and text.isalpha():
            return [text.lower()]
        return [piece for piece, _ in self.encoder.pre_tokenizer.pre_tokenize_str(self.encoder.normalizer.normalize_str(text))]

    def encode_word(self, word: str) -> list[int]:
        parts = self.names.split(word) if self.names and "<" in word else [word]
        ids: list[int] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self._pieces(part):
                    ids += self.merges.encode(piece)
        return ids

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.encode_word(w) for w in words]
        return np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64)


class OffsetTable:
    """All tokens of a vocabulary in one run of bytes, with the place and size of each; decoding copies spans of it.

    The vocabularies read here have no decoder: a text's tokens are joined by one space.
    """

    def __init__(self, path: str | None):
        spec = _read(vocabulary_path(path))
        if spec["decoder"] is not None:
            raise ValueError("only vocabularies without a decoder are supported")
        names = {t: name.encode() for name, t in (spec["model"]["vocab"] | _special(spec)).items()}
        parts = [names.get(t) for t in range(max(names) + 1)]
        # each token with the space behind it; ids without a token are left out, their space too
        self.bytes = np.frombuffer(b"".join(p + b" " for p in parts if p is not None), np.uint8)
        self.size = np.array([0 if p is None else len(p) + 1 for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of lists of ids that stand in a row, counts per list."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, -1)
        size = np.where(ids >= 0, self.size[ids], 0)
        row = np.repeat(np.arange(len(counts)), counts)
        last = np.full(len(counts), -1)
        named = np.flatnonzero(size)
        last[row[named]] = named  # the last named id of each list goes without its space
        size[last[last >= 0]] -= 1
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        data = self.bytes[np.repeat(self.start[ids] - (end - size), size) + np.arange(total)]
        offsets = np.concatenate([[0], np.concatenate([[0], end])[np.cumsum(counts)]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data))


def _encode_batches(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = BacktrackingTokenizer(path)
        for batch in batches:
            texts = as_text(batch.column(1))
            for lo, hi in text_slices(texts, 1 << 20):
                ids, size = words.ids(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids), one row per document: the ids that the vocabulary's own library gives, without special tokens added.

    Names of special tokens in a text become their ids, as there. Null, empty and blank texts have no ids; repeated rows
    and rows without an id are encoded each for itself; extra columns are not read; an empty table gives an empty result.
    tokenizer is the path of a vocabulary file that every executor can read. A task keeps the ids of the words it has met.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode_batches(tokenizer), "doc_id long, ids array<int>")


def _decode_batches(path: str | None, column: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets_of = OffsetTable(path)
        for batch in batches:
            lists = batch.column(column)
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = np.asarray(lists.flatten().cast(pa.int64()).fill_null(-1))
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(batch):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
                texts = offsets_of.decode(flat[before : int(ends[hi - 1])], counts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([texts if name == column else part.column(name) for name in batch.schema.names], [into if name == column else name for name in batch.schema.names])
                lo = hi

    return run


def decode_ids(encoded: DataFrame, tokenizer: str | None = None, column: str = "ids", into: str = "text") -> DataFrame:
    """encoded with `into`, the text of the ids, in place of column; all other columns stay.

    Null and empty lists, and lists of ids that the vocabulary does not have, give the empty text.
    """
    schema = ", ".join(f"`{into if n == column else n}` {'string' if n == column else t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decode_batches(tokenizer, column, into), schema)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole document."""
    coded = encode_documents(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode_ids(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

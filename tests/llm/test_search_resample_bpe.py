"""op11, op12 and op13 against brute force, the tokenizers library, and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import helpers as X
from assayer.llm import bpe, lexical, resampling

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall((text or "").translate(LOW))


# op11


def brute_search(docs, items, depth=50):
    """docs: (doc_id, text) rows; items: {item_id: set of terms}."""
    tfs = [(d, Counter(terms(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    n, total, df = len(tfs), sum(sum(c.values()) for _, c in tfs), Counter(w for _, c in tfs for w in c)
    out = {}
    for item, asked in items.items():
        found = []
        for d, c in tfs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if c[w])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out[item] = [(None if none else d, -s) for s, none, d in sorted(found)[:depth]]
    return out


def searched(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {k: [r[1:] for r in rows] for k, rows in got.items()}


@pytest.mark.parametrize("sizes", [(2048, 1 << 18), (3, 1 << 18), (64, 200)])
def test_search_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_VISITS", 2)
    rng = random.Random(sizes[0])
    pool = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(4000)]
    docs = [(rng.choice([None, *range(60)]), " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 5, 5, 5, 40])))) for _ in range(400)]
    items = [(k % 9, " ".join(rng.choices(pool, k=6))) for k in range(11)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"), *sizes)
    merged = defaultdict(set)
    for k, t in items:
        merged[k] |= set(terms(t))
    for depth in (50, 4):
        want = brute_search(docs, merged, depth)
        assert searched(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), depth)) == {k: v for k, v in want.items() if v}


def test_search_in_blocks_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical, "AT_ONCE", 50)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], {r.item_id: set(terms(r.text)) for r in items.collect()})
    assert searched(lexical.search(lexical.build_index(docs, 16), items)) == {k: v for k, v in want.items() if v}


def test_search_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the CAT", 0.5), (2, None, None), (3, "", None), (4, "nowhere-to-be-found", None), (None, "ipsum", None), (5, "你好 🙂", None), (1, "mat", None)], "item_id long, text string, score double")
    df = X.docs(spark, clash=True)
    index = lexical.build_index(df)
    got = searched(lexical.search(index, items))
    want = brute_search([(r[0], r[1]) for r in X.DOCS], {1: {"the", "cat", "mat"}, None: {"ipsum"}, 5: {"你好", "🙂"}})
    assert got == {k: v for k, v in want.items() if v}
    assert [d for d, _ in got[1]][:3] == [1, 5, 5] and got[None] == [(4, got[None][0][1])]
    assert lexical.search(lexical.build_index(X.docs(spark, empty=True)), items).count() == 0
    assert lexical.search(index, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "... !"), (2, None)], "doc_id long, text string")
    assert lexical.build_index(blank).n_docs == 0


def test_segments_stay_small(spark):
    """Copies of one length are dealt over many segments, and the index tells every posting back."""
    docs = spark.createDataFrame([(k, "same words in every copy") for k in range(3000)] + [(9000, "other")], "doc_id long, text string")
    segments = lexical.build_index(docs, 100).segments
    sizes = [len(r.docs) for r in segments.collect()]
    assert sum(sizes) == 3001 and len(sizes) == 31 and max(sizes) < 150
    for r in segments.collect():
        assert r.docs == sorted(r.docs) and r.ends[-1] == len(r.places) and sorted(r.terms) == r.terms


# op12


def brute_resample(docs, target, most=1, buckets=10_000, per_cent=10, least=20, seed=2024):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = order[: len(order) * per_cent // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter(out) + Counter({(*r, None): n for r, n in left.items()})


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [1, 3])
def test_resample_brute_force(spark, most):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], most)
    assert rows_of(resampling.resample(docs, items, most)) == want


def test_resample_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert rows_of(resampling.op12_importance_resampling(spark, SF)) == brute_resample([(r.doc_id, r.text) for r in docs], [r.text for r in items])


def test_resample_awkward_rows(spark):
    target = spark.createDataFrame([("the cat",), (None,), ("",)], "text string")
    for kwargs in ({"least": 0, "per_cent": 50}, {"least": 1, "per_cent": 100}, {}):
        ours = {"least_words": kwargs.get("least", 20), "per_cent": kwargs.get("per_cent", 10)}
        assert rows_of(resampling.resample(X.docs(spark, clash=True), target, **ours)) == brute_resample([(r[0], r[1]) for r in X.DOCS], ["the cat"], **kwargs)
    assert resampling.resample(X.docs(spark, empty=True), target).count() == 0
    assert rows_of(resampling.resample(X.docs(spark), target.limit(0), least_words=1)) == brute_resample([(r[0], r[1]) for r in X.DOCS], [], least=1)


def test_resample_ties(spark):
    """Thousands of equal rows with one id, and with none: as many are drawn as asked for, with unique ranks."""
    text = "alpha beta gamma " * 10
    docs = spark.createDataFrame([(7 if k % 3 else None, text) for k in range(3000)], "doc_id long, text string").repartition(6)
    rows = resampling.resample(docs, docs.limit(1), per_cent=37).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert len(rows) == 3000 and ranks == list(range(1, 1111))


def test_threshold(spark):
    rng = random.Random(3)
    for values in ([5] * 9, [rng.randint(-(2**62), 2**62) for _ in range(300)], [rng.randint(0, 4) for _ in range(200)], [-(2**63), 2**63 - 1, 0]):
        df, ordered = spark.createDataFrame([(v,) for v in values], "v long").checkpoint(), sorted(values)
        for wanted in (1, len(values) // 2, len(values)):
            v = ordered[wanted - 1]
            assert resampling.threshold(df, "v", wanted) == (v, sum(x < v for x in values))


def test_crc32_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 300))
    start, end = cuts[:-1], cuts[1:]
    before = rng.integers(0, 2**32, len(start), dtype=np.uint32)
    for given in (None, before):
        got = resampling.crc32_spans(data, start, end, given)
        assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), 0 if given is None else int(x)) for a, b, x in zip(start, end, before, strict=True)]
    assert resampling.crc32_spans(data, start[:0], end[:0]).tolist() == []


# op13


@pytest.fixture(scope="module")
def words():
    return bpe.BacktrackingTokenizer(None)


def library(words, text):
    return words.encoder.encode(text, add_special_tokens=False).ids


def test_merges_equal_the_library(words):
    rng = random.Random(8)
    names = [t.removesuffix("</w>") for t in words.encoder.get_vocab()]
    plain = [t for t in names if t.isascii() and t.isalpha()]
    for _ in range(3000):
        glued = "".join(rng.choices(plain, k=rng.randint(1, 5))).lower()
        few = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 3, 26])], k=rng.randint(1, 40)))
        assert words.merges.encode(glued) == library(words, glued) and words.merges.encode(few) == library(words, few)


def test_texts_equal_the_library(words):
    rng = random.Random(9)
    parts = list("aeinst'.,!é1 ßAÇñ你<|>-ΣİǅǺ\n\t ") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "é", " ́", " ", " ", "\x1c", ";", "ﬁ", "한", "각"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    ids, size = words.ids(pa.array(texts))
    ends = np.cumsum(size)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, size, strict=True)] == [library(words, t) for t in texts]


def test_steps_grow_with_the_length(words, monkeypatch):
    """Answers of the compatibility table per byte stay few on texts that repeat themselves."""
    asked = Counter()
    plain = bpe.Merges.compatible
    monkeypatch.setattr(bpe.Merges, "compatible", lambda self, a, b: asked.update("x") or plain(self, a, b))
    for unit in ("a", "ab", "na", "haha", "ther", "inging"):
        for n in (2_000, 20_000):
            asked.clear()
            text = (unit * n)[:n]
            assert words.merges.encode(text) == library(words, text)
            assert asked["x"] <= 4 * n


def test_decode(spark, words):
    table = bpe.OffsetTable(None)
    rng = random.Random(2)
    lists = [[rng.randrange(49408) for _ in range(rng.choice([0, 0, 1, 5, 300]))] for _ in range(200)]
    flat = np.array([i for x in lists for i in x], np.int64)
    got = table.decode(flat, np.array([len(x) for x in lists])).to_pylist()
    assert got == [words.encoder.decode(x, skip_special_tokens=False) for x in lists]
    odd = spark.createDataFrame([(1, [320, 49999, -4, 539]), (2, None), (3, []), (4, [10**6]), (5, [None, 320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(odd).collect()} == {1: words.encoder.decode([320, 539], skip_special_tokens=False), 2: "", 3: "", 4: "", 5: words.encoder.decode([320], skip_special_tokens=False)}


def test_round_trip_query(spark, words):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op13_bpe_round_trip(spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        ids = library(words, docs[r.doc_id])
        text = words.encoder.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_awkward_rows(spark, words):
    coded = bpe.encode_documents(X.docs(spark, clash=True)).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in coded) == sorted((r[0] or -1, library(words, r[1] or "")) for r in X.DOCS)
    assert bpe.encode_documents(X.docs(spark, empty=True)).count() == 0
    assert bpe.decode_ids(bpe.encode_documents(X.docs(spark, empty=True))).count() == 0


def test_unsupported_vocabularies():
    with pytest.raises(ValueError):
        bpe.Merges({"type": "BPE", "end_of_word_suffix": None, "continuing_subword_prefix": None, "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False, "vocab": {}, "merges": []})
    with pytest.raises(ValueError):
        bpe._special({"added_tokens": [{"content": "x", "id": 1, "normalized": True, "single_word": False, "lstrip": False, "rstrip": False}]})

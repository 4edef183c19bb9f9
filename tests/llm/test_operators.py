"""The operators against brute force, round trips, held-out accuracy, and awkward rows."""

import dataclasses
import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import helpers as X
from assayer.llm import chat, embeddings, jpeg, katz, media, mixing, packing, quality, registry, secrets, simhash, toxicity
from assayer.llm.blobs import Codes, Near, dump, load
from assayer.llm.components import connected_components
from rows import same_as_duckdb

SF = "/root/testdata/sf0.001"


def texts(spark, folder=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    same_as_duckdb(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_blobs():
    x = np.array([5, 9, 2**47, 3, 2**63 + 5], np.uint64)
    a, b, c, d, e = load(dump(x, Near(x), np.array([0.5, -1.0]), Codes(x), Codes(x, near=True)))
    assert a.tolist() == b.tolist() == d.tolist() == e.tolist() == x.tolist() and c.tolist() == [0.5, -1.0]
    assert [len(v) for v in load(dump(np.zeros(0, np.uint64), Near(np.zeros(0, np.uint64)), Codes(np.zeros(0, np.uint64))))] == [0, 0, 0]


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 160)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    edges = {p for p in pairs if p[0] is not None and p[0] != p[1]}
    names = sorted({x for p in edges for x in p})
    for g in X.groups(len(names), lambda i, j: (names[i], names[j]) in edges or (names[j], names[i]) in edges):
        assert {got[names[i]] for i in g} == {min(names[i] for i in g)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# op1


def test_katz_awkward_rows(spark):
    df = X.docs(spark, clash=True)
    model = katz.fit_katz(df, 3)
    rows = katz.score_katz(df, model).collect()
    assert len(rows) == len(X.DOCS) and sum(r.doc_id == 5 for r in rows) == 2
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 8)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    none = katz.fit_katz(X.docs(spark, empty=True), 3)
    assert all(math.isfinite(r.score) for r in katz.score_katz(df, none).collect())
    assert katz.score_katz(X.docs(spark, empty=True), model).count() == 0


def _katz_of_order(train, order):
    grams, words = [Counter() for _ in range(order)], Counter()
    for t in train:
        line = ["<s>"] * (order - 1) + [*X.words(t), "</s>"]
        for i in range(order - 1, len(line)):
            words[line[i]] += 1
            for k in range(order):
                grams[k][tuple(line[i - k : i + 1])] += 1
    n, d = sum(words.values()), [katz.discounts([sum(v == r for v in g.values()) for r in range(1, 7)]) for g in grams]
    factor = lambda k, c: d[k][c] if c <= 5 else 1.0
    left = sum((1 - factor(0, c)) * c for c in words.values()) / n
    after = defaultdict(list)
    for k in range(1, order):
        for g in grams[k]:
            after[g[:-1]].append(g[-1])

    @functools.cache
    def of(h):
        counts = [grams[len(h)][*h, w] for w in after[h]]
        free = sum((1 - factor(len(h), c)) * c for c in counts)
        bare = free <= 0
        return sum(counts) + bare, (1.0 if bare else free) / (1 - sum(p(h[1:], w) for w in after[h]))

    def p(h, w):
        if not h:
            return factor(0, words[w]) * words[w] / n if w in words else left
        if h not in after:
            return p(h[1:], w)
        total, rest = of(h)
        c = grams[len(h)][*h, w]
        return factor(len(h), c) * c / total if c else rest / total * p(h[1:], w)

    return p, words


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_of_any_order_equals_brute_force(spark, order):
    all_texts = texts(spark)
    train = {i for i in all_texts if zlib.crc32(str(i).encode()) % 7 != 2}
    p, words = _katz_of_order([all_texts[i] for i in train], order)
    for h in (("<s>",) * (order - 1), ("unheard of", "the", "of")[-order + 1 :]):
        assert sum(p(h, w) for w in words) + p(h, "unheard of") == pytest.approx(1)
    docs, n, wanted = spark.read.parquet(f"{SF}/documents.parquet"), sum(words.values()), {}
    for k, text in all_texts.items():
        line = ["<s>"] * (order - 1) + [*X.words(text), "</s>"]
        own = line[order - 1 :]
        wanted[k] = (len(own), sum(w in words for w in own), sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in own),
                     sum(math.log10(p(tuple(line[i - order + 1 : i]), line[i])) for i in range(order - 1, len(line))))
    few = katz.fit_katz(docs.where(F.col("doc_id").isin(train)), buckets=5, order=order)
    results = [katz.score_katz(docs, few), katz.fit_and_score(docs, F.col("doc_id").isin(train), order, buckets=40)[1]]
    if order == 3:
        results.append(registry.QUERIES["op1_katz_scores"](spark, SF))
    for rows in results:
        rows = rows.collect()
        assert len(rows) == len(all_texts)
        for r in rows:
            tokens, known, base, score = wanted[r.doc_id]
            assert (r.n_tokens, r.n_known) == (tokens, known)
            assert r.score == pytest.approx(score, rel=1e-8) and r.base_score == pytest.approx(base, rel=1e-8)
    if order == 3:
        assert all((r.train_tokens, r.held_out) == (n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_starts_of_many_short_documents(spark, order):
    """The start mark makes up a quarter of all histories: no bucket holds much more than the others, and scores are those of brute force."""
    rng = np.random.default_rng(order)
    names = [f"w{k}" for k in range(3000)]
    draw = lambda n: [" ".join(names[int(x)] for x in (rng.pareto(0.6, 3) * 3) % 3000) for _ in range(n)]
    train = draw(2500)
    p, words = _katz_of_order(train, order)
    model = katz.fit_katz(spark.createDataFrame([(t,) for t in train], "text string"), buckets=64, order=order)
    assert model.vocabulary.hot[0]
    asked = [*train[:60], *draw(60), "unheard of things", "unheard", "", names[2999]]
    for r in katz.score_katz(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect():
        line = ["<s>"] * (order - 1) + [*X.words(asked[r.doc_id]), "</s>"]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(line[i - order + 1 : i]), line[i])) for i in range(order - 1, len(line))), rel=1e-8)


def test_no_bucket_takes_all_starts(spark):
    texts_ = [" ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 5000, 3)) for k in range(20_000)]
    v, _ = katz.count_words(spark.createDataFrame([(t,) for t in texts_], "text string"), 3, 64)
    chunk = katz.Chunk(v.value, [katz.hash_spans(*_spans(texts_)) >> np.uint64(1)], [np.full(20_000, 3)])
    sizes = np.bincount(chunk.bucket, minlength=64)
    assert sizes.max() < 2 * sizes.mean()


def _spans(texts_):
    import pyarrow as pa

    from assayer.llm.tokens import split_words

    return split_words(pa.array(texts_))[:3]


def test_katz_buckets_beyond_16_bits(spark):
    """Bucket numbers of any size, words outside the dictionary, and a dictionary smaller than the vocabulary."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    v, _ = katz.count_words(docs, 3, 4)
    many = dataclasses.replace(v.value, labels=np.arange(40_000, dtype=np.int32))
    names = [np.arange(1, 3000, dtype=np.uint64) * np.uint64(2**40 + 12345)]
    chunk = katz.Chunk(many, names, [np.array([1000, 1999])])
    assert (np.diff(chunk.bucket) >= 0).all() and chunk.bucket.min() >= 0 and chunk.bucket.max() > 32_768 and len(chunk.doc) == 3001
    few = katz.fit_katz(docs, 4)
    wanted = {r.doc_id: r.score for r in katz.score_katz(docs, few).collect()}
    limit, katz.ESCAPE = katz.ESCAPE, 50
    try:
        small, words = katz.count_words(docs, 3, 4)
    finally:
        katz.ESCAPE = limit
    assert len(small.value.names) < 50 < len(v.value.names)
    tokens = katz.deal_tokens(docs, F.lit(True), small)
    model = katz._fit(tokens, small, words)
    assert {r.doc_id: r.score for r in katz._scored(tokens, model.tables, model).collect()} == pytest.approx(wanted)


def test_katz_trigrams_awkward_rows(spark):
    df = X.docs(spark, clash=True)
    model = katz.fit_katz(df, 3, order=3)
    rows = katz.score_katz(df, model).collect()
    assert len(rows) == len(X.DOCS) and all(math.isfinite(r.score) for r in rows)
    none = katz.fit_katz(X.docs(spark, empty=True), 3, order=3)
    assert all(math.isfinite(r.score) for r in katz.score_katz(df, none).collect())
    assert katz.score_katz(X.docs(spark, empty=True), model).count() == 0


# op2


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(150):
        v = base[k % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 12 % 3)))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [], 1), (205, rows[0][1], None), (206, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1L as node", "'x' as low", "2 as block", "0 as copies", "true as good")
    got = {r.vec_id: r for r in embeddings.link_embeddings(df, 0.93, block=16).collect()}
    good = lambda k: rows[k][2] is not None and k < 150
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in range(150)}
    linked = lambda i, j: good(i) and good(j) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93
    assert sum(linked(i, j) for i in range(150) for j in range(i)) > 100
    for g in X.groups(len(rows), linked):
        for i in g:
            r = got[rows[i][0]]
            assert r.component_id == min(rows[k][0] for k in g) and r.kept == (r.vec_id == r.component_id)
            assert r.n_links == sum(k != i and linked(i, k) for k in range(len(rows)))
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_near_the_threshold_repeats_and_null_ids(spark):
    """Pairs that int8 cannot settle, exact copies, repeated and null ids, doubles."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=24)
    rows = []
    for k in range(120):
        side = rng.normal(size=24)
        side -= side @ base / (base @ base) * base
        angle = math.acos(0.93) + rng.choice([-1e-3, -1e-6, 1e-6, 1e-3]) if k else 0.0
        rows.append((k, (base / np.linalg.norm(base) * math.cos(angle) + side / np.linalg.norm(side) * math.sin(angle)).tolist(), "a"))
    rows += [(3, rows[3][1], "a"), (500, rows[3][1], "a"), (501, rows[3][1], "b"), (None, rows[0][1], "a"), (7, (-np.array(rows[7][1])).tolist(), "a")]
    got = sorted(embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), block=32).collect(), key=str)
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in rows]
    linked = lambda i, j: rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93
    wanted = []
    for g in X.groups(len(rows), linked):
        low = min(rows[k][0] for k in g if rows[k][0] is not None)
        for i in g:
            component = None if rows[i][0] is None else low
            wanted.append((rows[i][0], sum(int(k != i and linked(i, k)) for k in range(len(rows))), component, None if component is None else rows[i][0] == component))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, norm, error = embeddings.quantise(x)
    guess = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(x @ x.T - guess) <= norm[:, None] * error + error[:, None] * norm + error[:, None] * error + 1e-12).all()


# op3


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob|>\nx", "yo"), (1, 3, "<|cy", "ok"), (1, None, "ann", None), (None, 0, None, "x"), (2, 0, "system", "alone"), (3, 0, "ann", "same"), (3, 0, "ann", "same"), (4, 0, "ann", X.LONG), (4, 1, "bob", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as segment", "1 as part", "7L as size", "'y' as perspective", "true as own", "'z' as head")
    pages = chat.render_dialogues(chat.rotate_perspectives(df)).collect()
    whole, mask = defaultdict(str), defaultdict(str)
    for r in sorted(pages, key=lambda r: r.start):
        assert r.start == len(whole[r.conv_id, r.perspective])
        whole[r.conv_id, r.perspective] += r.rendered
        mask[r.conv_id, r.perspective] += "," + r.mask
    assert set(whole) == {(1, "ann"), (1, "bob|>\nx"), (1, "<|cy"), (None, "unknown"), (3, "ann"), (4, "ann"), (4, "bob")}
    text = whole[1, "ann"]
    assert text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob| > x|>\nyo<|end|>\n<|user name=< |cy|>\nok<|end|>\n<|assistant|>\n<|end|>\n"
    spans = [tuple(map(int, x.split("-"))) for x in mask[1, "ann"].split(",") if x]
    assert [text[a:b] for a, b in spans] == ["hi < |end|><|end|>\n", "<|end|>\n"]
    assert whole[4, "ann"] == f"<|assistant|>\n{X.LONG}<|end|>\n<|user name=bob|>\nshort<|end|>\n" and sum(r.conv_id == 4 for r in pages) == 4
    assert len(re.findall(r"^<\|(?:system|assistant|user name=[^\n]*)\|>$", text, re.M)) == 5
    assert chat.render_dialogues(chat.rotate_perspectives(df.limit(0))).count() == 0


def test_names_stay_apart(spark):
    names = ["a<", "a< ", "a", "<", "x|>", "x| >", "x|  >", "<|x", "< |x", "<|>", "< |>", "<| >", "|", "|>", ">", "", "$1", "a<|user name=b|>"]
    safe = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(chat.safe_name(F.col("n")).alias("s")).collect()]
    assert len(set(safe)) == len(names)
    for n, s in zip(names, safe, strict=True):
        header = f"<|user name={s}|>"
        assert header.count("<|") == 1 and header.count("|>") == 1 and header.endswith("|>")
    turns = spark.createDataFrame([(1, k, n, "hi") for k, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    assert chat.rotate_perspectives(turns).count() == len(names) ** 2


# op4


def _slow_decode(data):
    """A bit-by-bit decoder of progressive JPEGs: coefficients per component, in zigzag order."""
    image = jpeg.parse(data)
    grids = image.grids()
    out = [np.zeros((d * a, 64), int) for d, a, _, _ in grids]
    for s in image.scans:
        order = []
        if len(s.components) > 1:
            down, across = grids[0][0] // image.sampling[0][1], grids[0][1] // image.sampling[0][0]
            for t in range(down * across):
                order.append([(c, (t // across * v + y) * grids[c][1] + t % across * h + x) for c in s.components for h, v in [image.sampling[c]] for y in range(v) for x in range(h)])
        else:
            c = s.components[0]
            order = [[(c, t // grids[c][3] * grids[c][1] + t % grids[c][3])] for t in range(grids[c][2] * grids[c][3])]
        step = s.restart or len(order)
        edges = [s.begin, *(i for i in range(s.begin, s.end) if data[i] == 0xFF and data[i + 1] & 0xF8 == 0xD0), s.end]
        for part, (a, b) in enumerate((x + 2 * (n > 0), y) for n, (x, y) in enumerate(zip(edges, edges[1:], strict=False))):
            raw = data[a:b].replace(b"\xff\x00", b"\xff")
            bits = iter("".join(f"{x:08b}" for x in raw) + "1" * 64)
            take = lambda n: int("0" + "".join(next(bits) for _ in range(n)), 2)  # noqa: B023, E731

            def symbol(code):
                value = 0
                for n in range(1, 17):
                    value = value << 1 | take(1)  # noqa: B023
                    for sym in code.symbols:
                        if code.length[sym] == n and code.code[sym] == value:
                            return sym
                raise AssertionError

            last, eob = defaultdict(int), 0
            for group in order[part * step : (part + 1) * step]:
                for c, block in group:
                    z = out[c][block]
                    k = s.components.index(c)
                    lo, hi = s.band
                    if lo == 0:
                        if s.ah:
                            z[0] |= take(1) << s.al
                        else:
                            n = symbol(s.dc[k])
                            v = take(n)
                            last[c] += v if not n or v >> (n - 1) else v - (1 << n) + 1
                            z[0] = last[c] << s.al
                    elif not s.ah:
                        if eob:
                            eob -= 1
                            continue
                        i = lo
                        while i <= hi:
                            r, n = divmod(symbol(s.ac[k]), 16)
                            if n:
                                i += r
                                v = take(n)
                                z[i] = (v if v >> (n - 1) else v - (1 << n) + 1) << s.al
                                i += 1
                            elif r == 15:
                                i += 16
                            else:
                                eob = (1 << r) + take(r) - 1
                                break
                    else:
                        def fix(i, z=z, al=s.al):
                            if take(1):  # noqa: B023
                                z[i] += (1 << al) if z[i] > 0 else -(1 << al)

                        i = lo
                        while not eob and i <= hi:
                            r, n = divmod(symbol(s.ac[k]), 16)
                            if not n and r < 15:
                                eob = (1 << r) + take(r)
                                break
                            sign = take(1) if n else 0
                            while i <= hi:
                                if z[i]:
                                    fix(i)
                                elif r == 0:
                                    break
                                else:
                                    r -= 1
                                i += 1
                            if n and i <= hi:
                                z[i] = (1 << s.al) if sign else -(1 << s.al)
                            i += 1
                        if eob:
                            for j in range(i, hi + 1):
                                if z[j]:
                                    fix(j)
                            eob -= 1
    return out


def test_jpeg_round_trip_and_slow_decoder():
    rng = np.random.default_rng(3)
    payloads = []
    for n in (1, 6, 7, 23):
        p = rng.integers(0, 256, n * 64, dtype=np.uint8)
        p[rng.random(len(p)) < 0.6] = 128
        p[rng.random(len(p)) < 0.1] = 32
        p[rng.random(len(p)) < 0.1] = 101
        payloads.append(p.tobytes())
    files = jpeg.encode(payloads, [len(p) for p in payloads])
    images, all_blocks, bases = jpeg.decode_coefficients(files)
    for f, p, base, image, rgb in zip(files, payloads, bases, images, jpeg.tensors(images, all_blocks, bases), strict=True):
        assert jpeg.TO_BYTE[all_blocks[base[0] : base[0] + len(p) // 64] + 256].tobytes() == p
        slow = _slow_decode(f)
        for b, component in zip(base, slow, strict=True):
            assert (all_blocks[b : b + len(component)] == component).all()
        assert rgb.shape == (image.height, image.width, 3)


def _slow_rgb(image, coefficients):
    """(height, width, 3) pixel by pixel: inverse cosine sums in doubles, chroma repeated, JFIF conversion."""
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    planes = []
    for (down, across, _, _), own in zip(image.grids(), coefficients, strict=True):
        plane = np.zeros((down * 8, across * 8), int)
        for b, z in enumerate(own):
            for y in range(8):
                for x in range(8):
                    total = sum(c(u) * c(v) / 4 * int(z[k]) * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for k, (u, v) in enumerate(zigzag))
                    plane[b // across * 8 + y, b % across * 8 + x] = min(255, max(0, math.floor(total + 128.5 + 1e-7)))
        planes.append(plane)
    out = np.zeros((image.height, image.width, 3), int)
    for y in range(image.height):
        for x in range(image.width):
            (luma, cb, cr) = (int(p[y * p.shape[0] // planes[0].shape[0], x * p.shape[1] // planes[0].shape[1]]) for p in planes)
            rgb = (luma + 1.402 * (cr - 128), luma - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), luma + 1.772 * (cb - 128))
            out[y, x] = [min(255, max(0, round(v))) for v in rgb]
    return out


def test_stored_tensor_equals_a_slow_decode(spark):
    rows = [(1, "Short text, twenty-seven bytes"), (2, "é" * 300 + " " + "Zx9!" * 40), (3, "")]
    for r in media.read_media(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        image = jpeg.parse(bytes(r.media))
        slow = _slow_rgb(image, _slow_decode(bytes(r.media)))
        got = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3).astype(int)
        assert np.abs(got - slow).max() <= 1 and (got == slow).mean() > 0.99


def test_correction_passes_that_find_new_coefficients():
    """Coefficients of 1 and -1, which our bytes never make, through the general correction pass."""
    rng = np.random.default_rng(9)
    v = rng.choice(np.array([0, 0, 0, 1, -1, 2, -3, 7], np.int16), (40, 63))
    v[3], v[7, 5:], v[8, :40] = 0, 0, 0
    data, first = jpeg._pack_bits(*(i := jpeg._fix_items(v, 0))[:2], np.add.reduceat(i[2], np.arange(0, 40, 4)))
    data, _ = jpeg._marked(data, first, np.zeros(10, int), np.arange(10), 1)
    raw = np.append(data, [255, 217]).astype(np.uint8)
    out = np.zeros((40, 64), np.int16)
    out[:, 1:] = np.sign(v) * (np.abs(v) >> 1) << 1
    scan = jpeg.Scan([0], [None], [jpeg.FIX_CODE], (1, 63), 1, 0, 4, 0, len(data))
    image = jpeg.Image(scans=[scan], sampling=[(1, 1)])
    jpeg._decode_scan(jpeg._Bits(raw), jpeg.markers(raw)[1], [image], 0, np.arange(40)[:, None], np.array([40]), out)
    assert (out[:, 1:] == v).all()


def test_jpeg_basis_is_the_inverse_dct():
    x = np.zeros((1, 64))
    x[0, 0] = 80
    assert np.allclose(x @ jpeg.BASIS, 10)
    assert np.allclose(jpeg.BASIS @ jpeg.BASIS.T, np.eye(64))


def test_media_rows(spark):
    rows = registry.QUERIES["op4_media_columns"](spark, SF).collect()
    for r in rows:
        raw = (texts_cache(spark)[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    stored = media.store_texts(X.docs(spark, clash=True))
    back = media.read_media(stored.unionByName(stored.limit(1).withColumn("media", stored.media.substr(1, 0).cast("binary")))).collect()
    assert len(back) == len(X.DOCS) + 1 and sum(r.payload is None for r in back) == 1
    assert all(len(r.rgb) == r.height * r.width * 3 for r in back if r.rgb)
    same = [(r.media, r.feature) for r in back if r.doc_id in (1, 5) and r.payload]
    assert len(same) >= 3 and len(set(same)) == 1
    assert media.read_media(media.store_texts(X.docs(spark, empty=True))).count() == 0


_cache = {}


def texts_cache(spark):
    if not _cache:
        _cache.update(texts(spark))
    return _cache


# op5


def test_mix_awkward_rows(spark):
    rows = mixing.mix_sources(X.docs(spark, clash=True)).collect()
    assert len(rows) == len(X.DOCS) and all(r.taken <= 3 * r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(X.docs(spark).repartition(3)).collect()))
    assert mixing.mix_sources(X.docs(spark, empty=True)).count() == 0


def test_repeating_agrees_with_the_mix(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(X.docs(spark).where("doc_id is null or doc_id = 2"))
    wanted = Counter()
    for r in mixing.mix_sources(df).collect():
        wanted[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.repeat_by_mix(df).collect())
    assert got == +wanted and len(set(wanted.values())) > 1


def test_tied_rows_enter_one_by_one(spark):
    """Equal rows without ids: both forms of the mix take words within half a document of the target."""
    rows = [(None, "two words", "en", "a", 9)] * 40 + [(k, " ".join(["w"] * 60), "en", "b", 1) for k in range(4)] + [(None, f"x{k} y", "en", "c", 1) for k in range(30)]
    df = spark.createDataFrame(rows, X.SCHEMA).selectExpr("*", "1L as size", "'k' as key", "0.5 as quality")
    mixed = mixing.mix_sources(df).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    repeated = {r.source: sum(map(len, (x.text.split() for x in mixing.repeat_by_mix(df).where(F.col("source") == r.source).collect()))) for r in mixed}
    for r in mixed:
        assert abs(r.taken - r.target) <= (30 if r.source == "b" else 1) and repeated[r.source] == r.taken
    drawn = {r.key for r in mixing.mix_sources(df.where("source = 'c'")).collect()}
    assert len(drawn) == 30
    best = mixing.mix_sources(df.withColumn("score", F.when(F.col("text").startswith("x1 "), 1e9).otherwise(1e-3)).where("source = 'c'"), quality=F.col("score"))
    assert best.orderBy("key").first().key == best.agg(F.min("key")).first()[0]


# op6 and op10


def _accuracy(spark, name, column):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES[name](spark, folder).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return sum(r.predicted == labels[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    assert _accuracy(spark, "op6_toxicity", "toxic") > 0.93


def test_quality_held_out(spark):
    assert _accuracy(spark, "op10_quality_rules", "quality") > 0.97


def test_machine_learns_a_pair(spark):
    """Label 1 only where exactly one of two terms is there: no term alone tells anything, additive weights cannot tell."""
    rng = np.random.default_rng(5)
    one, two = rng.integers(0, 2, (2, 1500))
    rows = [(k, " ".join([*(["insult"] if a else []), *(["group"] if b else []), *(f"w{w}" for w in rng.integers(0, 20000, 30))])) for k, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(a ^ b)) for k, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True))], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    fresh = [(0, "nothing here"), (1, "an insult"), (2, "some group"), (3, "insult of a group")]
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert score[0] < 0.5 < score[1] and score[3] < 0.5 < score[2]


def test_one_path_at_every_size(spark):
    """All terms of all rows are in the machine, on a few and on thousands of rows, and it tells what it was not shown."""
    from zlib import crc32

    for sf, least in (("sf0.01", 0.93), ("sf0.1", 0.97)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
        model = toxicity.fit_toxicity(docs, labels.where(~held))
        shown = toxicity.labelled_sample(docs, labels.where(~held), "toxic", 20_000).mapInArrow(toxicity._list_terms, "label double, terms array<int>")
        assert set(model.terms.tolist()) == {r.t for r in shown.select(F.explode("terms").alias("t")).distinct().collect()}
        told = {r.doc_id: r.toxic for r in labels.collect()}
        scored = [r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect() if r.doc_id in told and crc32(str(r.doc_id).encode()) % 5 == 0]
        assert sum((r.score >= 0.5) == told[r.doc_id] for r in scored) / len(scored) > least


def test_the_sample_is_bounded_in_terms(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert 500 < len(toxicity.fit_toxicity(docs, labels, max_pairs=1000).terms) <= 1000 < len(toxicity.fit_toxicity(docs, labels).terms)


def test_scores_equal_brute_force(spark):
    """The query's scores against the machine written out over Python sets of terms."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(60)
    model = toxicity.fit_toxicity(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    import pyarrow as pa

    code = lambda w: int(toxicity.hashed_terms(pa.array([w]))[0][0])
    for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect():
        text, raw = texts(spark, "/root/testdata/sf0.01")[r.doc_id] or "", model.bias
        found = set()
        for w in X.words(text):
            for _ in range(3):
                w = w[:-1] if len(w.encode()) > 1 and w[-1] in ".,;:!?\"')" else w
            found |= {int(t) for t in toxicity.hashed_terms(pa.array([w]))[0]}
        at = [k for k, t in enumerate(model.terms) if t in found]
        raw += model.weights[at].sum() + np.triu(model.factors[at] @ model.factors[at].T, 1).sum()  # every pair once
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)
    assert code("über") != code("uber") and len(toxicity.hashed_terms(pa.array(["ééé", "abcdé"]))[0]) == 4


def test_rules_equal_brute_force(spark):
    """op10's column against its rules evaluated in Python over the statistics."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.rules
    stats = quality.statistics(F.col("text"))
    wide = docs.select("doc_id", *(c.cast("double").alias(n) for n, c in stats.items())).collect()
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for r in wide:
        raw = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((r[n] > cut) if above else (r[n] <= cut) for n, above, cut in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-12)


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(90)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", 2).count() == 2


@pytest.mark.parametrize(("fit", "score", "column"), [(toxicity.fit_toxicity, toxicity.score_toxicity, "toxic"), (quality.fit_quality, quality.score_quality, "quality")])
def test_classifiers_awkward_rows(spark, fit, score, column):
    df = X.docs(spark, clash=True)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1), (7, None), (1, 1)], f"doc_id long, {column} int")
    for model in (fit(df, labels), fit(df, labels.limit(0)), fit(df.limit(0), labels)):
        for given in (df, df.withColumn("_stats", F.lit(1)), df.select("doc_id", "text")):
            rows = score(given, model).collect()
            assert len(rows) == len(X.DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("name", ["op1_katz_scores", "op6_toxicity", "op10_quality_rules"])
def test_a_null_id_is_not_held_out(spark, tmp_path, name):
    X.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == len(X.DOCS) and [r.held_out for r in rows if r.doc_id is None] == [False]


def test_rules_are_sparse(spark):
    rng = np.random.default_rng(6)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.5)).astype(float)
    rules = quality.tree_rules(x, y, ["a", "b", "c"], trees=20)
    bias, w = quality.lasso_logistic(quality.rule_matrix(x, ["a", "b", "c"], rules), y)
    raw = bias + quality.rule_matrix(x, ["a", "b", "c"], rules) @ w
    assert ((raw > 0) == y).mean() > 0.97 and (np.abs(w) > 1e-6).sum() < len(rules) / 3


# op7


def test_fingerprints_and_groups(spark):
    rows = registry.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()
    codes = [int(r.fingerprint, 16) for r in rows]
    for r in rows[:20]:
        w = X.words(texts_cache(spark)[r.doc_id])
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) and hashes)
    for g in X.groups(len(rows), lambda i, j: bin(codes[i] ^ codes[j]).count("1") <= 2):
        assert {rows[i].component_id for i in g} == {min(rows[i].doc_id for i in g)}


def test_links_of_a_dense_family(spark):
    """One family larger than a tile, whose members share blocks: sliced, and still one component per true group."""
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    codes = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            flips = rng.choice(12, rng.integers(1, 4), replace=False)
            codes.add(int(c) ^ sum(1 << int(b) for b in flips))
    codes = sorted(codes | {int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)})
    df = spark.createDataFrame([(k, np.uint64(c).astype(np.int64).item()) for k, c in enumerate(codes)], "k long, code long")
    edges = simhash.fingerprint_links(df.select("code"), 2, tile=16)
    comp = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    signed = [np.uint64(c).astype(np.int64).item() for c in codes]
    for g in X.groups(len(codes), lambda i, j: bin(codes[i] ^ codes[j]).count("1") <= 2):
        assert len({comp.get(signed[i], signed[i]) for i in g}) == 1
    assert len({comp.get(s, s) for s in signed}) == len(X.groups(len(codes), lambda i, j: bin(codes[i] ^ codes[j]).count("1") <= 2))


def test_simhash_awkward_rows(spark):
    rows = simhash.simhash_groups(X.docs(spark, clash=True)).collect()
    assert len(rows) == len(X.DOCS)
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1} and {r.fingerprint for r in rows if r.doc_id in (2, 3, 8)} == {"0" * 16}
    assert simhash.simhash_groups(X.docs(spark, empty=True)).count() == 0


# op8

BASE = [("assign", re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 6, 1), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def test_secrets_base(spark):
    cases = [(k, t) for k, t in texts(spark, "/root/testdata/sf0.01").items()] + [(-1, "secret:token:abcdefgh PASSWORD = 'abcdef' api_key=\"x\" AKIAAKIA" + "A" * 16), (-2, "ſecret=abcdefgh 你好 token: " + "0" * 30)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    for r in secrets.find_secrets(df).collect():
        text = dict(cases)[r.doc_id] or ""
        wanted = sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least)
        assert [tuple(s) for s in r.base] == wanted


def test_secret_counts_of_the_query(spark, tmp_path):
    key, run = "AKIA" + "Q7" * 9, "0f" * 13
    rows = [(1, f"{run} {run} {key}"), (2, f"token=abcdef {key} password: 123456 {run}"), (3, f"{key} {key} {key}"), (4, None), (5, "secret=abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.op8_secret_scan(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        found = sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least)
        named = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
        assert got[doc_id] == (*(sum(k == kind for _, k, _ in found) for kind in range(3)), hashlib.sha256(named.encode()).hexdigest())


def test_weak_parts_need_a_complement(spark):
    key = "Ab1" + "Zx9" * 12
    rows = [(1, f"user: alice77 then {key}"), (2, f"only {key} here"), (3, "https://h.example/x"), (4, f"https://h.example/x {key}"), (5, "login=bob1234 " + "." * 500 + key), (6, None), (7, "")]
    got = {r.doc_id: [secrets.KINDS[s.kind] for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["ident", "bare"], 2: [], 3: [], 4: ["endpoint", "bare"], 5: [], 6: [], 7: []}
    masked = {r.doc_id: r.text for r in secrets.mask_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[1] == "[SECRET] then [SECRET]" and masked[2] == rows[1][1] and masked[6] is None
    assert secrets.find_secrets(X.docs(spark, clash=True)).count() == len(X.DOCS) and secrets.find_secrets(X.docs(spark, empty=True)).count() == 0


def test_many_parts_of_one_long_text():
    text = " ".join(f"token=k{'x' * 20}{k} aB3{'Zx9' * 12}{k}" for k in range(20000))
    parts = secrets.text_parts(text)
    assert sum(k == 0 for _, k, _ in parts) == 20000 and sum(k == 4 for _, k, _ in parts) == 20000


def test_long_parts_link_by_the_gap_between_them(spark):
    key, long = "Ab1" + "Zx9" * 12, "aB3/" * 200
    rows = [(1, f"login=bob1234 {long}=="), (2, "https://h.example/" + "p" * 900 + " " + key), (3, "token=" + "x" * 700 + "- login=bob1234"), (4, f"login=bob1234 {'.' * 238}{key}"), (5, f"login=bob1234 {'.' * 240}{key}"), (6, long),
            (7, f"{long} {'.' * 200} https://h.example/" + "p" * 900 + " " + key)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [secrets.KINDS[s.kind] for s in r.spans] for r in secrets.find_secrets(df).collect()}
    assert got == {1: ["ident", "bare"], 2: ["endpoint", "bare"], 3: ["assign", "ident"], 4: ["ident", "bare"], 5: [], 6: [], 7: ["bare", "endpoint", "bare"]}
    masked = {r.doc_id: r.text for r in secrets.mask_spans(df).collect()}
    assert masked[1] == masked[2] == "[SECRET] [SECRET]" and masked[6] == long


def test_linked_parts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    pieces = [lambda n: "login=" + "u" * (3 + n), lambda n: "aB3" * (11 + n), lambda n: "token=" + "k" * (6 + n), lambda n: "https://h.example/" + "p" * n, lambda n: "." * n]
    rows = [(k, " ".join(pieces[int(rng.integers(5))](int(rng.choice([0, 30, 200, 230, 700]))) for _ in range(9))) for k in range(150)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in found}
    links = {r.doc_id: [(tuple(p.secret), tuple(p.other)) for p in r.links] for r in found}
    for k, text in rows:
        parts = secrets.text_parts(text)
        pair = lambda p, o: (secrets.ROLES[p[1]] == "secret") != (secrets.ROLES[o[1]] == "secret") and p[0] - o[2] <= 240 and o[0] - p[2] <= 240
        assert got[k] == {p for p in parts if p[1] < 3 or any(pair(p, o) for o in parts)}
        assert links[k] == sorted((p, o) for p in parts for o in parts if secrets.ROLES[p[1]] == "secret" and pair(p, o))


# op9


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path("word_bpe_49k.json"))
    extra = "It's don't I'M. a<|endoftext|>B. …. é. 12.5. 3,000 ñ?!. ...... İ. 你好。 🙂🙂!! x\u0085y"
    cases = [*texts_cache(spark).items(), (-1, extra), (-2, None), (-3, ""), (-4, X.LONG), (-4, X.LONG)]
    rows = packing.pack_documents(spark.createDataFrame(cases, "doc_id long, text string")).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece].append(r)
    n = 0
    for k, text in cases:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            piece = np.array(ids[p : p + 4096], "<u4")
            r = found[k, p // 4096][0]
            assert (r.start, r.length, r.ids_crc32) == (p, len(piece), zlib.crc32(piece.tobytes()))
            n += 1
    assert n == len(rows)
    for s in _sequences(rows).values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 4096
    assert len(_sequences(rows)) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(X.docs(spark, empty=True)).count() == 0
    clashing = X.docs(spark, clash=True).selectExpr("*", "1L as rank", "2 as piece", "3L as sequence_id", "4 as slice")
    assert packing.pack_documents(clashing).where("piece = 0").count() == len(X.DOCS)


def _sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return out


def test_plan_takes_every_rank_once():
    rng = np.random.default_rng(8)
    counts = {int(k): int(rng.integers(1, 200)) for k in rng.choice(np.arange(1, 101), 60, replace=False)}
    used, taken = defaultdict(int), Counter()
    for length, low, high, first, each, begin in sorted(packing.plan_slots(counts, 100), key=lambda s: s[5]):
        taken[length] += high - low
        for t in range(high - low):
            assert begin + (t % each) * length == used[first + t // each]
            used[first + t // each] += length
    assert taken == Counter(counts) and max(used.values()) <= 100
    assert len(used) <= math.ceil(sum(k * n for k, n in counts.items()) / 100) * 1.05 + 1


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in seen["toxicity"].select("doc_id").collect()}
    assert len(toxic & kept) <= 0.05 * len(toxic) and len(clean & kept) >= 0.99 * len(clean)
    texts_ = [r.text for r in seen["secret_scan"].select("text").collect()]
    assert not any(re.search("AKIA[A-Z0-9]{16}", t or "") for t in texts_)
    once = [r.doc_id for r in seen["simhash_near_dedup"].select("doc_id").collect()]
    assert len(once) == len(set(once))
    most = Counter(r.doc_id for r in seen["mix_sources"].select("doc_id").collect())
    assert max(most.values()) <= 3
    packed = seen["best_fit_packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == most
    for df in seen.values():
        df.unpersist()


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k * k}" for k in range(400)) for x in "abc")
    rows = [(1, a), (1, b), (1, a + " end"), (1, b), (2, b), (3, c), (3, None), (4, c), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], X.SCHEMA)
    fingerprints = {t: simhash.text_fingerprint(t) for _, t in rows}
    assert (fingerprints[a] ^ fingerprints[a + " end"]).bit_count() <= 2
    for n in (1, 3, 7):
        kept = corpus_pipeline.drop_near_copies(spark, df.repartition(n), SF).collect()
        found = Counter((r.doc_id, r.text if r.text is None else r.text[0]) for r in kept)
        assert found == {(1, "a"): 1, (1, "b"): 1, (3, "c"): 1, (3, None): 1, (None, "a"): 2}
        assert n == 1 or {r.text for r in kept} == before
        before = {r.text for r in kept}


def test_pipeline_awkward_rows(spark, tmp_path):
    """Null, empty, long, repeated and clashing rows through every stage, then no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = "Ab1" + "Zx9" * 12
    more = spark.createDataFrame([(20, f"user: alice77 then {key}", "en", "a", 1), (21, f"user: alice78 then {key}", None, None, None)], X.SCHEMA)
    docs, seen = X.docs(spark).unionByName(more).selectExpr("*", *(f"cast(null as {t.split()[1]}) as {t.split()[0]}" for t in X.CLASH.split(", "))), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == corpus_pipeline.COLUMNS
    assert len(seen["toxicity"]) == len(X.DOCS) + 2
    assert Counter(r.doc_id for r in seen["simhash_near_dedup"])[5] == 0 and {1, 2, 4, 7, 9, 20, None} <= {r.doc_id for r in seen["simhash_near_dedup"]}
    masked = {r.doc_id: r for r in seen["secret_scan"]}
    assert masked[20].text == "[SECRET] then [SECRET]" and masked[20].n_chars == 22 and masked[2].text is None
    assert Counter(r.doc_id for r in seen["best_fit_packing"] if r.piece == 0) == Counter(r.doc_id for r in seen["mix_sources"])
    empty = X.docs(spark, empty=True)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_many_equal_rows_in_slices(spark):
    """A hundred thousand rows equal in everything, without ids: packed and mixed in slices of about equal size."""
    from assayer.llm.slices import ranked

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'same words' as text", "'en' as lang", "'s' as source", "1L as n_chars").repartition(8)
    other = spark.createDataFrame([(1, "one other document", "en", None, 3)], schema)
    packed = packing.pack_documents(df)
    counts = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("sum"))
    assert counts.where("end <> sum or end > 4096").count() == 0 and packed.count() == 100_000
    numbered = df.withColumn("number", F.monotonically_increasing_id())
    ranks = ranked(numbered, "source", ["number"], 64)
    assert sorted(r["rank"] for r in ranks.select("rank").collect()) == list(range(100_000))
    sizes = [r["count"] for r in numbered.groupBy(F.pmod(F.xxhash64("number"), F.lit(64))).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 1.3 * 100_000 / 64
    mixed = mixing.repeat_by_mix(df.unionByName(other))
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    planned = mixing.mix_sources(df.unionByName(other)).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert taken == {r.doc_id: r.n for r in planned.collect()}


def test_slices_meet_from_the_top(spark, monkeypatch):
    """A block of 10^5 fingerprints in 2,000 slices: the meetings are those of all pairs, of which the tree makes a third and keeps a thirteenth."""
    rng = np.random.default_rng(12)
    code = np.unique(rng.integers(0, 1 << 43, 100_000, dtype=np.uint64))
    code = code[np.argsort(simhash.gray_rank(code))]
    at = np.arange(0, len(code), 50)
    every, some = np.bitwise_and.reduceat(code, at), np.bitwise_or.reduceat(code, at)
    rows = [(0, 5, k, int(e), int(s)) for k, (e, s) in enumerate(zip(every, some, strict=True))] + [(1, 5, 0, 3, 7), (1, 5, 1, 2**40, 2**40), (1, 5, 2, 7, 7), (2, 5, 0, 1, 1)]
    made, plain = [], simhash.stored

    def counted(df, what):
        out = plain(df, what)
        if what == "meetings":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    met = simhash.slice_meetings(spark.createDataFrame(rows, "turn int, block long, number long, every long, some long"), 2).collect()
    loose = (every ^ some)[:, None] | (every ^ some)[None, :]
    near = np.bitwise_count((every[:, None] ^ every[None, :]) & ~loose) <= 2
    i, j = np.nonzero(np.triu(near))
    assert {(r.number_a, r.number_b) for r in met if r.turn == 0} == set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(r.number_a, r.number_b) for r in met if r.turn == 1} == {(0, 0), (0, 2), (1, 1), (2, 2)} and sum(r.turn == 2 for r in met) == 1
    all_pairs, tried = len(every) * (len(every) + 1) // 2, 64 * sum(made[:-1])
    assert len(made) == 4 and tried < 0.4 * all_pairs and made[-1] < 0.1 * all_pairs


def test_a_worker_reads_its_vocabulary_once(monkeypatch):
    import pyarrow as pa

    read = []

    class Counted(packing.WordTokenizer):
        def __init__(self, path):
            read.append(path)
            super().__init__(path)

    monkeypatch.setattr(packing, "WordTokenizer", Counted)
    if hasattr(packing, "_tokenizer"):
        packing._tokenizer.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", None])], ["doc_id", "text"])
    tasks = [[b.to_pylist() for b in packing._piece_batches(None, 4096, 1)(iter([batch]))] for _ in range(5)]
    assert len(read) == 1 and all(t == tasks[0] for t in tasks)

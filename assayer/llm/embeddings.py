"""Embedding near-duplicates by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.components import connected_components
from assayer.llm.scratch import stored, table
from assayer.llm.simhash import star_edges

#: Vectors in a block, and room for the rounding of double sums in the bound.
BLOCK, SLACK = 1024, 1e-9
TILE = ["label", "width", "low", "high"]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows x as (int8 codes, scale, norm of scale * code, norm of x - scale * code)."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.rint(x / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile_bands(a: tuple, b: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) from quantised rows: the pairs that may reach the threshold; sure where they must. If same, each pair once.

    |x.y - s t p.q| <= |s p| |f| + |e| |t q| + |e| |f| for x = s p + e, y = t q + f. The product of int8 codes is exact:
    in single precision up to 1,024 components, in double beyond.
    """
    (p, s, pn, pe), (q, t, qn, qe) = a, b
    kind = np.float32 if p.shape[1] <= 1024 else np.float64
    right = q.astype(kind).T
    for k in range(0, len(p), 256):
        rows = slice(k, k + 256)
        product = (p[rows].astype(kind) @ right).astype(np.float64) * (s[rows, None] * t)
        error = pn[rows, None] * qe + pe[rows, None] * (qn + qe) + SLACK
        i, j = np.nonzero(product + error >= threshold)
        if same:
            later = j > i + k
            i, j = i[later], j[later]
        yield i + k, j, (product[i, j] - error[i, j]) >= threshold


def _sides(blocks: pd.DataFrame, count: str) -> list[tuple]:
    out = []
    for r in blocks.sort_values("block").itertuples():
        n = getattr(r, count)
        out.append((np.frombuffer(r.ids, "<i8"), np.frombuffer(r.copies, "<i8"), (np.frombuffer(r.codes, np.int8).reshape(n, -1), *np.frombuffer(r.norms, "<f8").reshape(3, n))))
    return out


def _counted(pairs: Iterator[tuple[np.ndarray, np.ndarray]], copies: np.ndarray, links: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in pairs:
        links += np.bincount(i, copies[j], len(copies)).astype(np.int64) + np.bincount(j, copies[i], len(copies)).astype(np.int64)
        yield i, j


def _link_tile(threshold: float):
    """Per tile and node with a link or an open pair: links that int8 settles, the first node of its group, whether a pair is open."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(blocks, "rows")
        same = len(sides) == 1
        shift = 0 if same else len(sides[0][0])
        ids, copies = (sides[0][k] if same else np.concatenate([sides[0][k], sides[1][k]]) for k in (0, 1))
        links, open_ = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)

        def sure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, known in tile_bands(sides[0][2], sides[-1][2], threshold, same):
                open_[i[~known]] = open_[j[~known] + shift] = True
                yield i[known], j[known] + shift

        a, b = star_edges(len(ids), _counted(sure(), copies, links))
        root = np.arange(len(ids))
        root[a] = b
        hit = (links > 0) | open_
        tile = {name: pd.Series([value] * int(hit.sum()), dtype=object) for name, value in zip(TILE, key, strict=True)}
        return pd.DataFrame(tile | {"id": ids[hit], "links": links[hit], "root": ids[root[hit]], "open": open_[hit]})

    return run


def _settle_tile(threshold: float, kind: str):
    """The open pairs of a tile, in doubles: the nodes that have one come with their vectors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "node"])
        raw = np.stack(rows["embedding"].to_numpy()).astype(kind).astype(np.float64)
        ids, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
        unit = raw / np.linalg.norm(raw, axis=1)[:, None]
        left = np.flatnonzero(block == rows["low"].iloc[0])
        right = np.flatnonzero(block == rows["high"].iloc[0])
        same = rows["low"].iloc[0] == rows["high"].iloc[0]
        codes = quantise(unit)
        links = np.zeros(len(ids), np.int64)

        def exact() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, known in tile_bands(tuple(x[left] for x in codes), tuple(x[right] for x in codes), threshold, same):
                i, j = left[i[~known]], right[j[~known]]
                for m in range(0, len(i), 65536):
                    u, v = i[m : m + 65536], j[m : m + 65536]
                    reach = np.einsum("nd,nd->n", unit[u], unit[v]) >= threshold
                    yield u[reach], v[reach]

        a, b = star_edges(len(ids), _counted(exact(), copies, links))
        root = np.arange(len(ids))
        root[a] = b
        hit = links > 0
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    return run


def _pack_block(kind: str):
    """A block quantised once, by node, as it is met again in doubles: int8 codes, and scale and the two norms per vector."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        raw = np.stack(rows["embedding"].to_numpy()).astype(kind).astype(np.float64)
        codes, *norms = quantise(raw / np.linalg.norm(raw, axis=1)[:, None])
        first = {c: rows[c].iloc[:1] for c in ("label", "width", "block", "blocks")}
        return pd.DataFrame(first | {"rows": [len(rows)], "ids": [rows["node"].to_numpy("<i8").tobytes()], "copies": [rows["copies"].to_numpy("<i8").tobytes()], "codes": [codes.tobytes()], "norms": [np.stack(norms).astype("<f8").tobytes()]})

    return run


def link_embeddings(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their embeddings have equal length and a cosine of at least
    threshold in double precision. Null, empty and zero embeddings and those with null or non-finite components link
    with nothing. Equal embeddings of one label become one node with a number of copies. A label's nodes are dealt by
    hash into blocks of about `block`, quantised there once; every two blocks of a label meet in one task of fixed size
    as int8 codes with their error norms, which settle nearly all pairs. Only nodes with an open pair come again, with
    their vectors, to be multiplied in doubles. Tasks return link counts and one edge per linked node, so neither a
    large label nor a large group of copies lands in one task.
    vec_id identifies rows; of rows that repeat it each has its own links and component, as its embedding and label
    have. Null vec_ids get null components but count as links. An empty table gives an empty result; other columns have
    no effect.
    """
    real = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    element, kind = ("float", "<f4") if real else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    marked = stored(rows.withColumn("good", good).withColumn("embedding", F.when(F.col("good"), F.transform("embedding", lambda v: v + F.lit(0.0).cast(element)))), "vectors")
    nodes = marked.where("good").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low")).withColumn("width", F.size("embedding"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = nodes.drop("low").join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kinds = "label string, width int, block int, blocks int, rows int, ids binary, copies binary, codes binary, norms binary"
    packed = stored(dealt.groupBy("label", "width", "block").applyInPandas(_pack_block(kind), kinds), "packed")
    meet = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    tiles = stored(meet.groupBy(*TILE).applyInPandas(_link_tile(threshold), "label string, width int, low int, high int, id long, links long, root long, open boolean"), "tiles")
    again = tiles.where("open").select("low", "high", F.col("id").alias("node")).join(dealt, "node")
    settled = again.groupBy(*TILE).applyInPandas(_settle_tile(threshold, kind), "id long, links long, root long")
    found = stored(tiles.where("links > 0").select("id", "links", "root").unionAll(settled), "links")
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    linked = stored(connected_components(found.where("id <> root"), "id", "root"), "components")
    known = nodes.select("node", "copies", "low", "label", "embedding")
    known = known.join(counts, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "known")
    firsts = known.groupBy("component").agg(F.min("low").alias("component_id"))
    of = known.join(firsts, "component").select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    of = stored(of, "results")
    out = marked.join(of, F.col("good") & (marked.label == of.l) & (marked.embedding == of.e), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM embeddings v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""

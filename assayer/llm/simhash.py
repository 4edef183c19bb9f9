"""SimHash near-duplicates linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.components import connected_components
from assayer.llm.scratch import stored, table

FAN = 8
#: Slices of a node above them, nodes of one further up.
UPPER_FAN = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text over word shingles, repeats included; no word: zero."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: 1 - shingle].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    end = end[shingle - 1 :].tolist()
    for k in range(0, len(start), 16384):  # a very long text needs no more memory than a long one
        hashes = np.array([digest(line[s:e], seed) for s, e in zip(start[k : k + 16384], end[k : k + 16384], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(start), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((text_fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), *batch.columns[2:]], ["doc_id", "code", *batch.schema.names[2:]])

    return run


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code word in the binary-reflected Gray sequence (a prefix XOR of its bits)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(shift))
    return code


def _levels(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level (bits set in all, bits set in any) of each node; level 0 holds the fingerprints."""
    levels = [(code, code)]
    while len(levels[-1][0]) > 1:
        every, some = levels[-1]
        at = np.arange(0, len(every), FAN)
        levels.append((np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)))
    return levels


def close_pairs(a: np.ndarray, b: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within `bits` bits: of a and b, or within a if b is None.

    Both sides are in Gray order, so neighbours share long bit patterns. A node keeps the bits that all below it
    share; two nodes that differ in more than `bits` shared bits are dropped with everything below them.
    """
    if not len(a) or b is not None and not len(b):
        return
    one, two = _levels(a), _levels(a if b is None else b)
    top = max(len(one), len(two)) - 1
    for tree in (one, two):
        tree.extend([tree[-1]] * (top + 1 - len(tree)))
    work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        level, i, j = work.pop()
        (all_i, any_i), (all_j, any_j) = one[level], two[level]
        shared = ~((any_i[i] ^ all_i[i]) | (any_j[j] ^ all_j[j]))
        near = np.bitwise_count((all_i[i] ^ all_j[j]) & shared) <= bits
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level == 0:
            keep = i < j if b is None else slice(None)
            yield i[keep], j[keep]
            continue
        below_i, below_j = len(one[level - 1][0]), len(two[level - 1][0])
        fan_i, fan_j = (1 if len(t[level][0]) == len(t[level - 1][0]) == 1 else FAN for t in (one, two))
        ci = (i[:, None] * fan_i + np.repeat(np.arange(fan_i), fan_j)).ravel()
        cj = (j[:, None] * fan_j + np.tile(np.arange(fan_j), fan_i)).ravel()
        keep = (ci < below_i) & (cj < below_j) & ((ci <= cj) if b is None else True)
        ci, cj = ci[keep], cj[keep]
        work += [(level - 1, ci[k : k + 65536], cj[k : k + 65536]) for k in range(0, len(ci), 65536)]


def star_edges(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A few edges (each node and its group's first node) with the same components as all the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while (root != root[root]).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _cuts(bits: int) -> list[tuple[int, int]]:
    """(start, width) of bits + 1 blocks that cut 64 bits, none in two blocks."""
    at = [-(-64 * t // (bits + 1)) for t in range(bits + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _gray_order(code: np.ndarray, turn: int, bits: int) -> np.ndarray:
    shift = np.uint64(_cuts(bits)[turn][0])
    return np.argsort(gray_rank((code << shift) | (code >> (np.uint64(64) - shift)) if shift else code), kind="stable")


def gray_column(code: Column, start: int) -> Column:
    """gray_rank of code turned left by `start` bits, as a number whose unsigned order is the Gray order."""
    turned = F.shiftleft(code, start).bitwiseOR(F.shiftrightunsigned(code, 64 - start)) if start else code
    for shift in (1, 2, 4, 8, 16, 32):
        turned = turned.bitwiseXOR(F.shiftrightunsigned(turned, shift))
    return turned


def _link_tile(bits: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        found = []
        for turn, rows in tile.groupby("turn", sort=True):
            code = rows["code"].to_numpy().view(np.uint64)
            side = rows["side"].to_numpy()
            order = _gray_order(code, turn, bits)
            code, side = code[order], side[order]
            if (side == 0).all():
                a, b = star_edges(len(code), close_pairs(code, None, bits))
            else:
                left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
                pairs = ((left[i], right[j]) for i, j in close_pairs(code[left], code[right], bits))
                a, b = star_edges(len(code), pairs)
            found.append(pd.DataFrame({"a": code[a].view(np.int64), "b": code[b].view(np.int64)}))
        return pd.concat(found)

    return run


def _nodes(level: DataFrame, side: str) -> DataFrame:
    return level.select("turn", "block", F.floor(F.col("number") / UPPER_FAN).cast("long").alias(f"up_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("number", "every", "some")))


def slice_meetings(slices: DataFrame, bits: int) -> DataFrame:
    """(turn, block, number_a, number_b), a <= b: the slices of a block between which a link may lie.

    slices (turn, block, number, every, some): numbers 0, 1, ... in Gray order, the bits set in all and in any of a slice's
    members. Above them stand groups of UPPER_FAN neighbours, then groups of groups, each with the bits that all below share.
    Pairs are met from the top: two nodes that differ in more than `bits` shared bits go with everything below them, so
    most pairs of slices are never made. A level is one job; pairs of a level are joined with their children only.
    """
    levels = [slices]
    most = slices.agg(F.max("number")).first()[0] or 0
    while most >= UPPER_FAN:
        most //= UPPER_FAN
        up = F.floor(F.col("number") / UPPER_FAN).cast("long").alias("number")
        levels.append(stored(levels[-1].groupBy("turn", "block", up).agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some")), "upper"))
    loose = F.col("every_a").bitwiseXOR(F.col("some_a")).bitwiseOR(F.col("every_b").bitwiseXOR(F.col("some_b")))
    apart = F.bit_count(F.col("every_a").bitwiseXOR(F.col("every_b")).bitwiseAND(F.bitwise_not(loose)))
    near = (F.col("number_a") <= F.col("number_b")) & (apart <= bits)
    met = None
    for level in reversed(levels):
        a, b = _nodes(level, "a"), _nodes(level, "b")
        if met is None:  # at most UPPER_FAN nodes of a block
            pairs = a.join(b, ["turn", "block"])
        else:
            above = met.withColumnsRenamed({"number_a": "up_a", "number_b": "up_b"})
            pairs = above.join(a, ["turn", "block", "up_a"]).join(b, ["turn", "block", "up_b"])
        met = stored(pairs.where(near).select("turn", "block", "number_a", "number_b"), "meetings")
    return met


def _large_tiles(large: DataFrame, bits: int, tile: int) -> DataFrame:
    """Rows of blocks above `tile` under the pairs of slices in which a link may lie.

    The upper part of the tree: rows are range-partitioned by (turn, block, Gray rank) and cut, within each partition,
    into slices of `tile`, so that a slice's members share long bit patterns; slice_meetings tells which slices meet, before
    a row is copied.
    """
    parts = 4 * int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.lit(0).cast("long")
    for turn, (start, _) in enumerate(_cuts(bits)):
        rank = F.when(F.col("turn") == turn, gray_column(F.col("code"), start)).otherwise(rank)
    unsigned = rank.bitwiseXOR(F.lit(-(1 << 63)))
    dealt = large.select("turn", "block", "code", unsigned.alias("rank")).repartitionByRange(parts, "turn", "block", "rank").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("turn", "block", "part").orderBy("rank"))
    sliced = stored(dealt.withColumn("slice", F.struct("part", F.floor((place - 1) / tile).alias("k"))), "slices")
    roots = stored(sliced.groupBy("turn", "block", "slice").agg(F.bit_and("code").alias("every"), F.bit_or("code").alias("some")), "roots")
    order = Window.partitionBy("turn", "block").orderBy("slice")  # a row for every `tile` fingerprints of the block
    roots = stored(roots.withColumn("number", (F.row_number().over(order) - 1).cast("long")), "numbered")
    meet = slice_meetings(roots, bits)
    for side in "ab":
        named = roots.select("turn", "block", F.col("number").alias(f"number_{side}"), F.col("slice").alias(f"slice_{side}"))
        meet = meet.join(named, ["turn", "block", f"number_{side}"])
    meet = stored(meet.select("turn", "block", "slice_a", "slice_b"), "met")
    alone = F.col("slice_a") == F.col("slice_b")
    sides = [meet.select("turn", "block", F.col("slice_a").alias("slice"), "slice_a", "slice_b", F.when(alone, 0).otherwise(1).alias("side")),
             meet.where(~alone).select("turn", "block", F.col("slice_b").alias("slice"), "slice_a", "slice_b", F.lit(2).alias("side"))]
    met = sliced.join(sides[0].unionAll(sides[1]), ["turn", "block", "slice"])
    return met.select("turn", "code", "side", F.col("block").alias("g"), F.col("turn").alias("gt"), F.to_json("slice_a").alias("i"), F.to_json("slice_b").alias("j"))


def fingerprint_links(codes: DataFrame, bits: int = 2, tile: int = 1000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within `bits` bits.

    codes: distinct values in column code. 64 bits are cut into bits+1 blocks: a linked pair agrees in one of
    them, so each fingerprint is dealt out once per block under that block's value. Values held by one
    fingerprint alone go; small groups share a bucket of about `tile` rows; a group above `tile` is cut into slices in
    Gray order, and slices meet in tasks of their own where their shared bits let them, so that no group lands whole in
    one task.
    """
    blocks = [
        F.struct(F.lit(turn).alias("turn"), F.shiftrightunsigned(F.shiftleft("code", start), 64 - width).alias("block"))
        for turn, (start, width) in enumerate(_cuts(bits))]
    dealt = codes.select("code", F.inline(F.array(*blocks)))
    sizes = dealt.groupBy("turn", "block").agg(F.count("*").alias("n")).where("n > 1")
    dealt = stored(dealt.join(sizes, ["turn", "block"]), "blocks")
    rows = dealt.groupBy((F.col("n") > tile).alias("large")).count().collect()
    counts = {r.large: r["count"] for r in rows}
    buckets = max(1, -(-counts.get(False, 0) // tile))
    tiles = dealt.where(F.col("n") <= tile).select(
        "turn", "code", F.lit(0).alias("side"), F.pmod(F.xxhash64("turn", "block"), F.lit(buckets)).alias("g"), F.lit(-1).alias("gt"), F.lit("").alias("i"), F.lit("").alias("j"))
    if counts.get(True):
        tiles = tiles.unionAll(_large_tiles(dealt.where(F.col("n") > tile), bits, tile))
    return tiles.groupBy("g", "gt", "i", "j").applyInPandas(_link_tile(bits), "a long, b long").distinct()


def _grouped(docs: DataFrame, bits: int, shingle: int, seed: int, tile: int, *carried: str) -> DataFrame:
    """(doc_id, code, <carried>, component, component_id) per row; component is the smallest fingerprint of the group. carried: columns of longs."""
    schema = ", ".join(["doc_id long, code long", *(f"`{c}` long" for c in carried)])
    marked = docs.select("doc_id", "text", *carried).mapInArrow(_fingerprint_batches(shingle, seed), schema)
    marked = stored(marked, "fingerprints")
    nodes = stored(marked.groupBy("code").agg(F.min("doc_id").alias("low")), "nodes")
    linked = stored(connected_components(fingerprint_links(nodes.select("code"), bits, tile), "a", "b"), "components")
    grouped = nodes.join(linked.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stored(grouped.join(lowest, "component").select("code", "component", "component_id"), "groups")
    return marked.join(named, "code")


def simhash_groups(docs: DataFrame, bits: int = 2, shingle: int = 3, seed: int = 42, tile: int = 1000) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row, over whole texts.

    Null and empty texts have the fingerprint zero, which links like any other. Equal fingerprints count as one
    node, so thousands of copies cost no more than one. component_id is the smallest doc_id reachable (null if
    the group has only null ids); repeated rows stay. An empty table gives an empty result; other columns of
    docs have no effect.
    """
    grouped = _grouped(docs, bits, shingle, seed, tile)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, mark: str, bits: int = 2, shingle: int = 3, seed: int = 42, tile: int = 1000) -> DataFrame:
    """(doc_id, <mark>): of each group the row with the smallest (doc_id, mark) among those with an id. mark: a column of longs."""
    grouped = _grouped(docs, bits, shingle, seed, tile, mark).where("doc_id is not null")
    return grouped.groupBy("component").agg(F.min(F.struct("doc_id", mark)).alias("first")).select("first.*").distinct()


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))

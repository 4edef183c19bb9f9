"""Secret scans that link the parts of a credential within scopes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table

#: Kinds in the order of reports. The first three are certain; the others count only beside a complementary part.
KINDS = ("assign", "access", "hex", "ident", "bare", "endpoint")
ROLES = ("secret", "id", "secret", "id", "secret", "endpoint")
SECRET = tuple(k for k, role in enumerate(ROLES) if role == "secret")
#: Code points between two linked parts, from the end of the earlier to the start of the later.
SCOPE = 240

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?<![A-Za-z0-9])(user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.I | re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,15}://[^\x00-\x20"'<>]{3,}""")
_LONG = re.compile(r"[A-Za-z0-9+/]{24,}")


def text_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of every part; per kind leftmost and without overlaps."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if _LONG.search(text):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        taken, k, reach = sorted((a, b) for a, kind, b in found if kind < 3), 0, 0
        for m in _BARE.finditer(text):
            s = m[0]
            mixed = any(map(str.isdigit, s)) and any(map(str.isupper, s)) and any(map(str.islower, s))
            while k < len(taken) and taken[k][0] < m.end():  # how far the certain parts reach that start before this one ends
                reach, k = max(reach, taken[k][1]), k + 1
            if mixed and reach <= m.start():
                found.append((m.start(), 4, m.end()))
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [text_parts(t or "") for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        flat = np.array([p for x in each for p in x], np.int32).reshape(-1, 3)
        parts = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "kind", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), parts)], ["doc_id", "parts"])


def scan_parts(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, parts) per input row, whole texts; rid tells repeated rows apart. Null text: no part."""
    found = docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, parts array<struct<start:int,kind:int,end:int>>")
    return stored(found.withColumn("rid", F.monotonically_increasing_id()), "parts")


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, secret, other): every secret part with every identifier or endpoint whose gap to it is within scope.

    An interval join: a text is cut into stretches of `scope` code points; a secret is entered under every stretch that
    it covers and the two beside these, another part under those it covers, so a join key never holds more than one
    stretch of one text. Of the stretches that a pair shares, the first counts.
    """
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("part.kind") + 1)
    both = found.where(F.exists("parts", lambda p: p["kind"].isin(*SECRET)) & F.exists("parts", lambda p: ~p["kind"].isin(*SECRET)))
    parts = both.select("rid", F.explode("parts").alias("part")).withColumn("role", role)
    first, last = F.floor(F.col("part.start") / scope), F.floor(F.col("part.end") / scope)
    entered = lambda rows, name, a, b: rows.select("rid", F.col("part").alias(name), a.alias(f"{name}_first"), F.explode(F.sequence(a, b)).alias("stretch"))
    secrets = entered(parts.where("role = 'secret'"), "secret", first - 1, last + 1)
    others = entered(parts.where("role <> 'secret'"), "other", first, last)
    near = (F.col("secret.start") - F.col("other.end") <= scope) & (F.col("other.start") - F.col("secret.end") <= scope)
    once = F.col("stretch") == F.greatest("secret_first", "other_first")
    return secrets.join(others, ["rid", "stretch"]).where(near & once).select("rid", "secret", "other")


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, linked, links): the weak parts in a pair of link_parts, and the pairs themselves in order."""
    pairs = link_parts(found, scope)
    weak = F.filter(F.array_distinct(F.flatten(F.collect_list(F.array("secret", "other")))), lambda p: p["kind"] >= 3)
    return pairs.groupBy("rid").agg(weak.alias("linked"), F.array_sort(F.collect_list(F.struct("secret", "other"))).alias("links"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, doc_id, base, spans, links) per input row: certain parts; these with the linked weak ones; pairs (secret, other).

    base and spans are arrays of (start, kind, end) in order. links tells which identifier or endpoint goes with which
    secret, certain ones too. Rows without a part have empty arrays, as have null and empty texts. Repeated rows stay,
    each with its own result; an empty table gives an empty result; other columns have no effect.
    """
    found = scan_parts(docs)
    joined = found.join(linked_parts(found, scope), "rid", "left")
    base = F.filter("parts", lambda p: p["kind"] < 3)
    no_links = F.slice(F.transform("parts", lambda p: F.struct(p.alias("secret"), p.alias("other"))), 1, 0)
    return joined.select("rid", "doc_id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", F.slice(base, 1, 0)))).alias("spans"), F.coalesce("links", no_links).alias("links"))


def _named(part):
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), part["kind"] + 1), part["start"], part["end"])


def _joined(spans: str):
    return F.array_join(F.transform(spans, _named), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda p: p["kind"] == k)  # noqa: E731  (a second argument of the inner lambda would be the index)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.array_join(F.transform("links", lambda p: F.concat_ws("+", _named(p["secret"]), _named(p["other"]))), ",").alias("links"))


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """text with the union of the spans (ascending by start) replaced."""
    out, at = [], 0
    for start, end in spans:
        if end > at:
            out += [text[at : max(at, start)], mask if start >= at else ""]
            at = end
    return "".join(out) + text[at:]


def _mask_certain(mask: str):
    """Rows without weak parts, their certain parts masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts, keep = batch.column(k).to_pylist(), np.ones(batch.num_rows, bool)
            for i, text in enumerate(texts):
                parts = text_parts(text) if text else []
                keep[i] = all(kind < 3 for _, kind, _ in parts)
                if parts:
                    texts[i] = _masked(text, [(a, b) for a, _, b in parts], mask)
            yield batch.set_column(k, "text", pa.array(texts, pa.string())).filter(pa.array(keep))

    return run


def _weak_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with weak parts, and all their parts."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        parts = [text_parts(t) if t else [] for t in texts]
        keep = [any(kind >= 3 for _, kind, _ in p) for p in parts]
        found = [[{"start": a, "kind": k, "end": b} for a, k, b in p] for p, ok in zip(parts, keep, strict=True) if ok]
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        rows = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kinds)], [*rows.schema.names, "_parts"])


def _mask_linked(mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            texts = [_masked(t, [(s["start"], s["end"]) for s in own], mask) for t, own in zip(batch.column(k).to_pylist(), spans, strict=True)]
            yield batch.set_column(k, "text", pa.array(texts, pa.string())).select([n for n in batch.schema.names if n != "_spans"])

    return run


def mask_spans(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by mask; overlapping spans become one. Null texts stay null.

    Most texts have certain parts at most and are masked where they are read. Only rows with weak parts take part
    in the interval join; no other text is moved.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    certain = docs.mapInArrow(_mask_certain(mask), schema)
    weak = docs.mapInArrow(_weak_rows, f"{schema}, _parts array<struct<start:int,kind:int,end:int>>").withColumn("_rid", F.monotonically_increasing_id())
    weak = stored(weak, "weak")
    linked = linked_parts(weak.select(F.col("_rid").alias("rid"), F.col("_parts").alias("parts")), scope).withColumnRenamed("rid", "_rid")
    base = F.filter("_parts", lambda p: p["kind"] < 3)
    spans = F.array_sort(F.concat(base, F.coalesce("linked", F.slice(base, 1, 0))))
    joined = weak.join(linked, "_rid", "left").select(*docs.columns, spans.alias("_spans"))
    return certain.unionAll(joined.mapInArrow(_mask_linked(mask), schema))

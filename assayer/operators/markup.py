"""Elements of stored pages as a table, and what is told from them: honeypots, security reports, structured data.

A page is parsed once, into the element tree of functions.html, so quoting, entities, comments, scripts and attribute
order are read as HTML has them. `hidden` says that sanitising (pages.drop_hidden) would take the element away. Everything
after that is expressions on the elements.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import html as H
from assayer.functions.urls import host, unsafe_reason
from assayer.operators.pages import HIDING, drop_hidden

# Of the hiding styles those that make a link a trap; class names of hidden links, names of trap fields.
TRAP_STYLES = ("display_none", "visibility_hidden", "opacity_zero", "zero_width", "zero_height", "offscreen_left", "offscreen_text_indent", "scale_zero")
HIDDEN_CLASS, TRAP_NAME = r"(?i)\b(hidden|hide|invisible|offscreen|spam)\b", r"(?i)\b(honeypot|trap|trap_field|bot|spam|email_confirm|do_not_fill|leave_blank)\b"
#: Characters of an element's source that are kept, besides the three dots of a longer one.
EVIDENCE = 120
ELEMENT = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("hidden", pa.bool_()), ("source", pa.string())])
_ELEMENT_SQL = "struct<tag: string, attrs: map<string,string>, text: string, hidden: boolean, source: string>"


def elements_of(html: str | None, tags: frozenset[str]) -> tuple[list[dict], dict[str, int]]:
    """The elements of these tags in document order, and what sanitising takes away by reason."""
    root = H.parse(html)
    wanted = [(n, n.text()) for n in root.walk() if n.tag in tags]
    reasons = drop_hidden(root)
    shown = {id(n) for n in root.walk()}
    cut = lambda s: s if len(s) <= EVIDENCE else s[:EVIDENCE] + "..."
    return [{"tag": n.tag, "attrs": list(n.attrs.items()), "text": text, "hidden": id(n) not in shown, "source": cut((html or "")[n.start : min(n.end, n.start + EVIDENCE + 1)])} for n, text in wanted], reasons


def screened_pages(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page_id, url, reasons, elements): one pass over each page; elements of the given tags with attributes, text, hidden, source.

    source is the element as the page has it, cut after EVIDENCE characters. A page without HTML has no elements.
    """
    asked = frozenset(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                found = [elements_of(h, asked) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([list(r.items()) for _, r in found], pa.map_(pa.string(), pa.int32())), pa.array([e for e, _ in found], pa.list_(ELEMENT))],
                    ["page_id", "url", "reasons", "elements"])

    given = pages.select("page_id", (F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), "html")
    return given.mapInArrow(run, f"page_id long, url string, reasons map<string,int>, elements array<{_ELEMENT_SQL}>")


def page_elements(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page_id, url, seq, tag, attrs, text, hidden, source): one row per element of the given tags."""
    return screened_pages(pages, tags).select("page_id", "url", F.posexplode("elements").alias("seq", "e")).select("page_id", "url", "seq", "e.*")


def honeypot_kind(e: Column) -> Column:
    """hidden_link: a link hidden by style or class, or marked nofollow that shows another URL; hidden_form: a trap field; else null.

    e: a struct of tag, attrs and text.
    """
    value = lambda name: F.coalesce(e["attrs"][name], F.lit(""))
    style = "(?i)" + "|".join(HIDING[s] for s in TRAP_STYLES)
    nofollow = F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "nofollow")
    trap = value("style").rlike(style) | value("class").rlike(HIDDEN_CLASS) | (nofollow & e["text"].rlike("^https?://") & (e["text"] != value("href")))
    link = (e["tag"] == "a") & F.map_contains_key(e["attrs"], F.lit("href")) & trap
    field = (e["tag"] == "input") & (F.lower(value("type")) == "hidden") & value("name").rlike(TRAP_NAME)
    return F.when(link, "hidden_link").when(field, "hidden_form")


def honeypots(pages: DataFrame) -> DataFrame:
    """(page_id, kind, evidence): trap links and trap fields of each page, in any form that HTML allows, comments aside."""
    rows = page_elements(pages, ("a", "input"))
    kind = honeypot_kind(F.struct("tag", "attrs", "text"))
    return rows.select("page_id", kind.alias("kind"), F.col("source").alias("evidence")).where("kind is not null")


def page_security_report(pages: DataFrame) -> DataFrame:
    """Per page: elements stripped by reason, their number, honeypot kinds and the number of honeypots; pages are parsed once."""
    kinds = F.filter(F.transform("elements", honeypot_kind), lambda k: k.isNotNull())
    stripped = F.aggregate(F.map_values("reasons"), F.lit(0), lambda a, n: a + n)
    return screened_pages(pages, ("a", "input")).select("page_id", "url", "reasons", stripped.alias("stripped"), F.array_sort(F.array_distinct(kinds)).alias("honeypot_kinds"), F.size(kinds).alias("honeypots"))


def _sum_by_key(rows: DataFrame, by: str, maps: str) -> DataFrame:
    """(by, maps): the maps of each key added up entry by entry."""
    entries = rows.select(by, F.explode(maps).alias("k", "v")).groupBy(by, "k").agg(F.sum("v").alias("v"))
    return entries.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(maps))


def domain_security_report(pages: DataFrame, records: DataFrame, guarded: DataFrame) -> DataFrame:
    """Per domain: pages, refused ones, stripped elements in all and by reason, honeypots by kind, records before and after the guard.

    pages (page_id, url, html); records (page_id, method, ...) as extracted; guarded: the same rows as cleaning.null_injections
    returns them, with suspect_fields. A record is left after the guard if a text cell of it still has a value. refused counts
    pages whose URL a fetcher must not open; rungs counts records by method; guarded says that anything at all was held back.
    Records of unknown pages count under a null domain; pages without a host under "".
    """
    domain = pages.select("page_id", host(F.col("url")).alias("domain"), unsafe_reason(F.col("url")).isNotNull().alias("refused"))
    report = page_security_report(pages).withColumn("domain", host(F.col("url")))
    counts = report.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("stripped").alias("stripped"), F.sum("honeypots").alias("honeypots"))
    reasons = _sum_by_key(report, "domain", "reasons")
    refused = domain.groupBy("domain").agg(F.count_if("refused").alias("refused"))
    cells = [c for c, t in guarded.dtypes if t == "string" and c != "method"]
    left = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cells)).isNotNull() if cells else F.lit(True)
    after = guarded.groupBy("page_id").agg(F.count_if(left).alias("after"), F.sum(F.size("suspect_fields")).alias("nulled"))
    before = records.groupBy("page_id", "method").agg(F.count("*").alias("n"))
    by_page = before.groupBy("page_id").agg(F.sum("n").alias("before"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("method", F.lit("")).alias("k"), F.col("n").alias("v")))).alias("rungs"))
    found = by_page.join(after, "page_id", "full").join(domain.select("page_id", "domain"), "page_id", "left")
    sums = found.groupBy("domain").agg(F.sum("before").alias("records"), F.sum("after").alias("records_after_guard"), F.sum("nulled").alias("cells_nulled"))
    rungs = _sum_by_key(found.where("rungs is not null"), "domain", "rungs")
    out = counts
    for other in (refused, reasons, sums, rungs):
        other = other.withColumnRenamed("domain", "_d")
        out = out.join(other, out["domain"].eqNullSafe(other["_d"]), "full").withColumn("domain", F.coalesce("domain", "_d")).drop("_d")
    numbers = ("pages", "refused", "stripped", "honeypots", "records", "records_after_guard", "cells_nulled")
    out = out.select("domain", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers), "reasons", "rungs")
    return out.withColumn("guarded", (F.col("refused") > 0) | (F.col("stripped") > 0) | (F.col("honeypots") > 0) | (F.col("cells_nulled") > 0))


# Where a field stands in a JSON-LD product and in meta tags (name or property), best first.
JSONLD_PATHS = {
    "title": ("name", "headline"),
    "product_name": ("name",),
    "name": ("name",),
    "price": ("offers.price", "offers.0.price", "price"),
    "cost": ("offers.price", "offers.0.price"),
    "currency": ("offers.priceCurrency", "offers.0.priceCurrency", "priceCurrency"),
    "availability": ("offers.availability", "offers.0.availability", "availability"),
    "product_url": ("url", "offers.url", "mainEntityOfPage"),
    "url": ("url",),
    "image": ("image", "image.url", "offers.image"),
    "image_url": ("image", "image.url"),
    "description": ("description",),
    "brand": ("brand.name", "brand"),
    "manufacturer": ("manufacturer.name", "manufacturer"),
    "rating": ("aggregateRating.ratingValue", "aggregateRating"),
    "review_count": ("aggregateRating.reviewCount",),
    "sku": ("sku", "productID"),
    "gtin": ("gtin13", "gtin", "gtin8", "gtin12"),
    "category": ("category",),
    "quantity": ("size", "additionalProperty.value"),
}
META_NAMES = {
    "title": (("property", "og:title"), ("name", "twitter:title"), ("name", "title")),
    "product_name": (("property", "og:title"),),
    "name": (("property", "og:title"),),
    "price": (("property", "product:price:amount"), ("property", "og:price:amount")),
    "currency": (("property", "product:price:currency"), ("property", "og:price:currency")),
    "image": (("property", "og:image"), ("name", "twitter:image")),
    "image_url": (("property", "og:image"),),
    "description": (("property", "og:description"), ("name", "description")),
    "product_url": (("property", "og:url"),),
    "url": (("property", "og:url"),),
    "availability": (("property", "product:availability"), ("property", "og:availability")),
}
#: Fields that say what a page is about; meta tags with these alone make no record.
ABOUT = ("title", "description", "image", "image_url")
_NUMBER = re.compile(r"\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?")


def _step_into(value: object, path: str) -> object:
    """The value at a dotted path: an index or an @type picks from a list, else its first element is taken; keys in any case."""
    steps = path.split(".")
    while steps and value is not None:
        if isinstance(value, list):
            typed = next((x for x in value if isinstance(x, dict) and x.get("@type") == steps[0]), None)
            if steps[0].isdigit():
                k = int(steps.pop(0))
                value = value[k] if k < len(value) else None
            elif typed is not None:
                value = typed
                steps.pop(0)
            else:
                value = value[0] if value else None
        elif isinstance(value, dict):
            key = steps.pop(0)
            value = value.get(key, next((v for k, v in value.items() if k.lower() == key.lower()), None))
        else:
            value = None
    return value


def _plain(value: object, number: bool) -> str | float | None:
    """A found value as text, or as a number: the first of a list, the @id or else the name of an object."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("@id", value.get("name"))
    if value is None or isinstance(value, (list, dict)):
        return None
    if not number:
        return str(value).strip()
    if isinstance(value, (int, float)):
        return float(value)
    found = _NUMBER.search(str(value))
    return float(found[0].replace(",", "")) if found else None


def is_number(field: str) -> bool:
    return "price" in field.lower() or "cost" in field.lower()


def products_of(blocks: list[str]) -> list[dict]:
    """Every JSON-LD Product of a page's blocks, in order: bare, in lists, in graphs, and as items of an ItemList, nested at will."""
    found = []
    for block in blocks:
        try:
            todo = [json.loads(block, parse_constant=lambda _: None)]
        except (ValueError, RecursionError):
            continue
        while todo:
            value = todo.pop()
            if isinstance(value, list):
                todo += value[::-1]
            if not isinstance(value, dict):
                continue
            kind = value.get("@type")
            kind = (kind[0] if kind else None) if isinstance(kind, list) else kind
            if kind == "Product":
                found.append(value)
            elif kind == "ItemList":
                items = value.get("itemListElement")
                items = items if isinstance(items, list) else [items]
                todo += [e["item"] for e in items[::-1] if isinstance(e, dict) and isinstance(e.get("item"), dict)]
            elif "@graph" in value:
                todo.append(value["@graph"])
    return found


def _meta(tags: list[H.Node], attribute: str | None, name: str) -> str | None:
    """content of the first meta tag of that name, or else of that name in any case; attribute None: name or property."""
    for fold in (str, str.lower):
        for n in tags:
            names = [n.attrs.get(a) for a in ((attribute,) if attribute else ("property", "name"))]
            if any(x is not None and fold(x) == fold(name) for x in names):
                return n.attrs.get("content", "").strip() or None
    return None


def structured_rows(html: str | None, fields: dict[str, tuple[tuple[str, ...], tuple]], meta_needs: bool) -> list[dict]:
    """The records of a page: one per product that has a field, else one from meta tags, else none."""
    root = H.parse(html)
    nodes = [n for n in root.walk() if n.tag in ("script", "meta")]
    blocks = ["".join(c for c in n.children if isinstance(c, str)) for n in nodes if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/ld+json"]
    rows = []
    for product in products_of(blocks):
        row = {}
        for field, (paths, _) in fields.items():
            values = (_step_into(product, p) for p in paths)
            row[field] = _plain(next((v for v in values if v not in (None, "", [])), None), is_number(field))
        if any(v not in (None, "") for v in row.values()):
            rows.append(row | {"method": "jsonld"})
    if rows:
        return rows
    tags, row = [n for n in nodes if n.tag == "meta"], {}
    for field, (_, names) in fields.items():
        found = (_meta(tags, *(name if isinstance(name, tuple) else (None, name))) for name in names)
        row[field] = _plain(next((v for v in found if v), None), is_number(field))
    told = [f for f, v in row.items() if v is not None]
    if not told or meta_needs and all(f.lower() in ABOUT for f in told):
        return []
    return [row | {"method": "meta"}]


def extract_structured(pages: DataFrame, fields: dict[str, tuple] | list[str], meta_needs_data: bool | None = None) -> DataFrame:
    """(page_id, <field>, method): one row per JSON-LD product that has one of the fields; of a page without any, one row from its meta tags.

    fields: names that JSONLD_PATHS and META_NAMES know, or name to (paths in the product, meta names), one text or a tuple of
    them, best first; a meta name is a text, or (attribute, text). The first place with a value counts. Fields with price or cost in
    their name are doubles, all others text. Meta tags belong to the page and fill no gaps of products; meta_needs_data: they
    make a row only if they tell more than title, description and image (by default for a list of names). A page with
    neither has one row of nulls.
    """
    known = isinstance(fields, list)
    each = lambda x: (x,) if isinstance(x, str) else tuple(x)
    places = {f: (JSONLD_PATHS.get(f.lower(), ()), META_NAMES.get(f.lower(), ())) for f in fields} if known else {f: (each(p), each(m)) for f, (p, m) in fields.items()}
    needs = known if meta_needs_data is None else meta_needs_data
    kinds = [(f, pa.float64() if is_number(f) else pa.string()) for f in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                rows = [{"page_id": page_id} | row for page_id, html in zip(*(batch.slice(k, 64).column(c).to_pylist() for c in ("page_id", "html")), strict=True) for row in structured_rows(html, places, needs) or [{}]]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), *kinds, ("method", pa.string())]))

    columns = ", ".join(f"`{f}` {'double' if is_number(f) else 'string'}" for f in places)
    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, {columns}, method string")

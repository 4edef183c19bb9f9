"""Search planning and lead tables: areas, ranking, prices, memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import urls as U
from assayer.functions.quantity import with_quantity
from assayer.functions.text import amount_of, blank_to_null

# Hints in paths of product and listing pages.
DEEP = ("product", "item", "medicine", "drug", "detail", "p/", "buy", "shop", "listing")
BAD = ("/category/", "/categories/", "/search", "/blog", "/tag/", "/author/", "/page/", "/about", "/contact", "/privacy", "/terms")
LISTING = ("/category/", "/categories/", "/collections/", "/collection/", "/brand/", "/brands/", "/list/", "/lists/", "/catalog/", "/products/", "/store/", "/shop/", "/c/", "/search")
IDS = ("place_id", "cid", "data_id", "link")


def unit_prices(df: DataFrame, price: Column, texts: tuple[str, ...] = ("quantity", "title", "product_name", "name")) -> DataFrame:
    """Adds package_quantity, package_unit, dose_strength and single_unit_price from the first text that tells a quantity."""
    names = [c for c in texts if c in df.columns]
    out = df
    for k, c in enumerate(names):
        out = with_quantity(out, F.trim(F.col(c)), f"_q{k}")
    out = out.withColumn("_q", F.coalesce(*(F.col(f"_q{k}") for k in range(len(names))))).drop(*(f"_q{k}" for k in range(len(names))))
    return out.withColumns({"package_quantity": F.col("_q.count"), "package_unit": F.col("_q.unit"), "dose_strength": F.col("_q.strength"), "single_unit_price": price / F.col("_q.count")}).drop("_q")


def expand_grid(queries: DataFrame, areas: DataFrame, max_areas: int = 50) -> DataFrame:
    """(query_id, query, area): one search per query and area (trimmed, distinct, the first max_areas); without areas the query itself.

    queries (query_id, query, city) meet the areas (query_id, seq, area) of their own id.
    """
    named = areas.withColumn("area", F.trim("area")).where("area <> ''").groupBy("query_id", F.lower("area").alias("_k")).agg(F.min_by(F.struct("seq", "area"), "seq").alias("a")).select("query_id", "a.*")
    few = named.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).where(F.col("n") <= max_areas)
    joined = queries.join(few, "query_id", "left")
    city = F.when((F.coalesce("city", F.lit("")) != "") & ~F.lower("area").contains(F.lower("city")), F.col("city"))
    return joined.select("query_id", F.when(F.col("area").isNull(), F.col("query")).otherwise(F.concat(F.col("query"), F.lit(" in "), F.concat_ws(", ", "area", city))).alias("query"), "area")


def lead_columns(raw: DataFrame) -> DataFrame:
    """Lead rows with null as empty text, and has_website and website_type."""
    texts = raw.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw.columns))
    kind = U.website_kind(F.col("website"))
    return texts.withColumn("website_type", kind).withColumn("has_website", F.col("website_type") == "own")


def lead_key(df: DataFrame) -> Column:
    """An id column, else title and address, else a digest of the row."""
    ids = [blank_to_null(F.col(c)) for c in IDS if c in df.columns]
    place = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.lower(F.concat_ws("|", F.trim("title"), F.trim("address"))))
    return F.coalesce(*ids, place, F.sha2(F.to_json(F.struct(*df.columns)), 256))


def filter_no_website(leads: DataFrame, strict: bool = False) -> DataFrame:
    """Leads without a site of their own; strict: without any website text."""
    return leads.where(F.col("website") == "") if strict else leads.where(~F.col("has_website"))


def annotate_leads(leads: DataFrame, memory: DataFrame, mode: str = "annotate") -> DataFrame:
    """leads (client_id, place_id) with lead_status NEW, EXISTING or NEW_UNVERIFIED (no id); discovery keeps NEW only."""
    known = memory.select("client_id", "place_id").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.coalesce(F.col("place_id"), F.lit("")) == "", "NEW_UNVERIFIED").when(F.col("_known"), "EXISTING").otherwise("NEW")
    out = leads.join(known, ["client_id", "place_id"], "left").withColumn("lead_status", status).drop("_known")
    return out.where("lead_status = 'NEW'") if mode == "discovery" else out


def memory_updates(leads: DataFrame, now: Column) -> DataFrame:
    """What annotate_leads adds to memory: one row per client and place, for upsert_latest with first_seen_at kept."""
    return leads.where("coalesce(place_id, '') <> ''").groupBy("client_id", "place_id").agg(F.min("query_key").alias("query_key")).withColumns({"first_seen_at": now, "last_seen_at": now})


def best_prices(items: DataFrame, k: int) -> DataFrame:
    """The k cheapest items (seq, price text) of all sources; items without a price are left out."""
    return items.withColumn("amount", amount_of(F.col("price"))).where("amount is not null").orderBy("amount", "seq").limit(k)


def url_score(url: Column, listings: bool = False) -> Column:
    """How much a URL looks like a product page, or like a listing."""
    path, query = F.trim(U.part(url, 3)), U.part(url, 4)
    low = F.lower(path)
    some = lambda hints: reduce(lambda a, h: a | low.contains(h), hints, F.lit(False))
    inner = F.regexp_replace(path, "^/+|/+$", "")
    score = F.least(F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit(""))), F.lit(4))
    score = score + (F.when(some(LISTING), 6).otherwise(0) if listings else F.when(some(DEEP), 4).otherwise(0) - F.when(some(BAD), 6).otherwise(0))
    score = score + F.when(path.rlike(r"(?i)\.(html?|php|aspx?)(\?|$)"), 4).otherwise(0) + F.when(path.rlike("[0-9]{3,}"), 3 if listings else 5).otherwise(0) + F.when(query != "", 3 if listings else -2).otherwise(0)
    return F.when(path.isin("", "/"), 2 if listings else -10).otherwise(score)


def rank_urls(urls: DataFrame, k: int, listings: bool = False) -> DataFrame:
    """The k best URLs per query (query_id, seq, url), ties in the order of seq."""
    scored = urls.withColumn("score", url_score(F.col("url"), listings))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))).where(F.col("place") <= k)


def merge_sources(pinned: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """(url, place): pinned URLs first, then fresh ones not yet there, in order of seq, the first `most`."""
    both = pinned.select("seq", "url", F.lit(0).alias("kind")).unionByName(fresh.select("seq", "url", F.lit(1).alias("kind")))
    first = both.groupBy("url").agg(F.min(F.struct("kind", "seq")).alias("o"))
    top = first.orderBy("o.kind", "o.seq", "url").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o.kind", "o.seq", "url"))).select("url", "place")  # at most `most` rows


def union_areas(frames: dict[str, DataFrame]) -> DataFrame:
    """The areas' results in one table with an area column; columns may differ."""
    tagged = [df.withColumn("area", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

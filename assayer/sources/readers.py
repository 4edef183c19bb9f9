"""Reading URL lists, sitemaps, templates, leads and usage events."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.urls import canonical
from assayer.operators.leads import lead_columns
from assayer.operators.ranks import numbered
from assayer.sources.shared import shared_dir

USAGE_SCHEMA = "event_id string, client_id string, job_id string, task_id string, resource_type string, quantity decimal(20,6), unit string, unit_cost_snapshot decimal(20,10), total_cost_usd decimal(20,8), provider string, metadata string, occurred_at timestamp"


def _clean_lines(lines: DataFrame) -> DataFrame:
    """lines (seq, line) with url, the canonical http(s) URL of a line, or null; comments and blanks are gone."""
    told = lines.withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    url = canonical(F.col("line"))
    return told.select("seq", "line", F.when(url.rlike("^https?://[^/]+"), url).alias("url"))


def clean_url_list(lines: DataFrame) -> DataFrame:
    """(seq, url) from (seq, line): no comments and blanks, canonical http(s) URLs, the first of each."""
    urls = _clean_lines(lines).where("url is not null")
    return urls.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", "url")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """One row (given, kept, not_http, repeated): what became of the lines that are neither blank nor comments."""
    each = _clean_lines(lines).groupBy("url").agg(F.count("*").alias("n"))
    given, bad = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("url").isNull(), F.col("n"))), F.lit(0))
    kept = F.count("url")
    return each.agg(given.alias("given"), kept.alias("kept"), bad.alias("not_http"), (given - bad - kept).alias("repeated"))


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): the lines of a text file, or the column url, urls or else the first of a CSV file."""
    if path.lower().endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
        column = next((c for c in table.columns if c.lower() in ("url", "urls")), table.columns[0])
        lines = table.select(F.col(f"`{column}`").alias("line"))
    else:
        lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where("line is not null").withColumn("seq", F.monotonically_increasing_id()).select("seq", "line")


def read_url_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(URLs, counts) of a file: clean_url_list and dropped_lines of its lines."""
    lines = url_lines(spark, path)
    return clean_url_list(lines), dropped_lines(lines)


ENTRY = pa.struct([("url", pa.string()), ("lastmod", pa.string()), ("changefreq", pa.string()), ("priority", pa.float64())])


def _entry(element: ElementTree.Element) -> dict:
    found: dict = {"url": None, "lastmod": None, "changefreq": None, "priority": None}
    for child in element:
        name, text = _local(child), (child.text or "").strip() or None
        if name in ("lastmod", "changefreq"):
            found[name] = text
        elif name == "loc" and text:
            found["url"] = text
        elif name == "priority" and text:
            try:
                found["priority"] = float(text)
            except ValueError:
                pass
    return found


def _local(element: ElementTree.Element) -> str:
    """The name without its namespace."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def parse_sitemap(xml: str | None) -> tuple[str, list[dict], list[str]]:
    """(kind, entries, children) of a site map: urlset, index, empty (no text, or another document), or malformed."""
    if not (xml or "").strip():
        return "empty", [], []
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return "malformed", [], []
    if _local(root) == "urlset":
        return "urlset", [e for e in map(_entry, (x for x in root if _local(x) == "url")) if e["url"]], []
    if _local(root) == "sitemapindex":
        locs = (next((c.text.strip() for c in x if _local(c) == "loc" and c.text), "") for x in root if _local(x) == "sitemap")
        return "index", [], [u for u in locs if u]
    return "empty", [], []


def parsed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, kind, entries, children) by an XML parser: entities, CDATA, comments and prefixed namespaces are read as XML has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 16):
                part = batch.slice(k, 16)
                found = [parse_sitemap(x) for x in part.column("xml").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("sitemap_url"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.list_(ENTRY)), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                    ["sitemap_url", "kind", "entries", "children"])

    return sitemaps.select("sitemap_url", "xml").mapInArrow(run, "sitemap_url string, kind string, entries array<struct<url: string, lastmod: string, changefreq: string, priority: double>>, children array<string>")


def sitemap_urls(sitemaps: DataFrame, max_children: int = 20, max_urls: int = 10_000) -> DataFrame:
    """(root, url, lastmod, changefreq, priority, warning) from (sitemap_url, xml): entries of url sets, and of an index's children one level down.

    A malformed document gives one row with a warning, and so does every limit that leaves children or entries of a root out.
    Documents with another root element are empty. Every document is parsed once; entries are counted off by totals, so one
    root may have any number.
    """
    shared_dir(sitemaps.sparkSession)
    known = parsed_sitemaps(sitemaps).checkpoint()
    entries = known.where("kind = 'urlset'").select("sitemap_url", F.posexplode("entries").alias("n", "e")).select("sitemap_url", "n", "e.*")
    children = known.where("kind = 'index'").select(F.col("sitemap_url").alias("root"), F.posexplode("children").alias("k", "child"))
    cut = children.where(F.col("k") == max_children).select("root", F.lit(f"children beyond {max_children} left out").alias("warning"))
    children = children.where(F.col("k") < max_children)
    nested = children.select("child").distinct().withColumnRenamed("child", "sitemap_url")
    own = entries.join(nested, "sitemap_url", "left_anti").select(F.col("sitemap_url").alias("root"), F.lit(-1).alias("k"), "n", "url", "lastmod", "changefreq", "priority")
    below = children.join(entries, F.col("child") == F.col("sitemap_url")).select("root", "k", "n", "url", "lastmod", "changefreq", "priority")
    placed = numbered(own.unionByName(below), "root", [F.asc("k"), F.asc("n"), F.asc("url")], "_p")
    found = placed.where(F.col("_p") <= max_urls).drop("_p", "k", "n").withColumn("warning", F.lit(None).cast("string"))
    cut = cut.unionByName(placed.where(F.col("_p") == max_urls + 1).select("root", F.lit(f"entries beyond {max_urls} left out").alias("warning")))
    wrong = known.where("kind = 'malformed'").select(F.col("sitemap_url").alias("root"), F.lit("malformed sitemap").alias("warning"))
    return found.unionByName(wrong.unionByName(cut), allowMissingColumns=True)


def expand_url_templates(templates: DataFrame, max_urls: int = 10_000) -> DataFrame:
    """(id, url) for every combination of {a..b[:step]} ranges and {x,y} choices; a range that falls, a step of zero, and a template of more than max_urls raise an error before any is made.

    The combinations of a template are numbered; each number is decoded into one value per slot, the last slot first.
    """
    slot, span = r"\{([^{}]*)\}", r"^(-?[0-9]+)\.\.(-?[0-9]+)(?::([0-9]+))?$"

    def parsed(body, k):
        a, b, step = (F.regexp_extract(body, span, g).try_cast("long") for g in (1, 2, 3))
        by, choices, ranged = F.coalesce(step, F.lit(1)), F.split(body, ","), body.rlike(span)
        count = F.when(a.isNull() | b.isNull(), float("inf")).when(by < 1, F.raise_error(F.lit("the step of a range must be 1 or more")).cast("double")).when(
            b < a, F.raise_error(F.lit("a range must not fall")).cast("double")).otherwise(F.floor((b.cast("double") - a.cast("double")) / by) + 1)
        return F.struct(
            F.get("texts", k).alias("before"), a.alias("a"), by.alias("by"), F.when(~ranged, choices).alias("choices"),
            F.when(ranged, count).otherwise(F.size(choices)).cast("double").alias("n"))

    rows = templates.select("id", F.split("template", slot, -1).alias("texts"), F.regexp_extract_all("template", F.lit(slot), 1).alias("bodies"))
    rows = rows.withColumn("slots", F.reverse(F.transform("bodies", parsed)))
    total = F.aggregate("slots", F.lit(1.0), lambda acc, x: acc * x["n"])
    many = F.when(total > max_urls, F.raise_error(F.lit("too many URLs in a template")).cast("long")).otherwise(total.cast("long"))
    rows = rows.select("id", "slots", F.element_at("texts", -1).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("i"))

    def put(acc, x):
        n = x["n"].cast("long")
        k = acc["i"] % n
        value = F.coalesce(F.trim(F.get(x["choices"], k.cast("int"))), (x["a"] + k * x["by"]).cast("string"))
        return F.struct(F.floor(acc["i"] / n).alias("i"), F.concat(x["before"], value, acc["url"]).alias("url"))

    return rows.select("id", F.aggregate("slots", F.struct(F.col("i"), F.col("last").alias("url")), put)["url"].alias("url"))


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    return lead_columns(spark.read.option("header", True).csv(path))


def read_usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """Usage events from JSON files as they arrive; absent numbers are zero, absent maps empty; broken lines are left out."""
    raw = spark.readStream.schema(USAGE_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("event_id is not null").drop("_bad").fillna("", ["job_id", "task_id", "provider", "unit"]).withColumns({"quantity": F.coalesce("quantity", F.lit(0)), "metadata": F.coalesce("metadata", F.lit("{}"))})

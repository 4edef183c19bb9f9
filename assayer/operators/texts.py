"""Text tables: scripts, contacts, prompts and cached answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ranks import numbered

# Character ranges of scripts in the order of ties, and patterns of contacts and prompt hints.
SCRIPTS = {
    "cjk": "\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff",
    "korean": "\uac00-\ud7af\u1100-\u11ff",
    "arabic": "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff",
    "hebrew": "\u0590-\u05ff",
    "cyrillic": "\u0400-\u04ff",
    "devanagari": "\u0900-\u097f",
    "thai": "\u0e00-\u0e7f",
    "greek": "\u0370-\u03ff",
    "latin": "A-Za-z\u00c0-\u024f",
}
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+\d{1,3}[\s\-.]?)?(?:\(\d{1,4}\)[\s\-.]?)?\d{2,4}(?:[\s\-.]?\d{1,4}){1,5}"
ISO_DATE = r"^\d{4}[\-/]\d{2}[\-/]\d{2}$"
HINTS = {
    "multipage": r"(?i)\b(all|every|each|paginate|pagination|next\s+page|across\s+multiple\s+pages?|scroll|load\s+more|browse|pages)\b",
    "single_page": r"(?i)\b(single\s+page|one\s+page|just\s+(this|the)\s+page|this\s+one\s+page|only\s+(this|one)\s+page|first\s+page\s+only|just\s+the\s+first\s+page)\b",
    "detail_pages": r"(?i)\b(detail|details|product\s+page|each\s+item|per\s+item|full\s+description|specifications?|reviews?)\b",
}
PAGE_NUMBER = r"(?i)\b(?:up\s+to\s+|first\s+|max\s+)?(\d{1,4})\s+pages?\b"
FORMATS = {"parquet": r"(?i)\bparquet\b", "json": r"(?i)\bjson\b|\bjsonl\b", "csv": r"(?i)\bcsv\b|\bcomma[-\s]?separated\b", "xlsx": r"(?i)\bxlsx\b|\bexcel\b|\bspreadsheet\b|\bworkbook\b"}
FORBIDDEN = {
    "another's login": r"(?i)\b(log\s*in|login|sign\s*in|signin)\b.*\b(as|with)\b.*\b(me|my|password)\b", "bypassing access control": r"(?i)\bbypass\b.*\b(login|paywall|captcha|auth)\b",
    "behind a paywall or login": r"(?i)\b(scrape|get|extract)\b.*\b(behind|through|past)\b.*\b(paywall|login|auth)\b", "stolen credentials": r"(?i)\bcrack\b|\bsteal\b.*\b(credentials?|passwords?|cookies?)\b", "solving captchas": r"(?i)\bsolve\b.*\bcaptcha\b",
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def script_family(text: Column) -> Column:
    """struct(script, share): the script with the most characters among all letters counted; `unknown` without any.

    A text is read twice: Latin is counted in it, and what lies beyond Latin is cut out, which is all that the other scripts
    are counted in.
    """
    within = lambda c, chars: F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))
    read = F.struct(within(text, SCRIPTS["latin"]).alias("latin"), F.regexp_replace(text, "[\\x00-\u024f]+", "").alias("rest"))

    def counted(seen: Column) -> Column:
        return F.array(*(F.struct((seen["latin"] if name == "latin" else within(seen["rest"], chars)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("script")) for k, (name, chars) in enumerate(SCRIPTS.items())))

    def family(counts: Column) -> Column:
        best, total = F.array_max(counts), F.aggregate(counts, F.lit(0), lambda a, c: a + c["n"])
        return F.when(total > 0, F.struct(best["script"].alias("script"), (best["n"] / total).alias("share"))).otherwise(F.struct(F.lit("unknown").alias("script"), F.lit(0.0).alias("share")))

    return _once(_once(read, counted), family)


def redact_contacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds redacted text and the map from placeholder to value: <EMAIL_n> and <PHONE_n>, the same value the same n within a text.

    A phone has nine digits or more and is no ISO date.
    """
    digits = lambda p: F.length(F.regexp_replace(p, "[^0-9]", ""))
    emails = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(EMAIL), 0))
    bare = F.regexp_replace(F.col(text), EMAIL, " ")
    phones = F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(PHONE), 0), lambda p: (digits(p) >= 9) & ~p.rlike(ISO_DATE)))
    named = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.concat(F.lit(f"<{kind}_"), (i + 1).cast("string"), F.lit(">")).alias("token"), v.alias("value")))
    found = df.withColumn("_found", F.concat(named("EMAIL", emails), named("PHONE", phones)))
    longest = F.array_sort(F.transform("_found", lambda f: F.struct((-F.length(f["value"])).alias("o"), f["token"].alias("token"), f["value"].alias("value"))))
    redacted = F.aggregate(longest, F.col(text), lambda acc, f: F.replace(acc, f["value"], f["token"]))
    return found.withColumn("redacted", redacted).withColumn("replacements", F.map_from_entries("_found")).withColumn("has_pii", F.size("_found") > 0).drop("_found")


def restore_contacts(text: Column, replacements: Column) -> Column:
    return F.aggregate(F.map_entries(replacements), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def prompt_tags(text: Column, hints: Column | None = None, pages: int = 5, most_pages: int = 500, output_format: str = "xlsx") -> dict[str, Column]:
    """Columns pagination (auto, none), detail_pages (required, optional, none), max_pages, output_format and forbidden of a prompt.

    A prompt that names one page is not paginated. hints: a struct of pagination, detail_pages and max_pages; what it
    holds comes before what the text says. max_pages is `pages` where nothing names a number, and between 1 and
    most_pages. forbidden: why the prompt must be refused, else null. Null texts are as empty ones.
    """
    text = F.coalesce(text, F.lit(""))
    given = lambda name: F.nullif(hints[name].cast("string"), F.lit("")) if hints is not None else F.lit(None).cast("string")
    paged = F.coalesce(given("pagination"), F.when(~text.rlike(HINTS["single_page"]) & text.rlike(HINTS["multipage"]), "auto").otherwise("none"))
    details = F.coalesce(given("detail_pages"), F.when(text.rlike(HINTS["detail_pages"]), "required").when(paged == "auto", "optional").otherwise("none"))
    asked = F.nullif(given("max_pages").try_cast("int"), F.lit(0))
    number = F.coalesce(asked, F.regexp_extract(text, PAGE_NUMBER, 1).try_cast("int"))
    form, why = F.lit(output_format), F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS.items()):
        form = F.when(text.rlike(pattern), name).otherwise(form)
    for reason, pattern in reversed(FORBIDDEN.items()):
        why = F.when(text.rlike(pattern), reason).otherwise(why)
    return {"pagination": paged, "detail_pages": details, "max_pages": F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(most_pages), number))).otherwise(pages), "output_format": form, "forbidden": why}


def prompt_keys(prompts: DataFrame, options: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, bytes_saved): prompts equal after white space is collapsed, with equal options, share a key."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    key = F.sha2(F.to_json(F.struct(text.alias("text"), *sorted(options))), 256)
    return prompts.select(key.alias("key"), F.octet_length("text").alias("size")).groupBy("key").agg(F.count("*").alias("n"), (F.sum("size") - F.max("size")).alias("bytes_saved"))


def _placed(cache: DataFrame, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(entries within their lifetime with _place and _bytes_sum per tenant, most recently used first; the expired ones)."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    alive = numbered(cache.where(age <= ttl_seconds), "tenant", [F.desc("used_at"), F.asc("key")], "_place", {"_bytes_sum": "bytes"})
    return alive, cache.where(age > ttl_seconds)


def cache_retention(cache: DataFrame, now: Column, ttl_seconds: int, max_entries: int, max_bytes: int) -> DataFrame:
    """Entries that stay per tenant: those within their lifetime, most recently used first, within both caps."""
    placed, _ = _placed(cache, now, ttl_seconds)
    return placed.where((F.col("_place") <= max_entries) & (F.col("_bytes_sum") <= max_bytes)).drop("_place", "_bytes_sum")


def cache_stats(cache: DataFrame, lookups: DataFrame, now: Column, ttl_seconds: int, max_entries: int, max_bytes: int) -> DataFrame:
    """Per tenant what retention leaves and how the cache served: entry_count, total_bytes, expired, evicted, hits, misses, hit_rate.

    lookups (tenant, hit boolean), one row per question; a rate without lookups is 0, rounded to four places. A null tenant
    is one of its own.
    """
    placed, expired = _placed(cache, now, ttl_seconds)
    stays = (F.col("_place") <= max_entries) & (F.col("_bytes_sum") <= max_bytes)
    rows = [
        placed.select("tenant", F.when(stays, "entry_count").otherwise("evicted").alias("what"), F.when(stays, F.col("bytes")).alias("bytes")), expired.select("tenant", F.lit("expired").alias("what"), F.lit(None).cast("long").alias("bytes")),
        lookups.select("tenant", F.when(F.col("hit"), "hits").otherwise("misses").alias("what"), F.lit(None).cast("long").alias("bytes"))]
    counts = {n: F.count_if(F.col("what") == n).alias(n) for n in ("entry_count", "expired", "evicted", "hits", "misses")}
    found = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("tenant").agg(*counts.values(), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    asked = F.col("hits") + F.col("misses")
    return found.withColumn("hit_rate", F.when(asked > 0, F.round(F.col("hits") / asked, 4)).otherwise(0.0))


def json_path(value: Column, path: str) -> Column:
    """The text at a dotted path of a JSON column; a number is an index, a list steps into its first element."""
    steps = []
    for p in path.split("."):
        steps.append(f"[{p}]" if p.isdigit() else f".{p}")
    plain = "$" + "".join(steps)
    firsts = "$" + "".join(s if s.startswith("[") else f"[0]{s}" for s in steps)
    return F.coalesce(F.get_json_object(value, plain), F.get_json_object(value, firsts))


def json_ld(value: Column, kind: str, path: str) -> Column:
    """The text at path of the first object of an @graph array whose @type is kind, else of the object itself."""
    items = F.from_json(F.get_json_object(value, "$.@graph"), "array<string>")
    match = F.filter(items, lambda o: F.get_json_object(o, "$.@type") == kind)
    return json_path(F.coalesce(F.get(match, F.lit(0)), value), path)

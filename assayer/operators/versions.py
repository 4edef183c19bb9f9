"""Dataset versions: what changed between two, and which is the latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import amount_of
from assayer.operators.cleaning import BOOKKEEPING, IDENTITY, identity

# Columns that never count as a change.
SILENT = (*BOOKKEEPING, "confidence", "seq")


def _last(df: DataFrame, seq: str) -> DataFrame:
    """The last row of each identity; rows without identity go."""
    keyed = df.withColumn("_key", identity(df, IDENTITY)).where("_key is not null")
    return keyed.groupBy("_key").agg(F.max_by(F.struct(*df.columns), seq).alias("r"))


def _differs(name: str, old: Column, new: Column) -> Column:
    """Whether two values of a column differ beyond case and white space; prices differ as numbers, whatever the currency."""
    plain = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))
    texts = plain(old) != plain(new)
    if not any(w in name.lower() for w in ("price", "cost", "amount")):
        return texts
    a, b = amount_of(old.cast("string")), amount_of(new.cast("string"))
    return F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(texts)


def classify_changes(previous: DataFrame, current: DataFrame, seq: str = "seq", with_times: bool = False) -> DataFrame:
    """One row per identity: change_type NEW, REMOVED, MODIFIED or UNCHANGED, and the changed fields by name.

    Each side is reduced to its last row per identity (an aggregate with map-side combine), then one full outer
    join on that key, whose two sides are already dealt by it.
    """
    names = sorted({*previous.columns, *current.columns} - set(SILENT))
    if not with_times:
        names = [n for n in names if "timestamp" not in n.lower() and "updated" not in n.lower() and not n.lower().endswith("_at")]
    both = _last(previous, seq).withColumnRenamed("r", "p").join(_last(current, seq).withColumnRenamed("r", "c"), "_key", "full_outer")
    changes = []
    for n in names:
        old = F.col(f"p.{n}") if n in previous.columns else F.lit(None).cast("string")
        new = F.col(f"c.{n}") if n in current.columns else F.lit(None).cast("string")
        changes.append(F.when(_differs(n, old, new), F.struct(F.lit(n).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"))))
    fields = F.when(F.col("p").isNotNull() & F.col("c").isNotNull(), F.array_compact(F.array(*changes)))
    kind = F.when(F.col("p").isNull(), "NEW").when(F.col("c").isNull(), "REMOVED").when(F.size("field_changes") > 0, "MODIFIED").otherwise("UNCHANGED")
    return both.withColumn("field_changes", F.coalesce(fields, F.array().cast("array<struct<field:string,old:string,new:string>>"))).select(F.col("_key").alias("identity"), kind.alias("change_type"), "field_changes")


def diff_prices(current: DataFrame, previous: DataFrame, seq: str = "seq") -> DataFrame:
    """Every current row with diff_status, then the rows that are gone; duplicates stay, a row without key is New."""
    key = lambda df: identity(df, ("title", "business_name", "job_title", "name"))
    old = previous.withColumn("_key", key(previous)).where("_key is not null").groupBy("_key").agg(F.max_by(F.struct(*previous.columns), seq).alias("p"))
    now = current.withColumn("_key", key(current))
    unsigned = lambda c: F.regexp_replace(F.regexp_extract(c, r"[0-9,]+\.?[0-9]*", 0), ",", "").try_cast("double")
    status = F.when(F.col("p").isNull(), "New").when(unsigned(F.col("price")) != unsigned(F.col("p.price")), F.concat(F.lit("Price Changed (was "), F.col("p.price"), F.lit(")"))).otherwise("Unchanged")
    kept = now.join(old, "_key", "left").select(*current.columns, status.alias("diff_status"))
    gone = old.join(now.select("_key").where("_key is not null").distinct(), "_key", "left_anti").select("p.*", F.lit("Removed").alias("diff_status"))
    return kept.unionByName(gone, allowMissingColumns=True)


def change_summary(changes: DataFrame, top: int = 5) -> DataFrame:
    """One row: counts by change type and the highlights, most telling first."""
    counts = changes.agg(*(F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("NEW", "REMOVED", "MODIFIED", "UNCHANGED")), F.count("*").alias("total"))
    cells = changes.where("change_type = 'MODIFIED'").select(F.inline("field_changes"))
    name = F.lower("field")
    price, stock = name.rlike("price|cost"), name.rlike("availab|stock")
    old, new = amount_of(F.col("old")), amount_of(F.col("new"))
    rank = F.struct
    lines = cells.select(F.explode(F.array_compact(F.array(
        F.when(price & (new < old), rank(F.lit(0).alias("place"), F.lit("price decrease(s)").alias("what"))), F.when(price & (new > old), rank(F.lit(1).alias("place"), F.lit("price increase(s)").alias("what"))),
        F.when(stock, rank(F.lit(2).alias("place"), F.lit("availability flip(s)").alias("what"))), F.when(~price & ~stock, rank(F.lit(3).alias("place"), F.concat("field", F.lit(" change(s)")).alias("what")))))).alias("h")).select("h.*")
    ranked = lines.groupBy("place", "what").agg(F.count("*").alias("n")).withColumn("order", F.row_number().over(Window.orderBy("place", F.desc("n"), "what"))).where(F.col("order") <= top)
    shown = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("order", F.concat_ws(" ", F.col("n").cast("string"), "what").alias("t")))), lambda r: r["t"]).alias("highlights"))
    return counts.crossJoin(shown)  # one row each


def latest_snapshot(df: DataFrame, keys: Sequence[str], at: str, before: Column | None = None) -> DataFrame:
    """All rows of the newest batch per key, with a time before `before`; no limit on a batch."""
    rows = df if before is None else df.where(F.col(at) < before)
    newest = rows.groupBy(*keys).agg(F.max(at).alias("_newest"))
    return rows.join(newest, list(keys)).where(F.col(at) == F.col("_newest")).drop("_newest")


def version_chain(versions: DataFrame) -> DataFrame:
    """Versions 1, 2, ... per task in order of time, with flags for the latest and the latest valid one."""
    by = Window.partitionBy("task_key")
    number = F.row_number().over(by.orderBy("created_at", "seq"))
    valid = F.when(F.col("quality_passed") & ~F.col("superseded"), F.col("version"))
    chain = versions.withColumn("version", number)
    return chain.withColumn("is_latest", F.col("version") == F.max("version").over(by)).withColumn("is_latest_valid", F.coalesce(F.col("version") == F.max(valid).over(by), F.lit(False)))


def version_upsert(table: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """Rows (key, version, payload) to append: the next version where the payload differs from the current one."""
    current = table.groupBy(key).agg(F.max_by(F.struct("version", "payload"), "version").alias("cur"))
    new = specs.join(current, key, "left").where(F.col("cur").isNull() | (F.sha2("payload", 256) != F.sha2("cur.payload", 256)))
    return new.select(key, (F.coalesce("cur.version", F.lit(0)) + 1).alias("version"), "payload")


def upsert_latest(table: DataFrame, updates: DataFrame, keys: Sequence[str], seq: str, keep: Sequence[str] = ()) -> DataFrame:
    """table with updates merged by key: the newest row wins; columns in keep hold the oldest value."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = F.struct("_new", seq)
    picks = [(F.min_by if c in keep else F.max_by)(c, order).alias(c) for c in table.columns if c not in keys]
    return rows.groupBy(*keys).agg(*picks).select(*table.columns)


def populated_columns(df: DataFrame) -> DataFrame:
    """One row: the names of columns with a value somewhere."""
    some = df.agg(*(F.bool_or(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in df.columns))
    return some.select(F.array_compact(F.array(*(F.when(F.col(c), c) for c in df.columns))).alias("names"))


def schema_change(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: columns added and removed, by populated columns."""
    old, new = populated_columns(previous).select(F.col("names").alias("old")), populated_columns(current).select(F.col("names").alias("new"))
    both = old.crossJoin(new)  # one row each
    return both.select(F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("removed"))


def same_identities(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row `same`: whether both hold the same set of keys."""
    left, right = (df.where(F.col(key).isNotNull()).select(key).distinct() for df in (a, b))
    odd = left.exceptAll(right).unionAll(right.exceptAll(left))
    return odd.agg((F.count("*") == 0).alias("same"))


def dedupe_first(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of each key, by seq: an aggregate, so copies meet only after each task has dropped its own."""
    return df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


def set_digest(digest: Column) -> Column:
    """An aggregate over hex digests of 256 bits that is free of order: the sums of their four words, and the number of rows, digested.

    Sums combine in any order within and between tasks; nothing is collected or sorted.
    """
    words = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(":", F.count(digest).cast("string"), *words), 256)


def dataset_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that depends on the multiset of rows, not on their order or partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.select(row.alias("d")).agg(F.count("*").alias("rows"), set_digest(F.col("d")).alias("digest"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.scratch import stored, table
from assayer.llm.slices import ranked

#: A source contributes each of its documents this many times at most; weights of the sources in order, repeating.
MOST_EPOCHS, WEIGHTS = 3, (1, 2, 3)
#: Slices in which the rows tied in a source's last place are ranked.
TIE_SLICES = 256
WORDS, JUNK, LOUD = r"[^\x20\x09-\x0D]+", "#$%&*!|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: falls with junk characters per word, with capitals and digits among the characters, and with words shorter than two or longer than twelve characters on average."""
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda of, n: (F.length(text) - F.length(F.translate(text, of, ""))) / n
    width = chars / F.greatest(size, F.lit(1))
    odd = F.when(width < 2, 0.5).when(width > 13, 0.5).otherwise(0.0)
    junk, loud = share(JUNK, F.greatest(size, F.lit(1))), share(LOUD, chars)
    return F.greatest(F.lit(0.1), 1.0 - F.coalesce(junk, F.lit(0.0)) - F.greatest(F.coalesce(loud, F.lit(0.0)) - 0.1, F.lit(0.0)) - F.coalesce(odd, F.lit(0.0)))


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Water filling in closed form: sources in the order of cap / weight reach their caps first; the level is that
    of the first source whose cap it does not exceed. The two windows see one row per source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1)).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    chosen = F.min(fits).over(Window.partitionBy())["level"]
    return levels.withColumn("chosen", chosen).select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("chosen", "level")).alias("target"))


def _sized(docs: DataFrame, quality: Column | None, *more: Column) -> DataFrame:
    named = docs.select("doc_id", "source", "text", F.lit(None).alias("quality") if quality is None else quality.alias("quality"), *more)
    return named.withColumn("size", text_size(F.col("text")))


def _key(seed: int, given: bool) -> Column:
    """-ln(u) / quality; u depends on doc_id, size and text, so that rows without an id are drawn each for itself."""
    weight = F.greatest(F.lit(1e-6), F.coalesce(F.col("quality").cast("double"), F.lit(1e-6))) if given else text_quality(F.col("text"), F.col("size"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))), 1, 13), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / float(2**52)) / weight


def mix_sources(docs: DataFrame, most: int = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, quality: Column | None = None) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, epochs, copies, taken), one row per input row.

    Complete epochs take every document of a source; the fraction left goes by Efraimidis-Spirakis: keys
    -ln(u) / quality ascending, summed up until the budget is met; the last document enters if at least half of
    it fits. So a source misses its target by half a document at most. quality: a positive weight per document (the
    score of a classifier, say), by default statistics of the text. A hot source is no single sort: all
    documents are range-partitioned by (source, key), partition totals give each partition its starting sum.
    Null texts have size 0, a null source is a source of its own (last); only rows equal in doc_id, size and text
    tie, and are interchangeable; each takes its own place. Empty tables give empty results.
    """
    spark = docs.sparkSession
    keyed = _sized(docs, quality).select("doc_id", "source", "size", _key(seed, quality is not None).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = stored(keyed, "sizes")  # ranges are found from a sample: the texts should not be read for it again
    keyed = keyed.repartitionByRange(4 * parts, F.asc_nulls_last("source"), "key", F.asc_nulls_last("doc_id"), "size")
    keyed = stored(keyed.withColumn("part", F.spark_partition_id()), "keys")
    totals = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    start = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = totals.select("source", "part", start.alias("start")).alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("of"), F.col("part").alias("in_part"), "start", "source_size", "target", epochs.alias("epochs"))
    joined = keyed.join(stored(plan, "plan"), keyed.source.eqNullSafe(F.col("of")) & (keyed.part == F.col("in_part")))
    running = Window.partitionBy("source", "part").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("start") + F.sum("size").over(running) - F.col("size")
    fraction = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = ((before + F.col("size") / 2 <= fraction) & (fraction > 0)).cast("int")
    copies = F.least(F.col("epochs") + extra, F.lit(most)).cast("int")
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _place() -> Column:
    """What the order within a source compares: key, then doc_id (null last), then size."""
    return F.struct("key", F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")


def repeat_by_mix(docs: DataFrame, most: int = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, quality: Column | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it; the texts stay where they are.

    The documents that enter beyond whole epochs are the first of their source's order, so a source's epochs and the
    place of its last one settle every row where it is read: only one row per source is joined. Rows in the last place
    itself (equal in doc_id, size and text) are stored and numbered in slices of their stored numbers, so they may be most
    of a source, and as many enter as the mix takes of them.
    """
    mixed = mix_sources(docs, most, weights, seed, quality).withColumn("extra", F.col("copies") - F.least("epochs", F.lit(most)))
    places = mixed.groupBy("source", _place().alias("place")).agg(F.sum("extra").alias("n"), F.first("epochs").alias("epochs"))
    cut = places.groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("n") > 0, F.struct("place", "n"))).alias("last"))
    cut = stored(cut.select(F.col("source").alias("of"), "epochs", F.col("last.place").alias("last"), F.col("last.n").alias("n_last")), "cuts")
    keyed = _sized(docs, quality, F.struct(*docs.columns).alias("row")).withColumn("key", _key(seed, quality is not None)).select("row", "source", _place().alias("place"))
    joined = keyed.join(cut, F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", F.least("epochs", F.lit(most)).cast("int"))
    tied = F.coalesce(F.col("place") == F.col("last"), F.lit(False))
    plain = joined.where(~tied).withColumn("copies", F.col("whole") + F.coalesce(F.col("place") < F.col("last"), F.lit(False)).cast("int"))
    last = stored(joined.where(tied).select("row", "of", "whole", "n_last", F.monotonically_increasing_id().alias("number")), "ties")
    ranks = ranked(last.select("of", "number", "whole", "n_last"), "of", ["number"], TIE_SLICES).select("number", (F.col("whole") + (F.col("rank") < F.col("n_last")).cast("int")).alias("copies"))
    ties = last.select("row", "number").join(ranks, "number").select("row", "copies")
    return plain.select("row", "copies").unionByName(ties).where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(text) AS chars, md5(coalesce(text, '')) AS digest,
         length(text) - length(translate(text, '#$%&*!|', '')) AS junk, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '')) AS loud
  FROM documents),
weighted AS (
  SELECT *, greatest(0.1, 1.0 - coalesce(CAST(junk AS DOUBLE) / greatest(size, 1), 0) - greatest(coalesce(CAST(loud AS DOUBLE) / greatest(chars, 1), 0) - 0.1, 0)
    - CASE WHEN text_width < 2 OR text_width > 13 THEN 0.5 ELSE 0 END) AS quality FROM (SELECT *, CAST(greatest(chars, 1) AS DOUBLE) / greatest(size, 1) AS text_width FROM sized)),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR) || '|' || digest), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / quality AS key
  FROM weighted),
weighed AS (
  SELECT source, sum(size) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, 3.0 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT min(level) FROM (SELECT level FROM levels WHERE cap / weight >= level ORDER BY cap / weight, source NULLS LAST LIMIT 1))) AS target
  FROM levels),
summed AS (
  SELECT k.doc_id, k.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

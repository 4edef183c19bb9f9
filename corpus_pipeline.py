"""A corpus pipeline over `documents`: toxicity, near copies, secrets, source mix, packing.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import mixing, packing, secrets, simhash, toxicity
from assayer.llm.scratch import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half stay, null and empty texts too if the model has it so.

    Repeated rows and rows without an id are scored each for itself; extra columns go; without labels all documents
    score alike, with the share of toxic ones that no label tells, one half, and stay.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where("score <= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, that with the smallest doc_id; rows without an id stay too.

    Rows of one id are told apart by a hash of all their columns, which any rerun gives alike: rows that repeat an id
    with unrelated texts all stay, and of near copies under one id that with the smallest hash. Only rows equal in
    every column, which are of one group, collapse. Null and empty texts are one group; extra columns go; an empty
    table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    marked = docs.withColumn("_mark", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    firsts = stored(simhash.first_rows(marked, "_mark"), "firsts")
    named = marked.where("doc_id is not null").join(firsts, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "_mark"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of a text becomes [SECRET]; all rows stay, null texts null and empty ones empty. n_chars follows the text."""
    found = secrets.mask_spans(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: null and empty texts have no words and cost nothing, a null source
    is a source of its own, equal rows enter one by one."""
    return mixing.repeat_by_mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slots of all pieces: every row has one at least, null and empty texts their end token; repeated rows one each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Hashes, regular expressions with positions and a trained model are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

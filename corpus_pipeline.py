"""From raw documents to tokens: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again for the next.  All but the last give the columns of ``documents`` (and any others that it
has, under any names) as they were, but for what the stage itself changes.  Texts of any length go through whole, and
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, decontaminate, ngram_join, pii, toxicity
from corpusmill.llm.store import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject as toxic.

    A null or empty text gets the base rate and stays; a probability at the threshold rejects; repeated rows and
    documents without an id are judged one by one; without labels nothing is rejected."""
    return toxicity.accepted(docs, toxicity.table_labels(spark, sf_dir))


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8: that with the smallest id, null last.

    Texts without words link with nothing and stay; rows equal in id and text are one document."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows are judged one by one; an empty benchmark rejects nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars counted anew.

    A null text stays null and has null n_chars; repeated rows each stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number and digest, and the digest of what they decode to.

    A null or empty text has no tokens; repeated rows are encoded one by one; other columns than id, language and
    source end here."""
    return byte_bpe.digest(docs.select("doc_id", "lang", "source", "text"), with_ids=True).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The fitted models and the tokens are beyond SQL; a test holds the stages, one after the other, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

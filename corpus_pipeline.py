"""The corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Each also bounds
the session's Arrow batches by size, see small_batches().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import gear, jaccard, packing, toxicity
from sparquill.llm.common import materialize, small_batches
from sparquill.llm.queries import PACK_SPECIAL, PACK_VOCABULARY, vocabulary

#: No stage's rows can be expressed in SQL: models, gear hashes and token ids.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of ``sf_dir``, scores 0.5 or more go. Rows are judged one by one by their text; a null or empty one stays."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies - 5-word Jaccard similarity of 0.8 or more - stays, that with the smallest doc_id.

    SimHash links and min-hash bands give the candidates, the texts decide. A null
    doc_id comes last, then the text's hash; rows that repeat an id and text are
    one; rows with one id and unrelated texts, or without ids, stay. Texts without
    a word are one group.
    """
    small_batches(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; n_chars follows the text. Documents of which only white space is left go.

    Rows with one doc_id are one document, rows without one are compared with
    themselves only. Null and empty texts stay as they are.
    """
    small_batches(spark)
    out = gear.deduplicate(docs)
    changed = F.size("repeat_spans") > 0
    out = out.filter(~changed | F.col("text").isNull() | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary(PACK_VOCABULARY), PACK_SPECIAL)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

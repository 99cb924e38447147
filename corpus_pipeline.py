"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm import mixing, nearjoin, packing, quality, substring
from graftwork.llm.common import discard, materialize
from graftwork.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go.

    A null or empty text has under 20 words, so it goes. Rows with a null id are judged like others, and each of repeated rows; other
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    return quality.kept_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Decided by row: repeated rows and copies with null ids go like any others, a null id coming last, and a row goes only if its
    own text has an earlier near copy, also where another row has its id. Texts that are null or have no words all stay. Other
    columns stay as they are; an empty table stays empty.
    """
    return nearjoin.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, and documents of which nothing is left.

    A null text stays null, and a text that loses nothing stays as it is; rows with a null id are compared with none, those of one
    id not with each other. n_chars is counted anew where words went; other columns stay as they are; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring.remove_repeats(docs, keep=tuple(rest)).where("n_words = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("kept_n_chars")) if "n_chars" in rest else None}
    return out.select(*(new.get(c, F.col(f"kept_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a row for each copy, whole or in part, that the mix takes, laid out by shards.

    A document without words isn't in the mix. A null source is one of its own; rows with a null id and repeated rows each have
    their own place; n_chars is counted anew for copies in part; other columns stay as they are; an empty table stays empty.
    """
    return mixing.mix_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, packed into sequences of 1024.

    A null or empty text is its end id alone; null ids stay null, repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned rules, MinHash classes and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            if k:
                discard(before)
    return docs

"""A training corpus from ``documents``: quality, near copies, repeated passages, mixture, sequences.

Each stage is one operator of ``equipoise.llm`` applied to all that the stage before it kept. It is
written as Parquet to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm import mixing, neardup, packing, quality, substrings
from equipoise.llm.common import table
from equipoise.session import cut_lineage

#: Near copies have at least this many hundredths of their shingles in common; op6's contract says 85, this stage's rule 80.
NEAR_PERCENT = 80
#: How far the mixture goes from the corpus' own shares (1) to equal shares (0).
POWER = 0.9
#: Share of the tokens that the mixture keeps.
KEEP = 0.85


#: The columns of documents that stages read or change; all others are only carried along.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def _with_columns_aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` applied to ``docs`` while further columns have private names; the result has the columns of ``docs`` again.

    So a column of any name and type, also one that an operator would add, comes out as it went in.
    """
    aside = {c: f"_equipoise_kept_{i}" for i, c in enumerate(docs.columns) if c not in USED}
    out = operator(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, f"`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model, which is fitted on the labelled ones among them.

    A null or empty text fails; a very long one is judged as a whole. Rows with one id, or none, are judged one by one.
    """

    def kept(rows: DataFrame) -> DataFrame:
        model = quality.train(rows, table(spark, sf_dir, "labels"))
        return quality.score_documents(rows, model, keep_columns=True).filter("quality_rules.kept")

    return _with_columns_aside(docs, kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words (null, empty) are nobody's copies and stay; rows equal in every column become one;
    rows without an id go where their group has one with an id.
    """
    return _with_columns_aside(docs, lambda rows: neardup.keep_one(rows, NEAR_PERCENT))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand more than once are cut out; a document of which nothing is left goes. n_chars is that of the new text.

    Null, empty and short texts stay as they are, as do long ones but for what repeats in them or elsewhere.
    """

    def cut(rows: DataFrame) -> DataFrame:
        left = substrings.remove_duplicates(rows).filter("n_removed = 0 or n_removed < n_words").withColumnRenamed("kept_text", "text")
        chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType)
        return left.withColumn("n_chars", chars)

    return _with_columns_aside(docs, cut)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens by source, language and topic follow tempered shares.

    A null source or language is a value of its own; a null or empty text has no tokens and is drawn like
    its cell's others. Rows with one id are drawn together.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        counted = cut_lineage(mixing.with_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"), topic_column="topic", lean=True))
        targets = mixing.tempered_targets(counted, ("source", "lang", "topic"), "n_tokens", POWER, KEEP)
        return mixing.mix(counted, targets, keep=KEEP).filter("sampled")

    return _with_columns_aside(docs, drawn)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 4096 tokens; a null or empty text is its end token. Further columns are left out."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, lean=True))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: No stage but the second and third can be said in SQL (a trained model, a tokenizer), so tests check them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

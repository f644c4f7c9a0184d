"""A training corpus from raw documents: filter, identify, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.cluster import ship
from papyra.llm import bpe, language_id, mixing, near_duplicates, quality
from papyra.operators.scratch import Scratch

#: Documents whose language is less sure than this are rejected. With four languages in two
#: families each winner has at least 0.25, so there it is the distance to the languages that decides.
LEAST_SURE = 0.05
#: The columns that stages read; all others pass through untouched.
READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that no stage reads under names that none of them appends, and how to get them back."""
    names = {c: c if c in READ else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null text counts as empty; a text without words is undecided by itself and goes with
    its site. Null sources form one site, null languages one path of a site. Repeated
    rows are judged alike and all stay or all go. Long texts are read whole. Without
    labels every document stays or goes with its site's rate. An empty table stays
    empty. Extra columns pass through, whatever their names.
    """
    ship(spark)
    docs, back = _apart(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(docs, labels, F.col("source"), F.col("lang"))
    return scored.where("keep").select(*back)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the identifier knows; those without letters or far from every language it learned go.

    Null, empty and letterless texts go. Rows without a language teach nothing but may
    stay. Repeated rows are judged alike. Long texts are read whole. Where nothing can be
    learned nothing stays. An empty table stays empty. Extra columns pass through.
    """
    ship(spark)
    docs, back = _apart(docs)
    train = docs.where(~language_id.is_held_out()).select(F.col("doc_id").alias("key"), "text", "lang")
    found = language_id.predict(docs, language_id.fit(train))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SURE) & (F.col("nearness") >= 0)
    return found.where(known).select(*back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of least id.

    Null text equals empty text; texts without words are near to equal ones only. Rows
    that repeat an id and a text become one, that of least hash over all columns. A null
    id stays only if all ids of the class are null. Long texts are compared whole. An
    empty table stays empty. Extra columns pass through.
    """
    ship(spark)
    docs, back = _apart(docs)
    return near_duplicates.keep_one_of_each(docs).select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics approach their target shares.

    Null sources and languages are categories of their own; null text is empty and has
    one token. Rows of equal id are drawn together, rows without id too. An empty table
    stays empty. Extra columns pass through.
    """
    docs, back = _apart(docs)
    return mixing.mix(docs).where("sampled").select(*back)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every row, repeated ones too.

    Null text is empty and has no tokens. Texts are encoded whole. An empty table stays
    empty. Extra columns are not read.
    """
    import public_tokenizers

    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), ranks, bytes_col="decoded"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixing", mixture),
    ("tokens", tokenized),
]

#: SQL cannot express the classifiers; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = made
    return docs

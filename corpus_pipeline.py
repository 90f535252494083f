"""A corpus from documents to tokens: each stage is one operator, its decisions take effect, and its result is a table.

1. language ID: documents without a letter, or that no learned language explains better than
   letter by letter, go;
2. quality classifier: documents that it takes for low quality go;
3. near duplicates (five-word shingles, similarity 0.8): one document of each group stays, the one
   of the smallest id; of repeated rows (equal id and text) one stays; documents without words link
   with nothing;
4. mixing: documents appear as often as the schedule takes them, none at all up to twice;
5. SentencePiece encoding and decoding of every whole text.

Defined cases: null and empty texts go in the first stage, as they hold no letter; a stage that meets
them all the same keeps or drops them as its operator says.  Null ids, and ids on several texts, are
rows of their own throughout.  Very long texts are taken whole.  Of equal languages the first by name
wins, of equal ids the smallest hash of the text stays.  Of an empty table every stage makes an empty
table.  Other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import jaccard, langid, mixing, pieces, rulefit
from tributary.llm.text import held_out, table
from tributary.plans.scratch import Scratch

#: Phrases a character from which on a text is in none of the languages; texts of a learned language have half of it at most.
MOST_PHRASES = 0.6
#: Scores of documents that stay.
LEAST_QUALITY = 0.5
#: Similarity in per cent and words of a shingle.
SIMILARITY, SHINGLE = 80, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = langid.sample(docs, ~held_out(F.col("doc_id"), 5, 0))
    kept = langid.predict(docs, labelled, "__lang", "__score", "__cost")
    return kept.filter((F.col("__lang") != langid.UNDETERMINED) & (F.col("__cost") <= MOST_PHRASES)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = rulefit.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return rulefit.score(docs, model, "__score").filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", F.xxhash64("text").alias("__key"))
    gone = Scratch(spark, "duplicates").save(jaccard.duplicates(docs, SHINGLE, SIMILARITY).select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")), "gone")
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone")), "left_anti")
    again = kept.groupBy("doc_id", "__key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    if again.isEmpty():
        return kept.select("__row.*")
    twice = again.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__gone"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone"))
    one = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return kept.join(twice, same, "left_anti").unionByName(one).select("__row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("sentencepiece", encoding),
]

#: Suffix automata, lasso rules and merge-type encoding have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: drop toxic documents, repeated lines and near duplicates, mix, encode.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame with the columns of documents; the last one returns the encoded rows. A stage's result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelsight.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from parcelsight.llm.common import Scratch, ship, stage, table
from parcelsight.llm.queries import tokenizer_path


class _Shield:
    """Columns of documents under names that no operator uses, but for those that it needs."""

    def __init__(self, docs: DataFrame, *needed: str) -> None:
        self.own = docs.columns
        self.hidden = {c: c if c in needed else f"__own_{i}" for i, c in enumerate(self.own)}
        self.docs = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in self.hidden.items()))

    def lift(self, df: DataFrame, **changed: Column) -> DataFrame:
        """The columns of documents again, ``changed`` ones from the operator's result."""
        return df.select(*((changed[c] if c in changed else F.col(f"`{n}`")).alias(c)
                           for c, n in self.hidden.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic.

    Null and empty texts are scored as empty ones, very long ones whole. Rows are scored one by one, repeated ones
    alike. Columns named like a score stay what they are. Without documents the result is empty; without labels
    of both classes nothing is dropped that the machine's constant doesn't call toxic.
    """
    ship(spark)
    shield = _Shield(docs, "doc_id", "text")
    machine = toxicity.fit(shield.docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return shield.lift(toxicity.score_toxicity(shield.docs, machine).filter("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them or more share; n_chars, where it is a column, follows the text.

    Null texts become empty ones, and a text may become empty; no row goes. Each row counts as a document, also one
    that repeats another. Other columns stay as they are. Without documents the result is empty.
    """
    ship(spark)
    shield = _Shield(docs, "doc_id", "text")
    kept = line_dedup.line_dedup(shield.docs)
    return shield.lift(kept, n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that with the smallest id (a null id only if there is no other).

    Texts without words have no duplicates; all their rows stay. Rows that repeat an id are told apart by their texts, and of
    rows with the same id and text one stays, whichever it is. Very long texts are compared whole. Columns stay as they
    are. Without documents the result is empty.
    """
    ship(spark)
    groups = stage(ngram_join.ngram_join(docs.select("doc_id", "text")), "near-duplicates")
    same = lambda df: (F.col("__id").eqNullSafe(F.col("doc_id"))
                       & (F.col("__mark") == F.xxhash64(df["text"])))
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    others = named(groups.filter(~F.col("kept"))).distinct()
    again = named(groups.filter(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "mark")
                  .agg(F.count("*").alias("n")).filter("n > 1"))
    single = docs.join(others.unionByName(again), same(docs), "left_anti")
    repeated = docs.join(again, same(docs)).dropDuplicates(["__id", "__mark"]).select(*(docs[f"`{c}`"] for c in docs.columns))
    return single.unionByName(repeated)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix: a row for each time that one is taken, in shards shuffled within.

    Null and empty texts have no words and are never taken; null sources are one source. Repeated rows are taken each.
    Other columns stay as they are. Without documents the result is empty.
    """
    ship(spark)
    shield = _Shield(docs, "doc_id", "text", "source")
    return shield.lift(mixing.mixed_rows(shield.docs, mixing.mix(shield.docs.select("doc_id", "text", "source"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens, very long ones are encoded whole. Rows are independent. Columns of documents named
    like a result give way to it. Without documents the result is empty.
    """
    ship(spark)
    return bpe.bpe_round_trip(docs, tokenizer_path(), ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained model and an automaton decide, which SQL cannot express; tests compare run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; a stage's table goes when the next one is written."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, work in STAGES[:-1]:
        docs = scratch.stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release(but=1)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Every stage takes any further columns, whatever they are called, and all but the last return
the columns that they were given. Null ids are ids that come last; repeated rows are documents
like others until a stage finds them to be copies; empty tables pass through all stages; texts
are read whole, however long.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bpe, decontam, langid, lines, minhash
from estatelens.llm._common import table, written
from estatelens.llm.queries import BPE_VOCABULARY, PIECE_VOCABULARY

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # of the predicted language: it is likelier than all others together
LEAST_FIT = -4.2  # log-probability of a character: texts of the learned languages have -3.5 and more, those of others -4.6 and less
LEAST_SHARE = 0.4  # of the letters: less is a jumble of languages
CLEAR_SHARE = 0.9  # of the letters, from which on a label that says otherwise is wrong


def shielded(stage):
    """The stage, with the documents' further columns under names that no operator uses while it runs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        own = [n if n in DOCUMENT else f"further_column_{i}" for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*own), sf_dir).select(*own).toDF(*names)

    return run


@shielded
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told; lang, where it is null, becomes that language.

    What goes: null texts and texts without letters; those of no learned language (LEAST_FIT),
    of no clear one (LEAST_SCORE) and jumbles of several (LEAST_SHARE); and those whose label
    says another language than nearly all of their words do (CLEAR_SHARE). The model learns
    from these documents' labels. Where none is labelled there is no language to tell, and
    texts with letters stay.
    """
    model = langid.learn(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter(~langid.held_out(F.col("doc_id"))), PIECE_VOCABULARY)
    if not model[0]:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    told = langid.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    told = told.filter((F.col("lang_fit") >= LEAST_FIT) & (F.col("lang_share") >= LEAST_SHARE))
    told = told.filter(F.col("lang").isNull() | (F.col("lang") == F.col("lang_pred")) | (F.col("lang_share") < CLEAR_SHARE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred"))


@shielded
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, the later ones; documents that lose every line, and null and blank texts, go. n_chars is that of the text that is left."""
    out = lines.drop_repeated_lines(docs, emptied=False)
    return out.withColumn("n_chars", F.length("text").cast("long"))


@shielded
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id (of equal rows, any); null and wordless texts all stay."""
    return minhash.one_of_each(docs)


@shielded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null texts hold none."""
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids of each document, and digests of the ids and of the text that they decode to; null texts have no tokens. Further columns end here."""
    out = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), BPE_VOCABULARY, keep_text=False)
    return out.drop("text")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]
ORACLE_SQL = None  # stages learn, hash and tokenise; tests/llm holds the run against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", sweep=True)
    return docs

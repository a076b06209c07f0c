"""A training corpus from raw documents: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, langid, linededup, mixing, simhash
from docquarry.llm.common import fresh, in_fold, joined_back, own, small_batches, table, text_hash, written

#: A document is rejected if it has no letter, if a model without a language explains it better than all languages, or
#: if no language is likelier than all others together.
MIN_LANGUAGE = 0.5


def _sized(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with n_chars, if docs has it, told anew from its text."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus's own lang column names; the rest goes.

    Null texts and texts without letters go; without any language in the corpus all documents go. Repeated rows are treated alike.
    """
    vocab = langid.vocabulary()
    langs, p = langid.trained(docs.where(~in_fold(F.col("doc_id"), 3, 1)), vocab)
    langs, p = langid.with_unknown(langs, p)
    known = langid.identified(docs.select("doc_id", "text"), langs, vocab, p)
    odd = known.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("lang_score") < MIN_LANGUAGE))
    with small_batches(spark):
        odd = written(odd.select("doc_id", text_hash().alias("text_hash")).distinct(), "odd")
    (name,) = fresh(docs, "odd")
    return joined_back(docs, odd, name).where(F.col(name).isNull()).select(*own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are part of an earlier run; documents of which no word is left go.

    Null and empty texts stay as they are, and so does an empty table. Repeated rows lose the same lines.
    """
    out = linededup.line_dedup(docs)
    some = (F.col("_lines.n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _sized(out.where(some | F.col("text").isNull()), docs).select(*own(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group whose 5-word shingles are alike to 0.8 or more.

    Texts without words, null ones too, are one group, and rows that agree in doc_id and text are one document.
    """
    return simhash.simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth, without these windows.

    Null and empty texts stay; without benchmark items all documents stay as they are.
    """
    return _sized(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row each time that a document is taken, with epoch and the words taken; the last of a source may be cut.

    Documents without words are never taken. Null sources are one source.
    """
    return _sized(mixing.mixed(docs), docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: Language ID can't be said in SQL; tests hold each stage against SQL or brute force on its own input.
ORACLE_SQL = None

"""A training corpus in five stages: clean, deduplicate, redact, mix and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import discard, documents, intermediate, written
from attesta.llm.mixing import take_mix
from attesta.llm.ngram_join import keep_one_each
from attesta.llm.packing import pack_documents
from attesta.llm.secrets import redact_secrets
from attesta.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go.

    Null and empty texts have no words and stay; equal texts and repeated rows go or stay together; extra columns stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays.

    Null, empty and wordless texts are linked with nothing and stay; rows that repeat an id and a text are one document.
    """
    return keep_one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark.

    Null and empty texts stay as they are, repeated rows are each redacted alike, and n_chars follows the new text.
    """
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights: documents are repeated, cut or left out.

    A null source is a source; null and empty texts have no words and are not taken; ties and repeated rows are ordered by
    hashes of the whole row, so reruns agree.
    """
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences.

    A null or empty text is its end token alone; long ones are cut into pieces; repeated rows are each packed.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("ngram_join", keep_one_of_near_copies),
    ("secrets", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: The ordinal model and the tokenizer have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: token pieces, packed into sequences.

    Nulls in any column, empty and very long texts, ties and repeated rows pass as each stage says; an empty table gives
    no rows. What a stage has written is deleted once the next one's input is stored; only the last stage's tables stay,
    as the result reads them.
    """
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        with intermediate() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 == len(STAGES):
                break
            docs = written(docs, f"stage_{name}")
        discard(*(t for t in made if t is not docs), *([] if before is None else [before]))
        before = docs
    return docs

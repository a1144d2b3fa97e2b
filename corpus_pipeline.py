"""A corpus pipeline: language, quality, near-duplicates, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
decide for a whole row by its own text or, for near-duplicates, by all rows of their input. Documents with a null text go
in the first stage, as they have no language. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelab.llm import common, decontamination, jaccard, langid, quality, sentencepieces
from edgelab.llm.queries import PIECES, tokenizer_path
from edgelab.shipping import ship

#: Quality below this is rejected.
LEAST_QUALITY = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that need more bits a letter than their language was seen to need."""
    ship(spark)
    model = langid.fit(docs, 3, 1)
    names = common.free_names(docs.columns, "lang_pred", "score", "bits")
    lang, _, bits = map(F.col, names)
    near = reduce(lambda x, y: x | y, [(lang == g) & (bits <= most) for g, most in sorted(model.most_bits.items())], F.lit(False))
    return langid.predict(docs, model, docs.columns, names).filter(near).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under LEAST_QUALITY."""
    ship(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), 4, 2)
    (name,) = common.free_names(docs.columns, "score")
    return quality.score(docs, model, docs.columns, name).filter(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that Jaccard links join."""
    ship(spark)
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    ship(spark)
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces, ids_crc32, restored."""
    ship(spark)
    return sentencepieces.encode(docs, tokenizer_path(PIECES), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language),
    ("quality", good_quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", tokenised),
]
#: Trained models have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark) as keep:
        for name, stage in STAGES:
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep(docs)

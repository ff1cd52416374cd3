"""Corpus pipeline: language ID, near-duplicate removal, surrogates for personal data, mixing, packing.

Each stage works on all rows that the one before kept, written as Parquet and read again. All but the
last return the columns of ``documents``. Rows with a null id take part in every stage but the second, which
links them with nothing and keeps them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skytile.llm import jaccard, language, mixing, packing, surrogates
from skytile.session import free_prefix, release, ship, stored

#: Texts whose calibrated score is below this are rejected, as are those without any letter: no language is likelier
#: than all others together.
LEAST_SCORE = 0.5
#: Largest repetition of a source in the mix; every source is used in full at least once.
MAX_REPEAT = 1.5


def _begin(spark: SparkSession) -> None:
    """Sources for the workers; what the stage before held on the driver goes."""
    ship(spark)
    release(spark)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go. All stay if no language is taught."""
    _begin(spark)
    model = language.train(docs)
    if not model.langs:
        return docs
    own = free_prefix(docs, start="lang") + "id"
    found = language.predict(docs, model, out_col=own)
    return found.where((F.col(f"{own}.lang_pred") != language.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles of similarity 0.8 or more.

    Equal rows count once; rows without a word or an id are groups of their own.
    """
    _begin(spark)
    out = jaccard.first_of_each(docs, k=5, percent=80, extra=0.04).select(*docs.columns)
    release(spark)
    return out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for the personal data in their texts."""
    _begin(spark)
    out = surrogates.replace(docs, surrogates.session_key(spark))
    release(spark)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources asks, each at least once."""
    _begin(spark)
    return mixing.mix(docs, max_repeat=MAX_REPEAT).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    _begin(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: No SQL form of the classifier, the keyed surrogates and the tokenizer; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs

"""A corpus pipeline over the table ``documents``, built from the operators in ``tableloom.llm``.

Every stage takes any documents: null ids, null, empty or very long texts, ties,
repeated rows, no rows, and further columns of any name, which pass through.
Each says below what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import decontaminate, lines, packing, quality, simhash
from tableloom.llm.columns import free_name
from tableloom.session import configure, materialise

MIN_DOCS = 10  # documents that share a line before it goes
NEAR_WORDS, NEAR_BITS = simhash.WORDS, simhash.RADIUS
WINDOW = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep.

    A null or empty text has no words and goes; repeated rows are judged alike;
    texts are read whole; without labels the base rule alone decides.
    """
    configure(spark)
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _opened(quality.score(_wrapped(docs), trees).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay in the first of them only; a document left without words goes.

    The first is that of the smallest id (null first), then text and place; a
    null id is one document. Texts that lose nothing stay as they are, null
    and empty ones too; repeated rows share what is kept; ``n_chars`` follows
    the text.
    """
    configure(spark)
    kept = lines.apply(_wrapped(docs), lines.find(docs, min_docs=MIN_DOCS, keep_first=True))
    kept = _opened(kept.where((F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(lines.SPACE)) != "")), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints: the smallest id.

    Null and empty texts have the fingerprint zero and are a group. A null id
    stays only where no other is in the group. Of different texts under the
    smallest id the one with the smallest digest stays, of repeated rows one.
    """
    configure(spark)
    found = simhash.components(docs, NEAR_BITS, NEAR_WORDS)
    one = _rows_of(docs, simhash.representatives(found), "left_semi")
    # Repeated rows are equal in both columns.
    return one.dropDuplicates(["doc_id", _version(docs)]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows are told apart by id and text, so another text under the id of a
    leaking one stays. Null and empty texts hold no passage; repeated rows go
    or stay together; an empty benchmark takes nothing.
    """
    configure(spark)
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rows_of(docs, leaks.select("doc_id", "version").distinct(), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece with the end id alone; repeated rows are
    packed as often as they occur; very long texts are cut into pieces; no
    documents give no pieces.
    """
    configure(spark)
    return packing.pack(docs, window=WINDOW)


def _wrapped(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns in one, so that their names meet none of an operator's results."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("_others"))


def _opened(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_others.`{c}`").alias(c) for c in docs.columns])


def _version(docs: DataFrame) -> str:
    return free_name(docs, "_version")


def _rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) their id and version in ``keys``; a null id is an id."""
    mark, key, other = _version(docs), free_name(docs, "_key_id"), free_name(docs, "_key_version")
    keys = keys.select(F.col("doc_id").alias(key), F.col("version").alias(other))
    rows = docs.withColumn(mark, lines.version(F.col("text").cast("string")))
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(other)), how)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sequence_packing", pack),
]

# Boosted trees, fingerprints and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to token sequences: language ID, near-dedup, mixing, segmentations.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from spanloom.llm import jaccard, language_crf, segmentations
from spanloom.llm.common import bounded_batches, quoted, table, written
from spanloom.llm.queries import MIX, language_model, mixed, tokenizer_file

#: Mean label probability below which a document's language is not settled.
SETTLED = 0.4
#: Words of a fingerprint's shingle, as in op6. Five-word shingles are compared besides (``jaccard``).
SHINGLE_WORDS = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a settled language; null texts and texts without a letter go.

    Null ids and languages, repeated rows and further columns, whatever their names, stay as they are.
    Without a labelled row nothing is settled and nothing kept.
    """
    bounded_batches(spark)
    found = language_crf.identify(docs, language_model(docs), names=("\0lang", "\0score"))
    return found.where((F.col("\0lang") != language_crf.UNKNOWN) & (F.col("\0score") >= SETTLED)).drop("\0lang", "\0score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of op6's links and of five-word Jaccard links.

    It is the row of the smallest id. A null id is one as others are but comes last: it is kept where a
    component has no other. Of rows that share id and text, the first by their other columns is kept.
    Texts are told apart by 64 bits; should two have the same, one of them goes through the links and the others
    are compared with their own copies alone, so none is dropped for another.
    """
    bounded_batches(spark)
    shared = written(jaccard.shared_ids(docs), "shared-ids")
    if shared.isEmpty():
        return _first_of_classes(docs)
    columns, text = [*map(quoted, docs.columns)], F.col("text")
    marked = docs.select("*", jaccard.text_id(text).alias("\0text"), jaccard.second_id(text).alias("\0second")).join(shared.toDF("\0text", "\0main"), "\0text", "left")
    stray = F.coalesce(F.col("\0second") != F.col("\0main"), F.lit(False))
    main, rest = written(marked.where(~stray).select(*columns), "main"), written(marked.where(stray).select(*columns, "\0second"), "strays")
    place = F.row_number().over(Window.partitionBy("\0second").orderBy(F.col("doc_id").isNull(), "doc_id", *_ordered(docs)))
    first = rest.withColumn("\0place", place).where(F.col("\0place") == 1)
    return _first_of_classes(main).unionByName(first.select(*columns))


def _ordered(docs: DataFrame) -> list[str]:
    return [quoted(f.name) for f in docs.schema if not isinstance(f.dataType, MapType)]


def _first_of_classes(docs: DataFrame) -> DataFrame:
    found = jaccard.near_duplicates(docs, width=SHINGLE_WORDS)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_id")).alias("row"))
    plain = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("\0id"), F.col("doc_id").isNull().alias("\0none"))  # equal where ids are, nulls too
    keys = ["\0text", "\0id", "\0none"]
    kept = first.select("row.*").select(F.col("text_id").alias("\0text"), *plain)
    rows = docs.select("*", jaccard.text_id(F.col("text")).alias("\0text"), *plain).join(kept, keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_ordered(docs)))
    return rows.withColumn("\0place", place).where(F.col("\0place") == 1).select(*map(quoted, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the production mix draws them.

    Null sources and languages are the empty name, rows of one id are drawn together, texts without a
    word never; further columns, whatever their names, stay as they are.
    """
    drawn = mixed(docs, MIX, F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), "\0copies")
    times = F.explode(F.array_repeat(F.lit(1), F.col("\0copies").cast("int"))).alias("\0draw")
    return drawn.where(F.col("\0copies") > 0).select(*map(quoted, docs.columns), times).drop("\0draw")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document: doc_id, rank, ids, scores, round_trip.

    Rows that share id and text give the same rows each; further columns are ignored.
    """
    bounded_batches(spark)
    return segmentations.sample_segmentations(docs, tokenizer_file("piece_bpe_32k.model"), k=2)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mixing_stage), ("SentencePiece segmentations", sentencepiece)]

#: A conditional random field and sampled segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: raw documents to clean, coded training text, one operator a stage.

Every stage takes all rows its predecessor kept, and its decisions take effect.  All
but the last return the columns of documents; columns that an operator would use for
itself are set aside and put back.  A null text counts as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard, pieces, quality, secrets
from loomgraph.llm.tables import keep, read


#: most ids of copies that are sent to every executor (8 MB)
BROADCAST_ROWS = 1_000_000


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with clashing columns renamed; `_back` undoes it."""
    return docs.withColumnsRenamed({n: f"__kept_{n}" for n in names if n in docs.columns})


def _back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"__kept_{c}" if f"__kept_{c}" in docs.columns else c).alias(c) for c in columns))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Repeated rows are judged each; a null or empty text has the score of no words at all;
    without documents or labels nothing is learnt and the share of label 1 decides.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.quality_scores(_aside(docs, "held_out", "score", "predicted"), labels)
    return _back(scored.where("predicted = 1"), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies; of rows that repeat a doc_id, that of the least text.

    Columns beside the text break ties in their order.  Rows with a null doc_id can't be
    told apart and stay, as do texts without words; an empty table gives none.
    """
    found = keep(jaccard.jaccard_components(docs.where("doc_id IS NOT NULL")), "groups")
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    if copies.count() <= BROADCAST_ROWS:  # then no text is shuffled; beyond it the join sorts both sides
        copies = F.broadcast(copies)
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        least = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
        kept = least.select("doc_id", "row.*").select(*docs.columns).unionByName(kept.where("doc_id IS NULL"))
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and with an empty benchmark all stay."""
    found = decontaminate.find_items(_aside(docs, "matches"), read(spark, sf_dir, "benchmark"))
    return _back(found.where("size(matches) = 0"), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret masked in the text; n_chars is the masked text's.

    Spans that overlap have one mask; a null text becomes an empty one; repeated rows stay.
    """
    scanned = secrets.secret_scan(_aside(docs, "secret_spans", "masked_text"))
    changed = {"text": F.col("masked_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("secret_spans") == "", F.col("n_chars")).otherwise(F.length("masked_text")).cast(docs.schema["n_chars"].dataType)
    return _back(scanned.withColumns(changed), docs.columns)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its best segmentations.

    Of segmentations with equal scores the choice is a fixed one; an empty text has no
    ids; repeated rows have a row each.
    """
    named = docs.select(*(c for c in ("doc_id", "lang", "source", "text") if c in docs.columns))
    out = pieces.encode_texts(named, public_tokenizers.path("piece_bpe_32k.model"))
    scores = F.transform("n_best", lambda b: b["score"]).alias("scores")
    return out.select(*(c for c in named.columns if c != "text"), "n_pieces", "ids", "best_score", scores, "lossless")


#: (name, function of (spark, docs, sf_dir)) in the order they run
STAGES = [
    ("quality", by_quality),
    ("near_copies", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("pieces", coded),
]

#: the stages fit models, which SQL cannot express; tests compare with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs

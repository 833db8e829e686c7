"""From raw documents to token ids, each with its place in the order of training.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` on all that the
one before it kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, near_duplicates, pii, quality_classifier
from millrace.llm.common import remainder, stored, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns as ``op9`` does.

    A row goes if its text is rejected, whatever its id: equal ids and texts
    score alike.
    """
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    # The text's own hash tells rows apart that repeat an id.
    whole = docs.select(
        F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"),
        "doc_id",
        "text",
    )
    featured = stored(
        quality_classifier.with_features(whole.select(F.col("key").alias("doc_id"), "text")),
        "quality-features",
    )
    model = quality_classifier.train(featured.select("doc_id.doc_id", "features"), labels)
    rejected = (
        quality_classifier.score(featured, model)
        .filter(F.col("score") < quality_classifier.THRESHOLD)
        .select("doc_id.*")
        .distinct()
    )
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")
    )
    gone = rows.id.eqNullSafe(rejected.doc_id) & (rows.text_hash == rejected.hash)
    return rows.join(rejected, gone, "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; rows without an id stay."""
    joined = near_duplicates.join_similar(docs)
    kept = near_duplicates.one_per_class(docs, joined)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark for each span of personal data."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return mixing.training_order(docs, mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, position, n_tokens, ids_sha256, decoded_sha256, ids`` per row;
    sorting by ``position`` gives the order of training."""
    keyed = docs.select(
        F.struct(F.col("doc_id").alias("id"), written_place(docs).alias("position")).alias("doc_id"), "text"
    )
    encoded = bpe.digest(bpe.encode(keyed, bpe.default_vocabulary()), "ids")
    return encoded.select(
        F.col("doc_id.id").alias("doc_id"),
        "doc_id.position",
        *[c for c in encoded.columns if c != "doc_id"],
    )


def written_place(docs: DataFrame) -> Column:
    """A long per row, different for each, that rises in the order in which a
    sorted stage was written: the number of its file, then the row in that file.

    A scan deals files to tasks by size, so the order of rows read is another.
    Rows that come from no file are numbered in their order.
    """
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["row_index"])
    except AnalysisException:
        return F.monotonically_increasing_id()
    # part-<number of the task>-<id of the write>-c<number of its file>
    name = file["file_name"]
    task = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")
    again = F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long")
    return F.shiftleft(task, 40) + F.shiftleft(again, 32) + file["row_index"]


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

# The classifier, the MinHash bands and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard, mixing, quality, secrets
from graphloom.llm.columns import fresh, held_out
from graphloom.runtime import materialize, scratch, small, table

#: Words of a shingle, and the least similarity in hundredths, of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores 0.3 or more. Learns outside the held-out fold.

    Null and empty texts are scored like any other; repeated rows and rows of one
    id are judged each by its own text; a null id has no label; without labels
    every document stays; no documents give none; columns pass through, whatever
    their names.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "quality")
    known = small(labels.select("doc_id").distinct())
    stats = materialize(quality.stats_of(docs.select("doc_id", "text").join(known, "doc_id"), ["doc_id"]), "quality-stats")
    scored, score = quality.score_documents(docs, quality.fit(stats, labels))
    return scored.where(F.col(score) >= 0.3).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the n-gram Jaccard join (five words, 0.8): that of the smallest id.

    Texts without words (null, empty, blank) are in no class and all stay. Where
    ids repeat, a class whose smallest id stands in several rows keeps the least
    of its texts there, and of equal rows one. A class of null ids keeps one row.
    No documents give none; columns pass through, whatever their names.
    """
    found = materialize(jaccard.similar_documents(docs, SHINGLE, PERCENT), "pipeline-classes")
    twice = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    gone = found.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    gone_id, again_id, class_doc, class_set, class_key = (fresh(docs, c) for c in ("gone_id", "again_id", "class_doc", "class_set", "class_key"))
    if twice.isEmpty():
        # ids are unique: what isn't its class's smallest goes
        gone = small(materialize(gone, "pipeline-dropped").withColumnRenamed("doc_id", gone_id))
        return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(gone_id)), "left_anti")
    # an id that stands in several rows says nothing about a row: those rows are told apart by their sets
    gone = small(materialize(gone.union(twice).distinct(), "pipeline-dropped").withColumnRenamed("doc_id", gone_id))
    single = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(gone_id)), "left_anti")
    again = small(twice.withColumnRenamed("doc_id", again_id))
    rows, key = jaccard.with_set_keys(docs.join(again, docs["doc_id"].eqNullSafe(F.col(again_id)), "left_semi"), SHINGLE)
    classes = found.where("n_shingles > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    classes = classes.select(F.col("doc_id").alias(class_doc), F.col("set_key").alias(class_set), F.col("class_key").alias(class_key)).distinct()
    held = rows.join(classes, rows["doc_id"].eqNullSafe(F.col(class_doc)) & (rows[key] == F.col(class_set)))
    # the least text is found by partial aggregates, so a class of any size is no task's burden
    held = held.groupBy(class_key).agg(F.min_by(F.struct(*[held[c] for c in docs.columns]), held["text"]).alias("row")).select("row.*")
    return single.unionByName(held).unionByName(rows.where(F.col(key) == -1).select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's template.

    Null and empty texts hold none; rows with equal texts go or stay together,
    whatever their ids; an empty benchmark drops nothing; no documents give none;
    columns pass through, whatever their names.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, each found alike however often it stands there; all documents stay.

    Null texts stay null, empty ones empty; n_chars follows a changed text, other
    columns pass through, whatever their names; no documents give none.
    """
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target weight asks for.

    Null and empty texts have size 0 and are emitted at their source's rate, like
    others; a null source is a source; a source without words is emitted not at
    all; equal rows get equal decisions; no documents give none; columns pass
    through, whatever their names.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
]

#: A classifier's and a forest's decisions have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage made on its way, and what it read, goes when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            made += last
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            last = [made.pop()]
    return docs

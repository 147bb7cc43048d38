"""The queries of this subpackage, each applying one operator to its whole table, with DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, chroma, decontamination, jaccard, licenses, lm, mixing, quality, secrets, toxicity
from graphloom.llm.columns import held_out
from graphloom.llm.oracles import SQL
from graphloom.runtime import materialize, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    stats = materialize(quality.stats_of(docs, ["doc_id"]), "quality-stats")
    model = quality.fit(stats.where(~out), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_stats(stats, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from their formatted strings."""
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from all embeddings: their classes of equal fingerprints and, for every hundredth, each class aligned with it (a row for each; one row without any)."""
    rows, found = chroma.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)
    found = found.withColumnRenamed("class_id", "of_class")
    return rows.join(found, F.col("is_query") & (F.col("class_id") == F.col("of_class")), "left").select(
        F.col("id").alias("vec_id"),
        "is_query",
        "class_id",
        "n_codes",
        "codes_sha256",
        "match_class",
        F.col("offset").alias("match_offset"),
        F.col("votes").alias("match_votes"),
        F.col("overlap").alias("match_overlap"),
        F.col("error_rate").alias("match_error_rate"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose template it holds."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score."""
    scanned, name = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return scanned.select("doc_id", F.explode(name).alias("f")).select(
        "doc_id",
        F.col("f.ordinal").alias("ordinal"),
        F.col("f.start").alias("start"),
        F.length("f.candidate").alias("length"),
        F.sha2("f.candidate", 256).alias("candidate_sha256"),
        F.col("f.score").alias("score"),
        F.col("f.is_secret").alias("is_secret"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document under smoothed counts and under the network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 1)
    learned = docs.where(~out)
    counts = materialize(lm.word_counts(learned), "lm-counts")
    vocabulary = lm.Vocabulary(counts)
    model = lm.train(learned, vocabulary)
    scored = lm.with_rare_words(lm.score_documents(docs, vocabulary, model), counts, vocabulary)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    planned, name = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    m = F.col(name)
    return planned.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"), "source")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, class of linked documents and number of linked sets."""
    found = jaccard.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    scanned, name = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(name)
    base, notices = F.transform(s["places"], lambda p: p["label"]), F.transform(s["templates"], lambda t: t["label"])
    best = F.coalesce(F.array_max(F.transform(s["templates"], lambda t: t["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        F.aggregate(s["places"], F.lit(0).cast("long"), lambda a, p: a + p["count"]).alias("n_base"),
        F.array_min(F.transform(s["places"], lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(s["places"], lambda p: p["last"])).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, notices))), ",").alias("labels"),
        F.when(F.size(s["places"]) > 0, 1.0).otherwise(best).alias("score"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic"))
    scored, name = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    ops = (op1_quality_classifier, op2_chat_formatting, op3_chroma_fingerprints, op4_decontamination, op5_secret_scan, op6_lm_scoring, op7_source_mixing, op8_ngram_jaccard_join, op9_license_scan, op10_toxicity)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

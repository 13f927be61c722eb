"""The registered queries of the text operators; each gets its rows through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import bpe, decontaminate, fingerprints, html, jaccard, language, licenses, lines, quality, ranked, runs, sharding, toxicity
from twinframe.llm.common import table

BPE_FILE = "byte_bpe_50k.json"


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``: which rows are held out from learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", "url", html.extract("html", html.fit(pages)).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "documents").select("doc_id", licenses.scan("text").alias("x")).select("doc_id", "x.*")
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "n_words", "n_equal")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = [r for r, _, _ in quality.ordered(docs, [*quality.base_rules(), *quality.own_rules()])]
    judged = quality.judged(docs, rules)
    base_failed = quality.base_rules()[0].rejects | quality.base_rules()[1].rejects
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), sharding.tree(24), sharding.tree(25))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder(3) != 1))
    found = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), language.predict("text", model).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    g = F.floor(h / 10)

    def repeating(words: Column, a: Column, p: Column) -> Column:
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # A tenth of the documents repeat a stretch of their own words to the end.
    parts = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), (g % F.greatest(F.size(w), F.lit(1))).alias("a")))
    parts = F.transform(parts, lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + g % 8))).alias("p")))
    made = F.get(F.transform(parts, lambda x: repeating(x["w"], x["a"], x["p"])), F.lit(0))
    text = F.when((h % 10 == 0) & (F.length(F.array_join(words, "")) > 0), made).otherwise(F.col("text"))
    found = runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = found.withColumn("best", first)
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    shown = F.when(F.size("runs") > 0, F.concat(shown, F.lit("\n"))).otherwise("")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000 * -best.l DIV best.p").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_fingerprints": op11_fingerprints,
    "op12_ranked_search": op12_ranked_search,
    "op13_periodic_runs": op13_periodic_runs,
}

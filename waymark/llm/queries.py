"""The operators over the given tables, with the settings they are meant to run with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import (
    chat, compression_bands, exact_dedup, language, mixing, packing, partenum, prefix_tokens, resampling,
    spelling, spotsigs, substrings, toxicity,
)
from waymark.llm.common import checkpointed, crc_bucket
from waymark.session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    back = chat.read_back(chat.format_conversations(given.unionByName(planted)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_source_mixing(spark, sf_dir):
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_token_counts(spark, sf_dir):
    from public_tokenizers import path

    limit = 4096
    counts = prefix_tokens.longest_prefix(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), limit)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept", "kept_tokens")


@query
def op4_quality_rules(spark, sf_dir):
    return compression_bands.quality(table(spark, sf_dir, "documents"))


@query
def op6_best_fit_packing(spark, sf_dir):
    from public_tokenizers import path

    made = checkpointed(packing.pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json")))
    return packing.pack(made)


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id") == 2
    model = language.learn(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket("doc_id") == 2
    model = toxicity.learn(docs, labels.withColumnRenamed("toxic", "label"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_spot_signatures(spark, sf_dir):
    return spotsigs.beside_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text("sig").alias("fingerprint"), spotsigs.as_text("edited_sig").alias("edited_fingerprint"),
        spotsigs.likeness("sig", "edited_sig").alias("near_edited"), spotsigs.likeness("sig", "next_sig").alias("near_next"),
    )


@query
def op9_substring_dedup(spark, sf_dir):
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_ngram_jaccard_join(spark, sf_dir):
    return partenum.near_groups(table(spark, sf_dir, "documents"))


@query
def op11_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = exact_dedup.drop_repeats(docs, exact_dedup.earlier_half(docs))
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op12_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gain = resampling.gains(docs, table(spark, sf_dir, "benchmark"))
    return resampling.draw(resampling.scores(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))

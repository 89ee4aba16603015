"""One query per operator, over whole tables, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personaloom.llm import chat_format, conversation_repair, decontaminate, edit_counts, jaccard_join, lexical_search, license_scan, minhash_dedup, mixing, quality, sharding, token_store, topk_search
from personaloom.llm.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def byte_vocabulary() -> str:
    """The installed vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat_format.digest_query(table(spark, sf, "conversations"), shared_folder(spark), byte_vocabulary())


@query
def op3_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf, "embeddings"), k=10, every=100)


@query
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents")).drop("link")


@query
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op7_token_store(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    token_store.write_token_ids(table(spark, sf, "documents"), path, byte_vocabulary(), end_id=2)
    return token_store.document_spans(spark, path)


@query
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf, "documents"), jaccard_join.Rule(n=3, percent=90))


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    grown = edit_counts.with_trees(table(spark, sf, "documents"), byte_vocabulary())
    done = edit_counts.apply_edits(edit_counts.with_personal_edits(grown), byte_vocabulary())
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded")


@query
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents")).drop("spans")


@query
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


@query
def op12_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"), jaccard_join.Rule(n=5, percent=85))


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damaged(conversations))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)

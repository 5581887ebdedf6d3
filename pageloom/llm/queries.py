"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, bpe_count, conversation_trie, decontaminate, langid, license_scan, mix, quality, shard, simhash, toxicity, vector_codes
from .common import in_fold, read, written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, quantisers = ann.build_index(read(spark, sf_dir, "embeddings"))
    return ann.search(index, quantisers, index.filter("vec_id % 100 = 0").select("vec_id", "vector"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe_count.read_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe_count.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(read(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    profiles = langid.learn_profiles(docs.filter(~held_out))
    return langid.identify_language(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host; its documents of one language are a path."""
    held_out = in_fold(F.col("doc_id"), 5, 0)
    path = F.concat_ws("/", "source", "lang")
    scored = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out, F.col("source"), path)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "site_rate", "evidence")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    lexicon = toxicity.learn_lexicon(docs.filter(~held_out), read(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe_count.read_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    both = bpe_codec.decode(encoded, vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(conversation_trie.turns_in_order(read(spark, sf_dir, "conversations")))
    nodes, ends = conversation_trie.prefix_trie(*conversation_trie.rebranched(turns))
    none = F.sha2(F.lit(""), 256)
    return nodes.join(conversation_trie.ids_digest(ends), "sequence", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors)
    sums = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", vector_codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_vector_codes": op13_vector_codes,
}

"""One thin query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepforge.llm import chat, decontam, dedup_exact, dedup_near, langid, manifest, mixing, phrases, pii, quality, tokens, toxicity, warc
from stepforge.llm.shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.derive(warc.responses(table(spark, sf_dir, "pages"))))


def op5_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_shards(tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_near.near_groups(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.rotate(table(spark, sf_dir, "conversations")))


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op11_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_bitmap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_systematic_mix,
        op2_ppm_language,
        op3_nbsvm_toxicity,
        op4_warc_derivatives,
        op5_elias_fano_tokens,
        op6_simhash_decontamination,
        op7_minhash_forest,
        op8_perspective_rotation,
        op9_block_naming,
        op10_weak_label_quality,
        op11_boosted_pii,
        op12_phrase_automata,
        op13_bitmap_manifest,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_systematic_mix": mixing.ORACLE_SQL, "op8_perspective_rotation": chat.ORACLE_SQL, "op9_block_naming": dedup_exact.ORACLE_SQL, "op12_phrase_automata": phrases.ORACLE_SQL, "op13_bitmap_manifest": manifest.ORACLE_SQL}

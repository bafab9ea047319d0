"""The registered queries of this subpackage, each an operator with production parameters over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegrid.llm import chat, decontam, fingerprints, html, langid, mixing, quality, runs, sharding, simhash, spelling, substring, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark, sf_dir):
    return quality.op1(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark, sf_dir):
    return html.op2(_table(spark, sf_dir, "pages"))


def op3_hilbert_shards(spark, sf_dir):
    return sharding.op3(_table(spark, sf_dir, "documents"))


def op4_chat_windows(spark, sf_dir):
    return chat.op4(_table(spark, sf_dir, "conversations"))


def op5_training_order(spark, sf_dir):
    return training_order.op5(_table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.op6(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_simhash_components(spark, sf_dir):
    return simhash.op8(_table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark, sf_dir):
    return decontam.op9(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_repeated_passages(spark, sf_dir):
    return substring.op10(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.op11(_table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark, sf_dir):
    return fingerprints.op12(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return runs.op13(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_frequency, op2_html_main_text, op3_hilbert_shards, op4_chat_windows, op5_training_order, op6_language_id, op7_source_mix, op8_simhash_components, op9_benchmark_leaks, op10_repeated_passages, op11_spelling_variants, op12_document_fingerprints, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": quality.ORACLE, "op7_source_mix": mixing.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_document_fingerprints": fingerprints.ORACLE, "op13_periodic_runs": runs.ORACLE}

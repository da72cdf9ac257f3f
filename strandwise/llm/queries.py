"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import brown, chat, decontam, mixing, neardup, pii, quality, records, suffix, telephony
from .common import shared_dir, table

END_ID = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark, d):
    return suffix.repeated_spans(table(spark, d, "documents")).drop("removed")


def _op2(spark, d):
    from .common import cut

    stored = cut(telephony.store_texts(table(spark, d, "documents")), f"{shared_dir(spark)}/media")
    return telephony.load_media(stored)


def _op3(spark, d):
    return mixing.mix(table(spark, d, "documents"))[0].drop("source")


def _op4(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(said)))


def _op5(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"))


def _op6(spark, d):
    folder = shared_dir(spark)
    records.write_records(table(spark, d, "documents"), folder, vocabulary(), END_ID)
    return records.read_records(spark, folder)


def _op7(spark, d):
    return brown.score_texts(table(spark, d, "documents"))


def _op8(spark, d):
    rated = quality.rate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    tails = [F.get("tails", F.lit(k)).alias(f"p_grade_{k + 1}") for k in range(2)]
    return rated.select("doc_id", "score", "expected_grade", *tails, "kept")


def _op9(spark, d):
    return decontam.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _op10(spark, d):
    return pii.digest(pii.personal_data(table(spark, d, "documents")))


def queries():
    return {
        "op1_suffix_array_dedup": _op1,
        "op2_media_columns": _op2,
        "op3_source_mixing": _op3,
        "op4_chat_formatting": _op4,
        "op5_minhash_near_dedup": _op5,
        "op6_token_records": _op6,
        "op7_lm_scoring": _op7,
        "op8_quality_classifier": _op8,
        "op9_benchmark_decontamination": _op9,
        "op10_pii": _op10,
    }


def oracle_sql():
    return {"op9_benchmark_decontamination": decontam.ORACLE}

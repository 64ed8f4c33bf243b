"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, chat, mixing, neardup, neighbours, packing, quality, repeats, topk, toxicity, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_chat_format": chat.op2_chat_format,
        "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_nn_descent": neighbours.op5_nn_descent,
        "op6_exact_top_k": topk.op6_exact_top_k,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
        "op10_url_filter": urls.op10_url_filter,
        "op11_byte_bpe": bpe.op11_byte_bpe,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op6_exact_top_k": topk.OP6_SQL, "op10_url_filter": urls.OP10_SQL, "op12_filter_audit": audit.OP12_SQL}

"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import blocknames, chat, decontaminate, langid, merkle, mixing, packing, quality, records, repair, simhash, topk, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": records.op1_token_records,
    "op2_best_two_fit": packing.op2_best_two_fit,
    "op3_simhash_ball": simhash.op3_simhash_ball,
    "op4_chat_round_trip": chat.op4_chat_round_trip,
    "op5_wordpiece_counts": wordpiece.op5_wordpiece_counts,
    "op6_block_naming": blocknames.op6_block_naming,
    "op7_quality_scores": quality.op7_quality_scores,
    "op8_entropy_mix": mixing.op8_entropy_mix,
    "op9_block_topk": topk.op9_block_topk,
    "op10_language_masks": langid.op10_language_masks,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_benchmark_leaks": decontaminate.op12_benchmark_leaks,
    "op13_structure_repair": repair.op13_structure_repair,
}

SQL: dict[str, str] = {
    "op4_chat_round_trip": chat.SQL,
    "op6_block_naming": blocknames.SQL,
    "op9_block_topk": topk.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_benchmark_leaks": decontaminate.SQL,
    "op13_structure_repair": repair.SQL,
}

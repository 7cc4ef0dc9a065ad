"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bsi_topk, conversations, decontaminate, line_dedup, mixing, pii_surrogates, probminhash, quality, rendezvous, spelling, token_store, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_toxicity": toxicity.op1,
    "op2_bit_sliced_topk": bsi_topk.op2,
    "op3_warc_index": warc.op3,
    "op4_raked_mixing": mixing.op4,
    "op5_probminhash": probminhash.op5,
    "op6_rendezvous": rendezvous.op6,
    "op7_empirical_bayes_quality": quality.op7,
    "op8_token_store": token_store.op8,
    "op9_pii_surrogates": pii_surrogates.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_conversation_repair": conversations.op12,
    "op13_line_dedup": line_dedup.op13,
}
SQL: dict[str, str] = {
    "op2_bit_sliced_topk": bsi_topk.OP2_SQL,
    "op3_warc_index": warc.OP3_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}

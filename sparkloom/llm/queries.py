"""The registered queries of this package: production parameters, whole tables, full results."""

from __future__ import annotations

from sparkloom.llm import chat, decontam, fingerprints, langid, linededup, packing, passages, pfor, simhash, urlfilter
from sparkloom.llm.common import table


def op1_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return urlfilter.scored(table(spark, sf_dir, "pages"))


def op5_chat_format(spark, sf_dir):
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_token_blocks(spark, sf_dir):
    return pfor.encoded(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark, sf_dir):
    return linededup.repeated_lines(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_passages, op2_fingerprints, op3_language_id, op4_url_filter, op5_chat_format, op6_best_fit_packing, op7_token_blocks, op8_simhash, op9_decontamination, op10_line_dedup)}


def oracle_sql() -> dict:
    return {"op2_fingerprints": fingerprints.ORACLE, "op5_chat_format": chat.ORACLE, "op9_decontamination": decontam.ORACLE, "op10_line_dedup": linededup.ORACLE}

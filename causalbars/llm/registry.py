"""The subpackage's named queries and their SQL."""

from __future__ import annotations

from causalbars.llm import chat, decontaminate, licenses, line_dedup, mixing, neighbours, ngram_join, quality, sharding, token_files


def queries() -> dict:
    return {
        "op1_token_files": token_files.query,
        "op2_decontaminate": decontaminate.query,
        "op3_line_dedup": line_dedup.query,
        "op4_neighbours": neighbours.query,
        "op5_licenses": licenses.query,
        "op6_mixing": mixing.query,
        "op7_sharding": sharding.query,
        "op8_chat_format": chat.query,
        "op9_quality": quality.query,
        "op10_ngram_join": ngram_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE}

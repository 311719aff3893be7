"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tabulon.llm import chat, covertree, decontaminate, lattice, nearpairs, pieces, quality, secrets, substrings, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_quality": quality.op2_quality,
        "op3_substrings": substrings.op3_substrings,
        "op4_minhash": nearpairs.op4_minhash,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_secret_scans": secrets.op6_secret_scans,
        "op7_lm_scoring": lattice.op7_lm_scoring,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_embeddings": covertree.op10_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op3_substrings": substrings.ORACLE, "op4_minhash": nearpairs.ORACLE, "op5_chat_formatting": chat.ORACLE, "op9_decontamination": decontaminate.ORACLE, "op10_embeddings": covertree.ORACLE}

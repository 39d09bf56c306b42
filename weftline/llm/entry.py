"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, embeddings, html, linededup, mixing, oracles, secrets, simhash, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_html": html.op2_html,
        "op3_decontam": decontam.op3_decontam,
        "op4_mixing": mixing.op4_mixing,
        "op5_suffixes": suffixes.op5_suffixes,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_secrets": secrets.op7_secrets,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat": chat.op9_chat,
        "op10_line_dedup": linededup.op10_line_dedup,
    }


oracle_sql = oracles.oracle_sql

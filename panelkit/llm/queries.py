"""Queries of this subpackage for the driver contract, and their SQL."""

from __future__ import annotations

from . import decontaminate, embedding, language_id, minhash, mixing, quality, secrets, sharding, substring, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_quality": quality.op3_quality,
        "op4_minhash": minhash.op4_minhash,
        "op5_sharding": sharding.op5_sharding,
        "op6_language_id": language_id.op6_language_id,
        "op7_secrets": secrets.op7_secrets,
        "op8_embedding": embedding.op8_embedding,
        "op9_mixing": mixing.op9_mixing,
        "op10_substring": substring.op10_substring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op4_minhash": minhash.OP4_SQL,
        "op5_sharding": sharding.OP5_SQL,
        "op7_secrets": secrets.OP7_SQL,
        "op8_embedding": embedding.OP8_SQL,
        "op10_substring": substring.OP10_SQL,
    }

"""The corpus operators' queries and oracle SQL."""

from __future__ import annotations

from helixframe.llm import chat_format, edit_fingerprint, exact_dedup, license_scan, mixing, packing, pii, quality, sharding, simhash


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_quality": quality.op4_quality,
        "op5_edit_fingerprint": edit_fingerprint.op5_edit_fingerprint,
        "op6_pii": pii.op6_pii,
        "op7_mixing": mixing.op7_mixing,
        "op8_packing": packing.op8_packing,
        "op9_sharding": sharding.op9_sharding,
        "op10_license_scan": license_scan.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op3_chat_format": chat_format.ORACLE, "op7_mixing": mixing.ORACLE, "op9_sharding": sharding.ORACLE}

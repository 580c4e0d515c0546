"""Training-data operators.  Nothing outside this subpackage imports it; the entry module adds its queries if it is there."""

from __future__ import annotations


def queries() -> dict:
    from lattix.llm import decontam, gru, hnsw, html_extract, langid, pieces, pii, quality, simhash, suffix

    return {
        "op1_html_extract": html_extract.query,
        "op2_quality": quality.query,
        "op3_pii": pii.query,
        "op4_pieces": pieces.query,
        "op5_simhash": simhash.query,
        "op6_langid": langid.query,
        "op7_hnsw": hnsw.query,
        "op8_suffix": suffix.query,
        "op9_decontaminate": decontam.query,
        "op10_gru": gru.query,
    }


def oracle_sql() -> dict[str, str]:
    from lattix.llm import decontam

    return {"op9_decontaminate": decontam.SQL}

"""Queries of the corpus operators, one for each, and their SQL."""

from __future__ import annotations

from quillfold.llm import extract, hmm, language, mixing, packing, pii, quality, simhash, sketch, urls


def queries():
    return {"op1_pii": pii.op1_pii, "op2_urls": urls.op2_urls, "op3_mixing": mixing.op3_mixing, "op4_hmm": hmm.op4_hmm, "op5_extract": extract.op5_extract, "op6_simhash": simhash.op6_simhash, "op7_packing": packing.op7_packing, "op8_language": language.op8_language, "op9_fingerprints": sketch.op9_fingerprints, "op10_quality": quality.op10_quality}


def oracle_sql() -> dict[str, str]:
    """None of these can be expressed in SQL as a whole; their tests compare them with brute force."""
    return {}

"""The queries of this subpackage and their SQL, gathered for __spark_entry__.py."""

from millrace.llm import op1_bpe, op2_simhash, op3_preferences, op4_passages, op5_vectors, op6_quality, op7_sharding, op8_html, op9_counts, op10_mixing, op11_classifier, op12_variants

_MODULES = (op1_bpe, op2_simhash, op3_preferences, op4_passages, op5_vectors, op6_quality, op7_sharding, op8_html, op9_counts, op10_mixing, op11_classifier, op12_variants)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in getattr(m, "ORACLE", {}).items()}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from lamina.llm import language, licenses, mixing, neighbours, packing, quality, simhash, substring, tokens, toxicity

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_rlz": substring.op2_rlz,
    "op3_quality": quality.op3_quality,
    "op4_licenses": licenses.op4_licenses,
    "op5_language": language.op5_language,
    "op6_tokens": tokens.op6_tokens,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op2_rlz": substring.ORACLE_SQL, "op4_licenses": licenses.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}

"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import ann, collocations, decontam, fingerprints, langid, mixing, negatives, pii, secrets, simhash, tokens, toolcalls, toxicity

QUERIES = {
    "op1_nn_descent_search": ann.op1_nn_descent_search,
    "op2_temperature_mix": mixing.op2_temperature_mix,
    "op3_edit_token_counts": tokens.op3_edit_token_counts,
    "op4_language_id": langid.op4_language_id,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_tool_call_linking": toolcalls.op10_tool_call_linking,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_collocations": collocations.op12_collocations,
    "op13_order_minhash": fingerprints.op13_order_minhash,
}
ORACLE_SQL = {"op10_tool_call_linking": toolcalls.OP10_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_collocations": collocations.OP12_SQL, "op2_temperature_mix": mixing.OP2_SQL, "op8_decontaminate": decontam.OP8_SQL}

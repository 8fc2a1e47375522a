"""The subpackage's queries and SQL, for the entry file."""

from __future__ import annotations

from . import ann, codes, decontam, interactions, jaccard, langid, licenses, packing, pii, repeats, simhash, tokencount, tokenfile

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_ann": ann.op2_ann,
    "op3_repeats": repeats.op3_repeats,
    "op4_langid": langid.op4_langid,
    "op5_tokenfile": tokenfile.op5_tokenfile,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontam": decontam.op7_decontam,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_tokencount": tokencount.op10_tokencount,
    "op11_interactions": interactions.op11_interactions,
    "op12_codes": codes.op12_codes,
    "op13_jaccard": jaccard.op13_jaccard,
}

#: Operators that SQL can express; the others are held against brute force in tests/llm.
ORACLES = {"op2_ann": ann.OP2_SQL, "op11_interactions": interactions.OP11_SQL, "op12_codes": codes.OP12_SQL, "op13_jaccard": jaccard.OP13_SQL}

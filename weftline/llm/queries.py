"""The queries of this subpackage and their SQL."""

from . import decontaminate, licenses, mixing, quality, repeats, search, secrets, simhash, tokens, warc

QUERIES = {
    "op1_search": search.op1_search,
    "op2_repeats": repeats.op2_repeats,
    "op3_licenses": licenses.op3_licenses,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_simhash": simhash.op7_simhash,
    "op8_tokens": tokens.op8_tokens,
    "op9_secrets": secrets.op9_secrets,
    "op10_mix": mixing.op10_mix,
}

ORACLE_SQL = {
    "op1_search": search.OP1_SQL,
    "op2_repeats": repeats.OP2_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op10_mix": mixing.OP10_SQL,
}

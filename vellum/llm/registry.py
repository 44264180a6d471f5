"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bitsliced, bpe, chat, cosine, exact, fim, licenses, lm, mixing, quality, simhash, spelling, suffixes

QUERIES = {
    "op1_line_crf": quality.op1_line_crf,
    "op2_bitsliced_topk": bitsliced.op2_bitsliced_topk,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_cosine": cosine.op4_cosine,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_simhash": simhash.op6_simhash,
    "op7_bloom_lm": lm.op7_bloom_lm,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_chat_roles": chat.op10_chat_roles,
    "op11_spelling": spelling.op11_spelling,
    "op12_exact": exact.op12_exact,
    "op13_fim": fim.op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op2_bitsliced_topk": bitsliced.OP2_SQL,
    "op4_cosine": cosine.OP4_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_exact": exact.OP12_SQL,
    "op13_fim": fim.OP13_SQL,
}

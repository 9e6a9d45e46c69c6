"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, ann, bpe, chat, embed, exact, langid, lines, mixing, quality, simhash, urls, whiten

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_embedding_dedup": embed.op2_embedding_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality": quality.op4_quality,
    "op10_language": langid.op10_language,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op7_url_filter": urls.op7_url_filter,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op11_neighbours": ann.op11_neighbours,
    "op12_whiten": whiten.op12_whiten,
    "op13_align": align.op13_align,
}

ORACLE_SQL = {
    "op2_embedding_dedup": embed.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op6_exact_dedup": exact.OP6_SQL,
    "op7_url_filter": urls.OP7_SQL,
}

"""The registered queries of this subpackage: name to (function of spark and folder, SQL or None)."""

from __future__ import annotations

from corpusmill.llm import chat, collocations, html_text, language, lexicon, mixing, neighbours, packing, quality, sharding, simhash, spelling, warc

QUERIES = {
    "op1_nearest_vectors": (neighbours.op1_nearest_vectors, None),
    "op2_language": (language.op2_language, None),
    "op3_packed_sequences": (packing.op3_packed_sequences, None),
    "op4_balanced_shards": (sharding.op4_balanced_shards, sharding.OP4_SQL),
    "op5_simhash_near_duplicates": (simhash.op5_simhash_near_duplicates, None),
    "op6_quality_ledger": (quality.op6_quality_ledger, quality.OP6_SQL),
    "op7_warc_bundles": (warc.op7_warc_bundles, warc.OP7_SQL),
    "op8_source_mix": (mixing.op8_source_mix, mixing.OP8_SQL),
    "op9_main_text": (html_text.op9_main_text, None),
    "op10_chat_format": (chat.op10_chat_format, chat.OP10_SQL),
    "op11_spelling_variants": (spelling.op11_spelling_variants, None),
    "op12_phrases": (collocations.op12_phrases, collocations.OP12_SQL),
    "op13_bpe": (lexicon.op13_bpe, None),
}

"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from . import bpe, chat, decontaminate, graphs, langid, lines, media, near, pii, search, store, substring, trie

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_store": store.op2_store,
    "op3_langid": langid.op3_langid,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat": chat.op5_chat,
    "op6_lines": lines.op6_lines,
    "op7_pii": pii.op7_pii,
    "op8_near": near.op8_near,
    "op9_bpe": bpe.op9_bpe,
    "op10_media": media.op10_media,
    "op11_trie": trie.op11_trie,
    "op12_neighbours": graphs.op12_neighbours,
    "op13_search": search.op13_search,
}
SQL: dict[str, str] = {"op6_lines": lines.OP6_SQL, "op11_trie": trie.OP11_SQL, "op12_neighbours": graphs.OP12_SQL, "op13_search": search.OP13_SQL}

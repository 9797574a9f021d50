"""The thin queries of this folder and the SQL that checks them."""

from __future__ import annotations

from docutally.llm import conversations, edits, hilbert, infill, leaks, maxscore, minhash, packing, secrets, sentencepieces, substrings, suffixtree, toxicity

REGISTRY = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_edit_counts": edits.op3_edit_counts,
    "op4_suffix_array": substrings.op4_suffix_array,
    "op5_maxscore": maxscore.op5_maxscore,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_secrets": secrets.op7_secrets,
    "op8_hilbert": hilbert.op8_hilbert,
    "op9_minhash": minhash.op9_minhash,
    "op10_suffix_tree": suffixtree.op10_suffix_tree,
    "op11_infill": infill.op11_infill,
    "op12_leaks": leaks.op12_leaks,
    "op13_conversations": conversations.op13_conversations,
}
SQL = {
    "op4_suffix_array": substrings.OP4_SQL,
    "op5_maxscore": maxscore.OP5_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op10_suffix_tree": suffixtree.OP10_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_leaks": leaks.OP12_SQL,
    "op13_conversations": conversations.OP13_SQL,
}

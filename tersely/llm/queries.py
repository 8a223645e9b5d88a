"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tersely.llm.ann import op1_adaptive_scan
from tersely.llm.bpe import op4_bpe_pair_index
from tersely.llm.cws import op6_weighted_sampling
from tersely.llm.htmltext import op3_html_layout
from tersely.llm.langid import op7_language_viterbi
from tersely.llm.licenses import op2_license_automaton
from tersely.llm.mixing import mixing_sql, op8_mixing_raking
from tersely.llm.repeats import op5_suffix_repeats
from tersely.llm.secretscan import op11_secret_field
from tersely.llm.simhash import op10_simhash_tiles
from tersely.llm.toxicity import op9_toxicity_subsequence_svm
from tersely.llm.turnrepair import op12_turn_repair, repair_sql
from tersely.llm.turntrie import op13_turn_trie, trie_sql

QUERIES = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_license_automaton": op2_license_automaton,
    "op3_html_layout": op3_html_layout,
    "op4_bpe_pair_index": op4_bpe_pair_index,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_language_viterbi": op7_language_viterbi,
    "op8_mixing_raking": op8_mixing_raking,
    "op9_toxicity_subsequence_svm": op9_toxicity_subsequence_svm,
    "op10_simhash_tiles": op10_simhash_tiles,
    "op11_secret_field": op11_secret_field,
    "op12_turn_repair": op12_turn_repair,
    "op13_turn_trie": op13_turn_trie,
}
ORACLE_SQL: dict[str, str] = {"op8_mixing_raking": mixing_sql(), "op12_turn_repair": repair_sql(), "op13_turn_trie": trie_sql()}

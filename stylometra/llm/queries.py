"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .archives import OP13_SQL, op13_loser_tree_archive
from .decontamination import op6_cgk_decontamination
from .jaccard import OP8_SQL, op8_minhash_forest_join
from .language import op5_crf_language
from .negatives import OP11_SQL, op11_sorted_hard_negatives
from .packing import op2_vector_packing
from .preferences import OP1_SQL, op1_preference_format
from .productcodes import OP12_SQL, op12_hamerly_codes
from .pseudonyms import op7_feistel_pseudonyms
from .quantization import OP9_SQL, op9_itq_embedding_links
from .suffixdedup import OP4_SQL, op4_suffix_array_dedup
from .tokencounts import op10_trie_token_counts
from .tokenfile import op3_rans_token_file

QUERIES = {f.__name__: f for f in (op1_preference_format, op2_vector_packing, op3_rans_token_file, op4_suffix_array_dedup, op5_crf_language, op6_cgk_decontamination, op7_feistel_pseudonyms, op8_minhash_forest_join, op9_itq_embedding_links, op10_trie_token_counts, op11_sorted_hard_negatives, op12_hamerly_codes, op13_loser_tree_archive)}
ORACLE_SQL = {"op1_preference_format": OP1_SQL, "op4_suffix_array_dedup": OP4_SQL, "op8_minhash_forest_join": OP8_SQL, "op9_itq_embedding_links": OP9_SQL, "op11_sorted_hard_negatives": OP11_SQL, "op12_hamerly_codes": OP12_SQL, "op13_loser_tree_archive": OP13_SQL}

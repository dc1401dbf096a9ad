"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from . import byte_dedup, collocations, decontaminate, jaccard, mixing, packing, passage_dedup, slots, suffix_lm, token_files, toxicity, vectors, whitening

QUERIES = {f.__name__: f for f in (
    passage_dedup.op1_passage_dedup, toxicity.op2_toxicity, token_files.op3_token_files, suffix_lm.op4_suffix_lm, slots.op5_virtual_slots, mixing.op6_entropy_mix,
    vectors.op7_kmeans_tree, jaccard.op8_jaccard_join, byte_dedup.op9_byte_dedup, decontaminate.op10_decontaminate,
    whitening.op11_tsqr_whitening, collocations.op12_collocations, packing.op13_best_fit,
)}
ORACLE: dict[str, str] = {"op1_passage_dedup": passage_dedup.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op12_collocations": collocations.ORACLE}

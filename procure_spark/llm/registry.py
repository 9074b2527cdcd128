"""The corpus operators' queries and, where SQL can express them, their SQL."""

from procure_spark.llm import op01_secrets, op02_pieces, op03_sharding, op04_chat, op05_classifier, op06_outliers, op07_neardup, op08_topk, op09_mixing, op10_suffixes, op11_repair, op12_negatives, op13_licenses

QUERIES = {
    "op1_multipart_secrets": op01_secrets.op1_multipart_secrets,
    "op2_gumbel_pieces": op02_pieces.op2_gumbel_pieces,
    "op3_hypergeometric_sharding": op03_sharding.op3_hypergeometric_sharding,
    "op4_chat_round_trip": op04_chat.op4_chat_round_trip,
    "op5_rule_ensemble": op05_classifier.op5_rule_ensemble,
    "op6_robust_outliers": op06_outliers.op6_robust_outliers,
    "op7_hamming_neardup": op07_neardup.op7_hamming_neardup,
    "op8_segment_topk": op08_topk.op8_segment_topk,
    "op9_curriculum_mixing": op09_mixing.op9_curriculum_mixing,
    "op10_deep_shallow_dedup": op10_suffixes.op10_deep_shallow_dedup,
    "op11_structure_repair": op11_repair.op11_structure_repair,
    "op12_shared_list_negatives": op12_negatives.op12_shared_list_negatives,
    "op13_license_join": op13_licenses.op13_license_join,
}
ORACLE_SQL = {
    "op4_chat_round_trip": op04_chat.SQL,
    "op8_segment_topk": op08_topk.SQL,
    "op9_curriculum_mixing": op09_mixing.SQL,
    "op11_structure_repair": op11_repair.SQL,
    "op12_shared_list_negatives": op12_negatives.SQL,
    "op13_license_join": op13_licenses.SQL,
}

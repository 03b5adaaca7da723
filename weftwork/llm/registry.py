"""Queries and SQL of the corpus operators, by name."""

from weftwork.llm import q01_quality, q02_personal_data, q03_hilbert_ann, q04_license_scan, q05_compaction, q06_token_count, q07_decontaminate, q08_toxicity, q09_piece_encoding, q10_near_dedup

QUERIES = {
    "op5_compaction": q05_compaction.op5_compaction,
    "op6_token_count": q06_token_count.op6_token_count,
    "op9_piece_encoding": q09_piece_encoding.op9_piece_encoding,
    "op3_hilbert_ann": q03_hilbert_ann.op3_hilbert_ann,
    "op2_personal_data": q02_personal_data.op2_personal_data,
    "op4_license_scan": q04_license_scan.op4_license_scan,
    "op10_near_dedup": q10_near_dedup.op10_near_dedup,
    "op8_toxicity": q08_toxicity.op8_toxicity,
    "op1_quality": q01_quality.op1_quality,
    "op7_decontaminate": q07_decontaminate.op7_decontaminate,
}

ORACLES = {
    "op5_compaction": q05_compaction.ORACLE,
    "op6_token_count": q06_token_count.ORACLE,
    "op10_near_dedup": q10_near_dedup.ORACLE,
    "op7_decontaminate": q07_decontaminate.ORACLE,
}

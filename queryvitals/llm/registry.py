"""Queries and SQL of this subpackage, for the driver's entry file."""

from queryvitals.llm import bpe, classifier, decontaminate, fim, language, lexical, lines, minhash, mixing, quality_rules, secrets, sharding, substring

QUERIES = {
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_line_dedup": lines.op7_line_dedup,
    "op1_mix_sources": mixing.op1_mix_sources,
    "op3_shard": sharding.op3_shard,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op2_language_id": language.op2_language_id,
    "op10_quality_classifier": classifier.op10_quality_classifier,
    "op5_near_dedup": minhash.op5_near_dedup,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}

ORACLES = {
    "op7_line_dedup": lines.OP7_SQL,
    "op1_mix_sources": mixing.OP1_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op5_near_dedup": minhash.OP5_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}

"""Queries of the subpackage, by name, and the SQL of those that SQL expresses."""

from abridge.llm import (
    conversation_repair_query,
    decontamination_query,
    embedding_dedup_query,
    group_ranking_query,
    language_query,
    ngram_jaccard_query,
    packing_query,
    quality_query,
    sentencepieces_query,
    sharding_query,
    token_counts_query,
    toxicity_query,
    url_filter_query,
)

QUERIES = {
    "op1_decontamination": decontamination_query.op1_decontamination,
    "op2_url_filter": url_filter_query.op2_url_filter,
    "op3_packing": packing_query.op3_packing,
    "op4_sharding": sharding_query.op4_sharding,
    "op5_toxicity": toxicity_query.op5_toxicity,
    "op6_sentencepiece": sentencepieces_query.op6_sentencepiece,
    "op7_language": language_query.op7_language,
    "op8_token_counts": token_counts_query.op8_token_counts,
    "op9_ngram_jaccard": ngram_jaccard_query.op9_ngram_jaccard,
    "op10_embedding_dedup": embedding_dedup_query.op10_embedding_dedup,
    "op11_quality": quality_query.op11_quality,
    "op12_group_ranking": group_ranking_query.op12_group_ranking,
    "op13_conversation_repair": conversation_repair_query.op13_conversation_repair,
}

ORACLE_SQL = {
    "op2_url_filter": url_filter_query.SQL,
    "op4_sharding": sharding_query.SQL,
    "op9_ngram_jaccard": ngram_jaccard_query.SQL,
    "op10_embedding_dedup": embedding_dedup_query.SQL,
    "op12_group_ranking": group_ranking_query.SQL,
    "op13_conversation_repair": conversation_repair_query.SQL,
}

"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, dedup, jaccard, langid, leaks, mixing, packing, pii, secrets, spelling, topk, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    "op1_topk_search": _over("embeddings", topk.search_embeddings),
    "op2_mix_sources": _over("documents", mixing.mix_sources),
    "op3_language_id": _over("documents", langid.identify_language),
    "op4_ngram_jaccard": _over("documents", jaccard.similarity_components),
    "op5_exact_dedup": _over("documents", dedup.exact_dedup),
    "op6_pack_documents": _over("documents", lambda docs: packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))),
    "op7_secret_scan": _over("documents", secrets.scan_secrets),
    "op8_chat_format": _over("conversations", lambda turns: chat.summarise(chat.format_conversations(chat.with_control_case(turns), tokenizer_path("byte_bpe_50k.json")))),
    "op9_personal_data": _over("documents", pii.scan_personal_data),
    "op10_url_filter": _over("pages", urls.judge_urls),
    "op11_cluster_embeddings": _over("embeddings", clusters.cluster_embeddings),
    "op12_spelling_variants": _over("documents", spelling.group_spellings),
    "op13_benchmark_leaks": lambda spark, sf_dir: leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

SQL: dict[str, str] = {
    "op1_topk_search": topk.SQL,
    "op2_mix_sources": mixing.SQL,
    "op4_ngram_jaccard": jaccard.SQL,
    "op5_exact_dedup": dedup.SQL,
    "op7_secret_scan": secrets.SQL,
    "op8_chat_format": chat.SQL,
    "op11_cluster_embeddings": clusters.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_benchmark_leaks": leaks.SQL,
}

"""The corpus queries and their SQL."""

from __future__ import annotations

from . import conversations, decontaminate, exact_dedup, html_extract, line_dedup, packing, pieces, quality, ranked_search, secret_scan, simhash_dedup, substring_dedup, suffix_dedup
from .store import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark, sf_dir):
    return packing.digest(packing.packed(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op4_quality(spark, sf_dir):
    scores = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op5_html_extract(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_simhash_dedup(spark, sf_dir):
    return simhash_dedup.digest(simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op11_ranked_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search.ranked_search(docs.select("doc_id", "text"), items.select("item_id", "text"))


def op12_sentencepiece(spark, sf_dir):
    return pieces.digest(pieces.sentencepieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.digest(rows, *conversations.repair(conversations.damaged(rows)))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_packing": op2_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_html_extract": op5_html_extract,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
}

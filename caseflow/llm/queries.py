"""The registered queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    ball_tree, chat_template, conversation_repair, decontaminate, host_quality, langid, line_dedup, packing, superminhash,
    toxicity, trie_join, url_trust, warc,
)
from caseflow.llm.common import table


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and the archives read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.fresh_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; a fifth of them is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    train = toxicity.labelled(docs, table(spark, sf_dir, "labels"), ~langid.held_out(F.col("doc_id"), 5, 0))
    scored = toxicity.score(docs, toxicity.fit(train))
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_events")


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at similarity 0.85."""
    return (superminhash.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)
            .select("doc_id", "n_shingles", "component_id", "kept"))


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return (url_trust.judge(table(spark, sf_dir, "pages"))
            .select("page_id", "host", "path", "rule", "verdict", "trust", "distrust", "base"))


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with one that holds the
    template's own control strings."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_template.format_and_read_back(turns.unionByName(extra))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that match an earlier one."""
    return (line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "n_lines", "n_removed", "n_links"))


def op8_ftrl_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; a third of them is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts for all documents."""
    return (host_quality.judge(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on 4-word shingles at similarity 0.85."""
    return trie_join.components(table(spark, sf_dir, "documents"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_pattern_grammar": op2_pattern_grammar,
    "op3_containment": op3_containment,
    "op4_superminhash": op4_superminhash,
    "op5_link_trust": op5_link_trust,
    "op6_chat_template": op6_chat_template,
    "op7_line_join": op7_line_join,
    "op8_ftrl_langid": op8_ftrl_langid,
    "op9_host_quality": op9_host_quality,
    "op10_best_fit": op10_best_fit,
    "op11_trie_join": op11_trie_join,
    "op12_ball_tree": op12_ball_tree,
    "op13_auction_repair": op13_auction_repair,
}

ORACLES: dict[str, str] = {
    "op1_warc_dictionary": warc.ORACLE_SQL,
    "op3_containment": decontaminate.ORACLE_SQL,
    "op6_chat_template": chat_template.ORACLE_SQL,
    "op7_line_join": line_dedup.ORACLE_SQL,
    "op9_host_quality": host_quality.ORACLE_SQL,
    "op12_ball_tree": ball_tree.ORACLE_SQL,
}

"""Queries of this subpackage over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.llm import language, mainbody, mixture, ocr, repeats, residue, skeleton, split, tokens
from weftmill.shared import spread, staged, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.template_lines(spread(table(spark, d, "extracted_pages")))


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_body(spread(table(spark, d, "extracted_pages")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.corrections(staged(p2_segments(spark, d), "segments"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.labelled_segments(spread(table(spark, d, "extracted_pages")), table(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(spread(table(spark, d, "extracted_pages")), ["text", "footer"])


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Maximal repeated blocks of lines: on how many pages, and how often."""
    return repeats.maximal_blocks(spread(table(spark, d, "extracted_pages")), ["text", "footer"])


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages")
    return repeats.without_lines(pages, repeats.repeated_lines(pages, ["text", "footer"]), ["text", "footer"]).select("page_id", "url", "text", "footer")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).filter("n_pieces > 1 and piece = 0").select("chunk_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = split.split_oversized(table(spark, d, "chunks"))
    return cut.select("chunk_id", "source_id", "chunk_index", "heading", "piece", "n_pieces", F.col("piece_text").alias("text"), "overlap_chars", "piece_tokens")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").select(F.col("page_id").alias("id"), "text")
    return pages.unionByName(table(spark, d, "extracted_docs").select(F.col("file_id").alias("id"), "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.lookalike_pairs(_texts(spark, d))


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.with_skeleton(_texts(spark, d)).select("id", "consistent_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(spread(table(spark, d, "documents")))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    docs = spread(table(spark, d, "documents")).select("doc_id", "text", tokens.token_ids(F.col("text")).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), tokens.decodes(F.col("ids"), F.col("text")).alias("same"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_body, p2_found, p2_segments, p4_found, p4_blocks, p4_clean, p5_found, p5_pieces, p6_found, p6_consistent, p8_ids, p8_roundtrip, p9_mixture, p9_shares)}

SQL: dict[str, str] = {
    "p5_found": "select chunk_id from chunks where floor((length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) + 1 > 350",
}


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return docs.filter(F.size(residue.residue(F.col("text"))) > 0).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    """Each residue sentence, with its kind."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.explode(residue.residue(F.col("text"))).alias("r"))
    return docs.select("doc_id", "r.kind", "r.sentence", F.round("r.share", 6).alias("share"))


QUERIES |= {f.__name__: f for f in (p10_found, p10_residue)}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(spread(table(spark, d, "extracted_docs")))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(spread(table(spark, d, "extracted_docs"))).select("file_id", "repaired")


QUERIES |= {f.__name__: f for f in (p7_found, p7_text)}

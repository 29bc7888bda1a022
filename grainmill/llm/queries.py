"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, licences, media, mixing, ngramjoin, pii, quality, repeats, toxicity, treaps, trie
from .common import read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_sets(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spans_string().alias("spans"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(read_table(spark, sf_dir, "documents"), with_media=False)


def _held_out(parts: int, part: int) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves ``part``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, ~_held_out(3, 1))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.document_files(read_table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~_held_out(4, 2), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(read_table(spark, sf_dir, "documents"))
    return repeats.remove_repeats(found).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                        public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.graft(trie.turn_arrays(read_table(spark, sf_dir, "conversations"))))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.learn(docs, labels, ~_held_out(4, 2)))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_personal_data": op3_personal_data,
    "op4_matroska": op4_matroska,
    "op5_toxicity": op5_toxicity,
    "op6_licence_scan": op6_licence_scan,
    "op7_language_id": op7_language_id,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_fingerprints": op10_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_treap_search": op12_treap_search,
    "op13_attention_quality": op13_attention_quality,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_licence_scan": licences.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_treap_search": treaps.ORACLE,
}

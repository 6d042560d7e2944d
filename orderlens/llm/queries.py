"""The registered queries of this subpackage: each operator over its whole table."""

import corpus_pipeline
import public_tokenizers

from orderlens.llm import (
    filter_audit,
    hamming_index,
    jaccard_join,
    line_dedup,
    mixing,
    piece_codec,
    pivot_dedup,
    quality_model,
    sorted_lists,
    token_alignment,
    token_counts,
    toxicity,
    warc_archive,
)
from orderlens.llm.support import scratch_path, table


def op1_substring_dedup(spark, folder):
    return line_dedup.shared_passages(table(spark, folder, "documents"))


def op2_nearest(spark, folder):
    return hamming_index.nearest_neighbours(table(spark, folder, "embeddings"))


def op3_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark, folder):
    return quality_model.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_jaccard_join(spark, folder):
    return jaccard_join.jaccard_classes(table(spark, folder, "documents"))


def op6_mixing(spark, folder):
    return mixing.mixture(table(spark, folder, "documents"))


def op7_embedding_dedup(spark, folder):
    return pivot_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op8_sentencepiece(spark, folder):
    docs = table(spark, folder, "documents")
    return piece_codec.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_warc(spark, folder):
    archive = scratch_path(spark, "archive")
    warc_archive.write_archive(table(spark, folder, "pages"), archive)
    return warc_archive.page_records(*warc_archive.read_archive(spark, archive))


def op11_filter_audit(spark, folder):
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_top_scores(spark, folder):
    return sorted_lists.top_scores(table(spark, folder, "embeddings"))


def op13_token_alignment(spark, folder):
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.token_alignment(table(spark, folder, "documents"), *paths)


QUERIES = {"pipeline": corpus_pipeline.run} | {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_nearest,
        op3_token_counts,
        op4_quality,
        op5_jaccard_join,
        op6_mixing,
        op7_embedding_dedup,
        op8_sentencepiece,
        op9_toxicity,
        op10_warc,
        op11_filter_audit,
        op12_top_scores,
        op13_token_alignment,
    )
}
ORACLE = {
    "op10_warc": """
      SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN later THEN first_page END AS refers_to
      FROM (SELECT *, payload_bytes >= 100 AND page_id <> first_page AS later
            FROM (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
                    sha256(html) AS payload_digest,
                    min(page_id) OVER (PARTITION BY html) AS first_page
                  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))""",
    "op11_filter_audit": """
      WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents),
      failing AS (
        SELECT doc_id, part,
          (len(words) < 200)::INTEGER
          + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
          + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
          + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
          + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS fails
        FROM texts),
      judged AS (
        SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic
        FROM labels GROUP BY doc_id),
      sets AS (
        SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM failing LEFT JOIN judged USING (doc_id) GROUP BY part, fails),
      letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
      orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
          [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
        WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
      steps AS (
        SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
        FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
      counts AS (
        SELECT part, filter_order, step, bit,
          sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
          sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
          sum(CASE WHEN fails & bit <> 0 AND fails & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
          sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
          sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
          sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM sets, steps GROUP BY part, filter_order, step, bit)
      SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
      FROM counts""",
    "op12_top_scores": """
      WITH whole AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
      scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM whole AS q, whole AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
      SELECT query_id, rank::INTEGER AS rank, vec_id, score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
      WHERE rank <= 5""",
}

"""One registered query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, decontaminate, exact_dedup, pieces, pii, quality, secrets, simhash, suffix_dedup, tiered, toxicity
from .common import documents


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, best_similarity of every document."""
    return decontaminate.contamination(documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document with their piece ids, each decoded and compared with the text."""
    return pieces.encode(documents(spark, sf_dir), k=2, alpha=0.5, layout=2 << 20)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_string("base"), 256).alias("base_sha256"), secrets.span_string("spans").alias("spans")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its status, the maximal ones rendered."""
    return chat.collapse(_read(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place, and what was found.

    The key is the session's ``spark.lavra.pii.key`` (hex); without it a fresh one that nobody keeps.
    """
    key = spark.conf.get("spark.lavra.pii.key", None)
    return pii.protect(documents(spark, sf_dir), bytes.fromhex(key) if key else token_bytes(32))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return tiered.search(tiered.build(documents(spark, sf_dir)), _read(spark, sf_dir, "benchmark"))


def op12_norm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all whole and finite vectors, 16 parts of 64 entries each, with their errors."""
    return codes.compress(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded by the 50k byte-level vocabulary, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_sentencepiece, op3_secrets, op4_chat, op5_simhash, op6_quality, op7_exact_dedup, op8_toxicity, op9_suffix_dedup, op10_pii,
    op11_tiered_search, op12_norm_codes, op13_bpe_trie,
)}

ORACLES = {
    "op4_chat": r"""
        WITH turns AS (
          SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns
        ), prefixes AS (
          SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
            string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS s
          FROM placed
        ), fulls AS (
          SELECT conv_id, n, s, min(conv_id) OVER (PARTITION BY s) AS first_id FROM prefixes WHERE pos = n
        ), decided AS (
          SELECT conv_id, n, CASE
            WHEN EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.s = f.s) THEN 'prefix'
            WHEN conv_id = first_id THEN 'kept' ELSE 'copy' END AS status
          FROM fulls f
        ), rendered AS (
          SELECT conv_id, string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
            || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS r
          FROM placed GROUP BY conv_id
        )
        SELECT d.conv_id, CAST(n AS BIGINT) AS n_turns, status, CASE WHEN status = 'kept' THEN r END AS rendered
        FROM decided d JOIN rendered USING (conv_id)
    """,
    "op7_exact_dedup": r"""
        WITH texts AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
          first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
        FROM texts
        WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op11_tiered_search": r"""
        WITH cut AS (
          SELECT row_number() OVER () AS doc, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents
        ), sizes AS (
          SELECT doc, doc_id, len(terms) AS n, count(*) OVER () AS all_docs, sum(len(terms)) OVER () AS all_terms FROM cut WHERE len(terms) > 0
        ), lengths AS (
          SELECT doc, doc_id, all_docs, CAST(10 + (90 * n * all_docs) // all_terms AS BIGINT) AS m FROM sizes
        ), counts AS (
          SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM cut) GROUP BY doc, term
        ), weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * (SELECT max(all_docs) FROM lengths) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts GROUP BY term
        ), items AS (
          SELECT DISTINCT item, item_id, term FROM (
            SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        ), scores AS (
          SELECT item, item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc) GROUP BY item, item_id, doc, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS INTEGER) AS rank, doc_id, score FROM scores
        WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_norm_codes": r"""
        WITH kept AS (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS (
          SELECT r, p, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding[p * len(embedding) // 16 + 1 : (p + 1) * len(embedding) // 16]] AS v
          FROM kept, range(16) t(p)
        ), book0 AS (
          SELECT p, r - 1 AS e, v FROM cut WHERE r <= 64
        ), near0 AS (
          SELECT r, x.p, any_value(x.v) AS v, arg_min(e, far) AS e, min(far) AS far FROM (
            SELECT x.r, x.p, x.v, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) for i in range(1, len(x.v) + 1)]) * 64 + b.e AS far
            FROM cut x JOIN book0 b ON x.p = b.p
          ) x GROUP BY r, x.p
        ), mean0 AS (
          SELECT p, e, list(m ORDER BY i) AS v FROM (
            SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near0) GROUP BY p, e, i
          ) GROUP BY p, e
        ), book1 AS (
          SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book0 b LEFT JOIN mean0 m ON b.p = m.p AND b.e = m.e
        ), near1 AS (
          SELECT r, x.p, any_value(x.v) AS v, arg_min(e, far) AS e, min(far) AS far FROM (
            SELECT x.r, x.p, x.v, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) for i in range(1, len(x.v) + 1)]) * 64 + b.e AS far
            FROM cut x JOIN book1 b ON x.p = b.p
          ) x GROUP BY r, x.p
        ), mean1 AS (
          SELECT p, e, list(m ORDER BY i) AS v FROM (
            SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near1) GROUP BY p, e, i
          ) GROUP BY p, e
        ), book2 AS (
          SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book1 b LEFT JOIN mean1 m ON b.p = m.p AND b.e = m.e
        ), near2 AS (
          SELECT r, x.p, any_value(x.v) AS v, arg_min(e, far) AS e, min(far) AS far FROM (
            SELECT x.r, x.p, x.v, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) for i in range(1, len(x.v) + 1)]) * 64 + b.e AS far
            FROM cut x JOIN book2 b ON x.p = b.p
          ) x GROUP BY r, x.p
        ), coded AS (
          SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far // 64) AS BIGINT) AS error FROM near2 GROUP BY r
        ), said AS (
          SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM book2)
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (r), said
    """,
}

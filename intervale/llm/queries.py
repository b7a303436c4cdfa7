"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, id_remainder, read_table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint zero, an empty table no rows."""
    from intervale.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, distance=2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, score and round trip of every whole text; null counts as empty."""
    from intervale.llm.sentencepiece_unigram import piece_digests

    return piece_digests(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back; null counts as empty, ids in ascending order with null ids first."""
    from intervale.llm.token_files import read_digests, write_files

    folder = Scratch(spark, "token-files").path("documents")
    write_files(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder, end_id=1)
    return read_digests(spark, folder)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and pass of the mixture; a null source is a source, a null text has no tokens."""
    from intervale.llm.mixing import mixed_sources

    return mixed_sources(read_table(spark, sf_dir, "documents"), max_repeat=2.0, block_docs=4096, seed="mix")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeper and group of every row; null counts as empty.  Of rows that repeat an id only the one that landed last is kept, where SQL marks them all."""
    from intervale.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; ``und`` for null texts and those without a letter."""
    from intervale.llm.language_id import fit, identify

    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    return identify(docs, fit(docs.where(~held_out)), held_out=held_out)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; an empty or null text has all statistics zero."""
    from intervale.llm.quality_rules import fit, score

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    return score(docs, fit(docs, labels.where(~held_out)), held_out=held_out, cut=0.3)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of each hundredth vector; vectors that are null, zero or not finite take no part."""
    from intervale.llm.additive_ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document that is a known one from end to end, else null."""
    from intervale.llm.licences import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; null counts as empty, that is one end token."""
    from intervale.llm.interpolated_lm import interpolated_scores

    return interpolated_scores(read_table(spark, sf_dir, "documents"), remainder=id_remainder(F.col("doc_id"), 10))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; a null text has no features, a null id counts as the empty text."""
    from intervale.llm.importance import resampled

    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), buckets=10_000, seed="42", least_words=20, percent=5)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector after three rounds; vectors that are null, of another length or not finite take no part."""
    from intervale.llm.elkan import clusters

    return clusters(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", size=64, scale=64)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page; null counts as empty, pages without an article give the empty text."""
    from intervale.llm.line_blocks import extract

    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _cluster_rounds(rounds: int) -> str:
    """SQL of so many rounds: vectors a0, a1, ... with their nearest of centroids c0, c1, ..."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS (
          SELECT rid, vec_id, e, min(struct_pack(d := d, k := k)) AS best
          FROM (SELECT v.*, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c) GROUP BY ALL)""")
        if r < rounds:
            parts.append(f"""
        m{r} AS (
          SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e
          FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY k),
        c{r + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return ",".join(parts)


#: CRC-32 of every byte alone, by its rule, as a DuckDB list.
_CRC_BYTES = """(SELECT list(c ORDER BY b) FROM (
            WITH RECURSIVE t AS (SELECT b, b AS c, 0 AS i FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM t WHERE i < 8)
            SELECT b, c FROM t WHERE i = 8))"""


SQL = {
    "op11_importance_resampling": rf"""
        WITH crc AS MATERIALIZED (SELECT {_CRC_BYTES} AS t),
        texts AS (SELECT row_number() OVER () AS rid, 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT row_number() OVER (), 'b', item_id, text FROM benchmark),
        split AS MATERIALIZED (
          SELECT rid, kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        found AS MATERIALIZED (
          SELECT kind, rid, f, count(*) AS n FROM (
            SELECT kind, rid, unnest(w) AS f FROM split
            UNION ALL SELECT kind, rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split WHERE len(w) > 1
            UNION ALL SELECT kind, rid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split WHERE len(w) > 2) GROUP BY ALL),
        strings AS (SELECT f, hex(encode(f)) AS h, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM found GROUP BY f),
        hashed AS MATERIALIZED (
          SELECT f, s, strings.t, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
          FROM strings, crc),
        sums AS (SELECT b AS bucket, coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM range(10000) r(b) LEFT JOIN hashed ON bucket = b GROUP BY b),
        gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM sums),
        weights AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM found JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY rid),
        scored AS (
          SELECT id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
          FROM split LEFT JOIN weights USING (rid) WHERE kind = 'd'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY words >= 20) AS able FROM scored)
        SELECT id AS doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * able // 100 THEN r END AS rank FROM ranked
    """,
    "op12_centroid_clusters": f"""
        WITH v AS (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS k, e FROM v QUALIFY k < 16),
        {_cluster_rounds(3)}
        SELECT vec_id, best.k::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a3 JOIN c3 c ON c.k = best.k
    """,
    "op4_source_mixing": r"""
        WITH RECURSIVE slim AS (
          SELECT doc_id, source, coalesce('s' || source, 'n') AS key, doc_id::VARCHAR AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
        found AS (SELECT key, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM slim GROUP BY key),
        shares AS (SELECT *, tokens / (SELECT sum(tokens)::DOUBLE FROM found) AS p FROM found),
        spread AS (SELECT max(p) / min(p) AS r FROM shares WHERE p > 0),
        bisect AS (
          SELECT 0 AS i, 0::DOUBLE AS low, 1::DOUBLE AS high
          UNION ALL SELECT i + 1, CASE WHEN pow(r, 1 - (low + high) / 2) <= 2 THEN low ELSE (low + high) / 2 END, CASE WHEN pow(r, 1 - (low + high) / 2) <= 2 THEN (low + high) / 2 ELSE high END
          FROM bisect, spread WHERE i < 60),
        exponent AS (SELECT CASE WHEN r <= 2 THEN 0 ELSE high END AS a FROM bisect, spread WHERE i = 60),
        weighted AS (SELECT s.*, CASE WHEN p > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, exponent WHERE p > 0) ELSE 0 END AS w FROM shares s, exponent),
        quotas AS (SELECT *, round_even(w * (SELECT max(tokens / w) FROM weighted WHERE w > 0), 0)::BIGINT AS quota, (docs + 4095) // 4096 AS blocks FROM weighted),
        plan AS (SELECT key, w, blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM quotas),
        dealt AS (SELECT s.*, w, passes, rest, (('0x' || substr(md5('mix|' || id), 1, 8))::BIGINT % blocks)::INT AS block FROM slim s JOIN plan USING (key)),
        turns AS (SELECT *, unnest(range(1, passes + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS pass FROM (SELECT key, block, passes, rest, sum(tokens)::BIGINT AS tokens FROM dealt GROUP BY ALL)),
        ranked AS (SELECT *, row_number() OVER o AS block_rank, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS after FROM turns WINDOW o AS (PARTITION BY key, pass ORDER BY md5('mix|' || key || '|' || pass || '|' || block), block)),
        taken AS (SELECT key, block, pass, block_rank, CASE WHEN pass > passes AND after > rest THEN rest - (after - tokens) END AS room FROM ranked WHERE pass <= passes OR after - tokens < rest),
        drawn AS (SELECT d.*, t.pass, t.block_rank, t.room, sum(d.tokens) OVER (PARTITION BY d.key, d.block, t.pass ORDER BY md5('mix|' || t.pass || '|' || id), id, d.tokens RANGE UNBOUNDED PRECEDING) AS spent FROM dealt d JOIN taken t ON d.key = t.key AND d.block = t.block)
        SELECT doc_id, source, tokens AS n_tokens, round(w, 9) AS weight, pass::INT AS pass, block, block_rank::INT AS block_rank FROM drawn WHERE room IS NULL OR spent <= room
    """,
    "op8_nearest_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x)) AS score
                  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM pairs)
        SELECT query_id, k::INT AS rank, vec_id, score FROM ranked WHERE k <= 10
    """,
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(folded) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS folded FROM documents)
        WINDOW same AS (PARTITION BY folded)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

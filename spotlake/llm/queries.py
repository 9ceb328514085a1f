"""The registered queries of this subpackage, each on its whole table, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spotlake.llm import (
    exact_dedup, language, minhash, mixing, packing, phrases, pii, quality, simhash, spelling, suffix_dedup, toxicity, warc,
)
from spotlake.llm.common import table

# The vocabulary of byte_bpe_50k.json as ranks: the same ids, several times as fast.
RANKS = "byte_bpe_50k.tiktoken"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data of every document."""
    return pii.personal_data(table(spark, folder, "documents")).drop("row", "span_list")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return language.languages(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).drop("row")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its measures and verdict."""
    return quality.judged(table(spark, folder, "documents")).drop("row")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated passages."""
    return suffix_dedup.without_repeats(table(spark, folder, "documents")).drop("removed")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as its archive record reads."""
    return warc.round_trip(table(spark, folder, "pages"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best collocated phrases of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of similar shingle sets."""
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("row")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with the more frequent spelling it is a variant of."""
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_phrases": op11_phrases,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
    "pipeline": corpus_pipeline.run,
}

_SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES = {
    "op4_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, {_SIZE_SQL}::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS draw
            FROM documents
        ),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY source
        ),
        -- Sources fill in order of cap per weight; the level is the first that stays below its source's cap.
        filled AS (
            SELECT *, ((SELECT sum(source_size) FROM sources)
                    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM sources
        ),
        water AS (SELECT arg_min(level, cap / weight) AS level FROM filled WHERE level < cap / weight),
        targets AS (
            SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM water), 0) * weight) AS target FROM sources
        ),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
        ),
        placed AS (
            SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
                sum(size) OVER (PARTITION BY p.source ORDER BY draw, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
            FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, size, source_size, target,
            (size * (whole + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM placed""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_quality_rules": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        lines AS (
            SELECT row, doc_id, host, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line,
                unnest(range(len(string_split(text, chr(10))))) AS place
            FROM docs
        ),
        worded AS (
            SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                array_to_string(regexp_extract_all(regexp_replace(translate(line,
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm
            FROM lines
        ),
        dups AS (
            SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded WHERE n > 0 GROUP BY row
        ),
        counted AS (
            SELECT host, norm, count(DISTINCT digest) AS documents, min((doc_id, row)) AS first
            FROM worded WHERE n > 0 GROUP BY host, norm
        ),
        frequent AS (
            SELECT * FROM counted WHERE documents > {quality.MAX_DOCUMENTS}
        ),
        removed AS (
            SELECT w.row, sum(w.n) AS removed FROM worded w
            JOIN frequent f ON w.host IS NOT DISTINCT FROM f.host AND w.norm = f.norm
            WHERE w.n > 0 AND (w.doc_id, w.row) <> f.first GROUP BY w.row
        ),
        grams AS (
            SELECT row, p, count(*) OVER (PARTITION BY row, a, b, c) AS times
            FROM (SELECT row, unnest(range(len(words) - 2)) AS p, unnest(words[:-3]) AS a, unnest(words[2:-2]) AS b,
                    unnest(words[3:]) AS c
                FROM docs WHERE len(words) >= 3)
        ),
        covered AS (
            SELECT row, count(DISTINCT p + s) AS n_repeat_words FROM grams, range(3) t(s) WHERE times > 1 GROUP BY row
        ),
        judged AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                coalesce(removed, 0)::BIGINT AS n_removed_words
            FROM docs LEFT JOIN dups USING (row) LEFT JOIN covered USING (row) LEFT JOIN removed USING (row)
        )
        SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
            NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
                AND n_removed_words <= {quality.MAX_REMOVED} * n_words AS kept
        FROM judged""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep,
                row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS n
            FROM pages
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND n > 1 THEN keep END AS refers_to
        FROM p""",
    "op7_suffix_dedup": f"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
        w AS (
            SELECT doc_id, s, substr(h, 2 * s + 1, {2 * suffix_dedup.LENGTH}) AS k
            FROM (SELECT doc_id, h, unnest(range(n_bytes - {suffix_dedup.LENGTH - 1})) AS s FROM n)
        ),
        f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS again FROM w),
        e AS (
            SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {suffix_dedup.LENGTH}, true) AS apart
            FROM f WHERE again
        ),
        g AS (SELECT doc_id, s, sum(apart::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
        runs AS (SELECT doc_id, min(s) AS a, max(s) + {suffix_dedup.LENGTH} AS b FROM g GROUP BY doc_id, run),
        kept AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs
            UNION ALL
            SELECT n.doc_id, coalesce(max(b), 0), any_value(n_bytes) FROM n LEFT JOIN runs ON n.doc_id = runs.doc_id GROUP BY n.doc_id
        ),
        rest AS (
            SELECT n.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h
            FROM n JOIN kept ON n.doc_id = kept.doc_id GROUP BY n.doc_id
        ),
        lost AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
        SELECT n.doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(rest.h)) AS kept_sha256
        FROM n JOIN rest ON n.doc_id = rest.doc_id LEFT JOIN lost ON n.doc_id = lost.doc_id""",
    "op11_phrases": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        worded AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        words AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM worded),
        places AS (
            SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY p ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY p ORDER BY i) AS w3,
                lead(w1, 3) OVER (PARTITION BY p ORDER BY i) AS w4
            FROM words
        ),
        counted AS MATERIALIZED (
            SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
            UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM places WHERE w4 IS NOT NULL GROUP BY ALL
        ),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
        found AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counted WHERE size > 1 AND f >= {phrases.MIN_COUNT}),
        inside AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM found, range(2, {phrases.MAX_WORDS}) t(m) WHERE m < size)
            GROUP BY ALL
        ),
        cuts AS MATERIALIZED (
            SELECT o.lang, o.phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM found o LEFT JOIN inside i ON o.lang = i.lang AND o.phrase = i.phrase, range(1, {phrases.MAX_WORDS}) t(k)
            WHERE k < size AND coalesce(100::HUGEINT * longer < {phrases.CONTAINED_PERCENT}::HUGEINT * a, true)
        ),
        headed AS MATERIALIZED (SELECT c.*, h.f AS l FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = head),
        scored AS (
            SELECT c.lang, c.phrase, a, l, t.f AS r, ({phrases.SCALE}::HUGEINT * a // (l + t.f))::BIGINT AS score,
                row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY {phrases.SCALE}::HUGEINT * a // (l + t.f), k) AS weakest
            FROM headed c JOIN counted t ON t.lang = c.lang AND t.phrase = tail
        ),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
            FROM scored WHERE weakest = 1
        )
        SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= {phrases.TOP}""",
    "op12_minhash": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        places AS (SELECT doc_id, unnest(w) AS w1, unnest(range(len(w))) AS i FROM worded),
        grams AS (
            SELECT doc_id, w1 || ' ' || lead(w1, 1) OVER t || ' ' || lead(w1, 2) OVER t || ' ' || lead(w1, 3) OVER t AS s
            FROM places WINDOW t AS (PARTITION BY doc_id ORDER BY i)
        ),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, s FROM grams WHERE s IS NOT NULL
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND {minhash.SHINGLE_WORDS - 1}
        ),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ),
        links AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
            WHERE 100 * n_both >= {minhash.PERCENT} * (x.n + y.n - n_both)
        ),
        sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
        named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
}

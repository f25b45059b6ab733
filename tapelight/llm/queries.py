"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, exact_dedup, html_text, line_dedup, maxent, near_dedup, packing, pii, quality, resample, token_file, url_filter
from .scratch import folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    token_file.write_ids(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_file.read_ids(spark, path, ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read(spark, sf_dir, "documents")).drop("redacted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"), k=4, percent=80)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.train_quality(documents, read(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# What of the operators' results SQL can express, to compare it over whole tables.


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("verdict_by_rule"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = [
    op1_token_files, op2_pii, op3_line_dedup, op4_minhash_near_dedup, op5_exact_dedup, op6_html_extraction, op7_url_filter,
    op8_byte_bpe, op9_quality_rules, op10_best_fit_packing, op11_language_model, op12_collocations, op13_importance_resampling,
    pii_base_counts, url_rules, quality_counts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: SQL for the same rows, where SQL can express them.
ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "pii_base_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
            list_transform(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_transform(string_split(x, '.'), lambda p: ltrim(p, '0'))) AS ips,
            list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: string_split(regexp_replace(x, '[^0-9]', '', 'g'), '')) AS cards,
            list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d)
        SELECT doc_id, len(emails) AS n_email,
            len(list_filter(ips, lambda x: len(list_filter(x, lambda p: len(p) > 3 OR coalesce(try_cast(p AS INTEGER), 0) > 255)) = 0)) AS n_ip,
            len(list_filter(cards, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(list_reverse(x),
                lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER ELSE 2 * c::INTEGER // 10 + 2 * c::INTEGER % 10 END)) % 10 = 0)) AS n_card,
            len(list_filter(phones, lambda n: n BETWEEN 9 AND 15)) AS n_phone FROM found""",
    "url_rules": r"""
        WITH parted AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosted AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parted),
        rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)),
        fitting AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS verdict_by_rule FROM hosted
            JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict_by_rule FROM hosted LEFT JOIN fitting USING (page_id)""",
    "quality_counts": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        runs AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS run FROM d),
        twice AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
        repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY row),
        lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d)
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
            len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
        FROM d JOIN lines USING (row) LEFT JOIN repeated USING (row)""",
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
        worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        words AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
        phrases AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
            FROM worded, range(1, 6) r(size) WHERE len(w) >= size),
        frequent AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
        longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f,
            unnest([array_to_string(string_split(phrase, ' ')[1:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:size], ' ')]) AS phrase
            FROM frequent WHERE size >= 3) GROUP BY ALL),
        cuts AS (SELECT c.lang, c.phrase, c.f AS a, n, k, h.f AS l, t.f AS r, 1000 * c.f * n // (h.f * t.f) AS score
            FROM (SELECT f.*, unnest(range(1, size)) AS k FROM frequent f LEFT JOIN longer g USING (lang, phrase) WHERE size >= 2 AND (g.f IS NULL OR g.f < f.f)) c
            JOIN words USING (lang)
            JOIN frequent h ON h.lang = c.lang AND h.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
            JOIN frequent t ON t.lang = c.lang AND t.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER w AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
    "op13_importance_resampling": r"""
        WITH RECURSIVE turns AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM turns WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM turns WHERE k = 8),
        texts AS (SELECT 'd' AS side, row_number() OVER () AS id, doc_id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
        worded AS MATERIALIZED (SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        runs AS (SELECT side, id, unnest(w) AS f FROM worded
            UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
            UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
        counted AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))),
            lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc),
        bucketed AS MATERIALIZED (SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
        both_sides AS (SELECT r.i AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
            FROM range(10000) r(i) LEFT JOIN bucketed b ON b.bucket = r.i GROUP BY r.i),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM both_sides),
        weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
        scored AS (SELECT id, doc_id, len(w) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM worded LEFT JOIN weights USING (id) WHERE side = 'd'),
        placed AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS FIRST) AS place,
            5 * count(*) OVER (PARTITION BY long_enough) // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= drawn THEN place END AS rank FROM placed""",
}

"""The operators as queries over the sample tables, and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import ann, exact_dedup, filter_audit, language_id, near_dedup, packing, pii, quality_rules, sentencepiece_codec, sharding, target_resampling, toxicity, url_filter
from flowlens.llm.tables import table


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.concatenate_and_cut(table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, folder, "documents"))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, folder, "documents"), packing.vocabulary("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"))


def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_ann": op4_ann,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_target_resampling": op11_target_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE = {
    "op3_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
            FROM cut
        ), urls AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(tail, '^[^?#]*') AS path
            FROM parts
        ), rules(rule, rule_host, rule_path, verdict) AS (VALUES
            ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
            ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
            ('com/de/', 'com', '/de/', 'block')
        ), fits AS (
            SELECT urls.*, rule, rules.verdict,
                row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS place
            FROM urls LEFT JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY text)""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, shingle FROM (
                SELECT doc_id, unnest(CASE WHEN len(words) >= 5
                    THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
                    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
                FROM w)
        ), sizes AS (
            SELECT documents.doc_id, count(shingle) AS n FROM documents LEFT JOIN s ON documents.doc_id = s.doc_id GROUP BY 1
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b
            ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
            WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        ), smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT sizes.doc_id, n AS n_shingles, component_id, sizes.doc_id = component_id AS kept
        FROM sizes JOIN smallest ON sizes.doc_id = smallest.doc_id""",
    "op11_target_resampling": r"""
        WITH texts AS (
            SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
        ), words AS (
            SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM texts
        ), counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY 1, 2, 3),
        hexed AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted),
        bytes AS (
            SELECT word, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, length(h) // 2)] AS b FROM hexed
        ), hashed AS (
            SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
                lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                    lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) % 10000 AS bucket
            FROM bytes
        ), features AS (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed ON counted.word = hashed.word GROUP BY 1, 2, 3),
        totals AS (
            SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s,
                CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t FROM features GROUP BY 1
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000)
                / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals
        ), weighed AS (
            SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM features JOIN gains ON features.bucket = gains.bucket
            WHERE side = 'd' GROUP BY 1
        ), scored AS (
            SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8) AS BIGINT)
                    + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN weighed ON documents.doc_id = weighed.doc_id
        ), placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM scored WHERE n_features >= 20
        )
        SELECT scored.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
        FROM scored LEFT JOIN placed ON scored.doc_id = placed.doc_id""",
    "op12_filter_audit": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), fails AS (
            SELECT part, coalesce(quality = 1, false) AS good, coalesce(t2.toxic = 1, false) AS toxic,
                CAST(len(words) < 200 AS INTEGER)
                + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
                + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
                + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
                + 16 * CAST(t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS INTEGER) AS mask
            FROM t LEFT JOIN labels AS t2 ON t.doc_id = t2.doc_id
        ), orders(filter_order) AS (
            SELECT '' UNION ALL
            SELECT filter_order || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) AS letters
            WHERE instr(filter_order, x) = 0
        ), steps AS (
            SELECT filter_order, step, list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(filter_order, 1, step - 1), '') IF x <> '']) AS earlier,
                1 << (ascii(substr(filter_order, step, 1)) - 65) AS own
            FROM orders, range(1, 6) AS s(step) WHERE length(filter_order) = 5
        ), atoms AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fails GROUP BY 1, 2
        ), counted AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
                CAST(coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | own) = 0), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(n_good) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(n_toxic) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS toxic_lost
            FROM atoms, steps GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counted""",
}

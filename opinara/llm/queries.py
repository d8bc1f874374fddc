"""The named queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from opinara.llm import (
    filter_audit,
    host_rules,
    jaccard_groups,
    licences,
    line_windows,
    main_text,
    manifest,
    packing,
    preferences,
    suffix_groups,
    templates,
    token_counts,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL filter as host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.rv, 'allow') AS verdict
FROM (SELECT p.*, (SELECT max(struct_pack(n := length(rh) + length(rp), h := length(rh), rule := rh || rp, rv := rv)) FROM rules
                   WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS best FROM parts p)
"""


@query("op4_url_filter", URL_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


QUALITY_SQL = r"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM base),
places AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM split),
windows AS (SELECT doc_id, i, words[i:i + 4] AS w FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT s.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source),
moments AS (SELECT avg(failed / n) AS mean, var_samp(failed / n) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var > 0 AND var < mean * (1 - mean) THEN mean * (1 - mean) / var - 1 ELSE 1.0 END AS weight FROM moments),
rated AS (SELECT source, (failed + mean * weight) / (n + weight) AS rate, n + weight AS total FROM hosts, prior),
verdict AS (SELECT source, rate - 2.0 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 AS rejected FROM rated)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT v.rejected AS kept
FROM f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query("op9_licence_scan")
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


PREFERENCE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
replies AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM n WHERE role = 'assistant'),
ends AS (SELECT c.conv_id, l.i AS last, l.text AS good, coalesce(e.text, '') AS poor FROM (SELECT DISTINCT conv_id FROM n) c
         LEFT JOIN replies l ON c.conv_id = l.conv_id AND l.back = 1 LEFT JOIN replies e ON c.conv_id = e.conv_id AND e.back = 2),
cut AS (SELECT *, last IS NULL OR good = poor AS equal FROM ends),
prompt AS (SELECT c.conv_id, count(n.i) AS prompt_turns, coalesce(string_agg('<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10), '' ORDER BY n.i), '') AS prompt
           FROM cut c LEFT JOIN n ON c.conv_id = n.conv_id AND (c.last IS NULL OR n.i < c.last OR (c.equal AND n.i = c.last)) GROUP BY c.conv_id)
SELECT c.conv_id, CAST(prompt_turns AS INTEGER) AS prompt_turns, prompt,
       CASE WHEN equal THEN '' ELSE '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) END AS chosen,
       CASE WHEN equal THEN '' ELSE '14:' || (length(good) + 8) END AS chosen_mask,
       CASE WHEN equal THEN '' ELSE '<|assistant|>' || chr(10) || poor || '<|end|>' || chr(10) END AS rejected,
       CASE WHEN equal THEN '' ELSE '14:' || (length(poor) + 8) END AS rejected_mask
FROM cut c JOIN prompt p ON c.conv_id = p.conv_id
"""


@query("op8_preference_pairs", PREFERENCE_SQL)
def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last reply, against the same one with its earlier reply in that place."""
    conversations = preferences.collect_turns(table(spark, sf_dir, "conversations"))
    chosen, rejected = preferences.with_earlier_reply(F.col("turns"))
    return preferences.format_pairs(conversations.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected")))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item of the benchmark, with the item."""
    found = templates.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), odd=True)
    return found.withColumnRenamed("doc_key", "doc_id").drop("text_hash")


LINES_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
trimmed AS (SELECT doc_id, i, line, regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS t FROM lines),
numbered AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o, count(*) OVER (PARTITION BY doc_id) AS n FROM trimmed WHERE t <> ''),
windows AS (SELECT doc_id, o, list(t) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w, n FROM numbered),
whole AS (SELECT doc_id, o, w FROM windows WHERE len(w) = 3 OR (n < 3 AND o = 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, o) AS r FROM whole),
gone AS (SELECT DISTINCT doc_id, o + k AS o FROM ranked, range(3) AS s(k) WHERE r > 1),
marked AS (SELECT t.doc_id, t.i, t.line, t.t, g.o IS NOT NULL AS removed FROM trimmed t LEFT JOIN numbered n ON t.doc_id = n.doc_id AND t.i = n.i
           LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.o = g.o),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed) AS rest, bool_or(NOT removed AND t <> '') AS any_left,
                  count(*) FILTER (removed) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(j.n_removed, 0) = 0 THEN d.text WHEN j.any_left THEN j.rest ELSE '' END AS text, CAST(coalesce(j.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


AUDIT_SQL = r"""
WITH RECURSIVE base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM base),
lost AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT s.doc_id, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
                  concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                         CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END,
                         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                         CASE WHEN min(s.doc_id) OVER (PARTITION BY t) < s.doc_id THEN 'E' ELSE '' END) AS f
           FROM split s LEFT JOIN lost l ON s.doc_id = l.doc_id),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(c) WHERE strpos(o, c) = 0),
steps AS (SELECT o, i, o[i:i] AS c, o[1:i - 1] AS before FROM orders, range(1, 6) AS r(i) WHERE length(o) = 5),
kinds AS (SELECT part, f, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
each AS (SELECT part, o, i, c, f, good, toxic, n, strpos(f, c) > 0 AS fails, translate(f, before, '') <> f AS gone FROM kinds, steps),
summed AS (SELECT part, o AS filter_order, CAST(i AS INTEGER) AS step, c,
                  sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = c THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
           FROM each GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM summed
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_groups.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
           CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
           CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head,
           xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte:
               list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) AS crc FROM documents),
leaves AS (SELECT *, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
                  CASE WHEN text IS NOT NULL AND crc % 2 = 0 THEN sha256(concat(head, strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), ''))) END AS other FROM d),
placed AS (SELECT doc_id, source, leaf, coalesce(other, leaf) AS shown, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, level, i, h, n) AS (
    SELECT source, 0, i, leaf, n FROM placed
    UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, h, n) AS (
    SELECT 0, k, subroot, n FROM subroots
    UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
root AS (SELECT h AS root FROM tops WHERE n = 1),
spots AS (SELECT p.*, s.subroot, s.k FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source),
path AS (
    SELECT a.source, a.i AS leaf_at, x.level AS level, x.i AS i, x.h AS h, a.i // pow(3, x.level)::BIGINT AS own FROM spots a JOIN nodes x
        ON a.source IS NOT DISTINCT FROM x.source AND x.n > 1 AND x.i // 3 = a.i // pow(3, x.level + 1)::BIGINT
    UNION ALL
    SELECT a.source, a.i, 1000 + x.level, x.i, x.h, a.k // pow(3, x.level)::BIGINT FROM spots a JOIN tops x ON x.n > 1 AND x.i // 3 = a.k // pow(3, x.level + 1)::BIGINT),
proofs AS (SELECT source, leaf_at, sha256(coalesce(string_agg(h, '' ORDER BY level, i) FILTER (i <> own), '')) AS proof FROM path GROUP BY source, leaf_at),
runs AS (SELECT source, leaf_at, row_number() OVER (PARTITION BY source, leaf_at ORDER BY level) AS step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS l,
                coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS r FROM path GROUP BY source, leaf_at, level),
folds(source, leaf_at, step, h) AS (
    SELECT source, i, 0, shown FROM spots
    UNION ALL SELECT f.source, f.leaf_at, f.step + 1, sha256(r.l || f.h || r.r) FROM folds f JOIN runs r
        ON f.source IS NOT DISTINCT FROM r.source AND f.leaf_at = r.leaf_at AND r.step = f.step + 1),
folded AS (SELECT source, leaf_at, max_by(h, step) AS h FROM folds GROUP BY source, leaf_at)
SELECT a.doc_id, a.leaf, a.subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM spots a JOIN folded f ON a.source IS NOT DISTINCT FROM f.source AND a.i = f.leaf_at LEFT JOIN proofs p ON a.source IS NOT DISTINCT FROM p.source AND a.i = p.leaf_at, root
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even checksum present their text without line breaks."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return manifest.document_manifest(table(spark, sf_dir, "documents"), tampered)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

"""Registered queries of the subpackage: thin digests of the operators'
results over whole tables, with DuckDB SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.decontam import benchmark_matches
from quarry.llm.html_main import main_text
from quarry.llm.merkle import tamper_check
from quarry.llm.mixing import mix_sources
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.pieces import decode_pieces, encode_pieces
from quarry.llm.pii import personal_data
from quarry.llm.quality_knn import quality_votes
from quarry.llm.quality_rules import BASE, quality_rules
from quarry.llm.toxicity import toxicity
from quarry.llm.urlfilter import Rule, judge_urls
from quarry.llm.warc import archive_round_trip
from quarry.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules on (host, path), and the labels that put a host on the list.
URL_RULES = [Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True)]
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

#: Weights by source in code point order, repeating.
MIX_WEIGHTS = [3.0, 1.0, 2.0]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def mix_sql(docs: str) -> str:
    """The mix over relation ``docs`` (doc_id, text, source, ...): all its
    columns with size, source_size, target, taken."""
    return rf"""
WITH RECURSIVE sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
         / CASE WHEN length(text) > 0
                THEN 0.1 + 0.9 * length(translate(text, '#*$%&|<>0123456789', '')) / length(text) ELSE 0.1 END AS draw
  FROM ({docs}) d),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                          WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM totals),
-- start with every source open; close those above their cap and share anew
shares AS (
  SELECT 0 AS step, NULL::DOUBLE AS level, (SELECT 1.5 * sum(source_size) FROM weighted)::DOUBLE AS budget
  UNION ALL
  SELECT step + 1,
         (SELECT (s.budget - coalesce(sum(cap) FILTER (WHERE s.level IS NOT NULL AND s.level * w > cap), 0))
                 / sum(w) FILTER (WHERE s.level IS NULL OR s.level * w <= cap) FROM weighted)::DOUBLE, budget
  FROM shares s WHERE step < 200),
level AS (SELECT max(level) AS level FROM shares),
targets AS (SELECT source, source_size, coalesce(least(level * w, cap), cap) AS target FROM weighted, level),
joined AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT * EXCLUDE (before, epochs, draw),
       CAST(least(epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken
FROM joined"""


@query("op1_url_filter", """
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
               ELSE 'allow' END AS verdict FROM ruled""")
def op1(spark, sf_dir):
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


@query("op2_mix_sources",
       f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql('SELECT doc_id, text, source FROM documents')}) m")
def op2(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_warc", """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS least FROM payloads GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM payloads JOIN firsts USING (h)""")
def op3(spark, sf_dir):
    out = archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_decontamination")
def op4(spark, sf_dir):
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def jaccard_sql(docs: str) -> str:
    """doc_id, n_shingles, component_id over relation ``docs`` (doc_id, text)."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM ({docs}) d),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT x AS doc_id, y AS other FROM links
          UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(sets.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = sets.doc_id), sets.doc_id)) AS component_id
FROM sets"""


@query("op5_ngram_jaccard", jaccard_sql("SELECT doc_id, text FROM documents"))
def op5(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_personal_data")
def op7(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


@query("op8_quality_votes")
def op8(spark, sf_dir):
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality_rules")
def op9(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")


@query("op10_main_text")
def op10(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


_FIELD = "coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def merkle_sql(docs: str) -> str:
    """Leaves, roots, proofs and folds over relation ``docs``; the crc32 runs
    over the digits of the id, a bit at a time."""
    leaf = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    return rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf.format(text="text")} AS leaf,
         CASE WHEN (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0
              THEN {leaf.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM ({docs}) d),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
nodes AS (SELECT 0 AS level, tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
          UNION ALL
          SELECT level + 1, tree, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
          FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 8),
tops AS (SELECT 0 AS level, tree AS pos, node, count(*) OVER () AS n FROM nodes WHERE n = 1
         UNION ALL
         SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
         FROM tops WHERE n > 1 GROUP BY level, pos // 8),
runs AS (SELECT 0 AS part, level, tree, pos // 8 AS run, string_agg(node, '' ORDER BY pos) AS kids
         FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 8
         UNION ALL
         SELECT 1, level, NULL, pos // 8, string_agg(node, '' ORDER BY pos) FROM tops WHERE n > 1 GROUP BY level, pos // 8),
places AS (SELECT p.tree, p.pos, r.part, r.level, r.kids,
                  (CASE r.part WHEN 0 THEN p.pos ELSE p.tree END >> (3 * r.level)) % 8 AS slot
           FROM placed p JOIN runs r ON (r.part = 0 AND r.tree = p.tree AND r.run = p.pos >> (3 * r.level + 3))
                                     OR (r.part = 1 AND r.run = p.tree >> (3 * r.level + 3))),
ways AS (SELECT tree, pos,
                list(substr(kids, 1, 64 * slot) || '|' || substr(kids, 64 * slot + 65) ORDER BY part, level) AS steps
         FROM places GROUP BY tree, pos),
folds AS (
  SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM tops WHERE n = 1) AS root,
         sha256(replace(array_to_string(coalesce(w.steps, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(p.tampered, p.leaf), coalesce(w.steps, [])),
                     lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed p JOIN (SELECT tree, node FROM nodes WHERE n = 1) s ON p.tree = s.tree
  LEFT JOIN ways w ON w.tree = p.tree AND w.pos = p.pos)
SELECT *, folded_root = root AS verified FROM folds"""


@query("op11_merkle_manifest", merkle_sql("SELECT doc_id, source, lang, n_chars, text FROM documents"))
def op11(spark, sf_dir):
    return tamper_check(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(docs, model, ["doc_id"]), model)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_sentencepiece")
def op13(spark, sf_dir):
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

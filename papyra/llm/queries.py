"""The registered queries of this subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from . import bpe, fingerprints, language_id, lexical, license_scan, merkle, mixing, near_duplicates, packing, quality, sharding, topk, url_filter


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, bytes_col="decoded"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path the language section within it."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, labels, F.col("source"), F.col("lang"), keep_text=False)
    return scored.select("doc_id", "p_doc", "host_rate", "path_rate", "score", "keep")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"), "sampled")


#: Rules of the registered query: host, path, verdict (fixed by the contract).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(read(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_topk": op8_topk,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    # All pairs that share a shingle, counted; their links closed to classes.
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
     s AS (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE ['raw: ' || text] END) AS g FROM w),
     g AS (SELECT DISTINCT r, g FROM s),
     n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
     p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
     l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
     e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
     c(u, x) AS (SELECT r, r FROM d UNION SELECT c.u, e.v FROM c JOIN e ON e.u = c.x),
     k AS (SELECT c.u AS r, min(d.doc_id) AS class_id FROM c JOIN d ON d.r = c.x GROUP BY c.u),
     m AS (SELECT u AS r, count(*) AS n FROM e GROUP BY u)
SELECT d.doc_id, k.class_id, coalesce(m.n, 0)::BIGINT AS n_links FROM d JOIN k USING (r) LEFT JOIN m USING (r)
""",
    # Levels of all trees one after another; a proof's siblings by their coordinates.
    "op12_merkle": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g, source, lang, n_chars, text FROM documents),
     f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM d),
     x AS (SELECT r, doc_id, g, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                  CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS more, head, tail FROM (
           SELECT *, coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT), 1) AS crc FROM f)),
     l AS (SELECT r, doc_id, g, leaf, sha256(head || coalesce(length(more::VARCHAR) || ':' || more, '-') || tail) AS bad,
                  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM x),
     t(g, level, pos, h, n) AS (
       SELECT g, 0, pos, leaf, n FROM l
       UNION ALL
       SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY g, level, pos // 2),
     s AS (SELECT g, h, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
     u(level, pos, h, n) AS (
       SELECT 0, pos, h, n FROM s
       UNION ALL
       SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY level, pos // 2),
     a AS (SELECT g, level, pos, h, n FROM t WHERE n > 1 UNION ALL SELECT s.g, s.height + u.level, u.pos, u.h, u.n FROM s, u WHERE u.n > 1),
     w(r, g, level, place, acc, sib, doc_id, leaf) AS (
       SELECT r, g, 0, pos, bad, '', doc_id, leaf FROM l
       UNION ALL
       SELECT r, w.g, w.level + 1, CASE WHEN w.level + 1 = s.height THEN s.pos ELSE place // 2 END,
              sha256(CASE WHEN o.h IS NULL THEN acc WHEN place % 2 = 1 THEN o.h || acc ELSE acc || o.h END), sib || coalesce(o.h, ''), doc_id, leaf
       FROM (SELECT w.r, w.g, w.level, CASE WHEN w.level = s.height THEN s.pos ELSE w.place END AS place, w.acc, w.sib, w.doc_id, w.leaf FROM w JOIN s USING (g)) w
       JOIN s USING (g) JOIN a k ON k.g = w.g AND k.level = w.level AND k.pos = w.place LEFT JOIN a o ON o.g = w.g AND o.level = w.level AND o.pos = xor(w.place, 1)),
     z AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS last FROM w)
SELECT z.doc_id, z.leaf, s.h AS subroot, p.h AS root, sha256(z.sib) AS proof_sha256, z.acc AS folded_root, z.acc = p.h AS verified
FROM z JOIN s USING (g), (SELECT h FROM u WHERE n = 1) p WHERE z.last = 1
""",
    "op13_lexical": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     n AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
     c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
     p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM n) GROUP BY r, t),
     f AS (SELECT t, floor(1000 * ln((2 * c.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.docs),
     s AS (SELECT item_id, r, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n.n * c.docs) // c.l))))::BIGINT AS score
           FROM q JOIN p USING (t) JOIN f USING (t) JOIN n USING (r), c GROUP BY item_id, r),
     k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
""",
    "op4_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
     h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
     r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) = 1
""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}

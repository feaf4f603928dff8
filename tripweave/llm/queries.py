"""The registered queries of these operators, over whole tables, and SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (decontaminate, embedding_dedup, hard_negatives, language_id, line_dedup, merkle,
               packing, pii, sharding, simhash_dedup, token_counts, token_matrix, url_filter)

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
         url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    """Outcomes are the labels of the documents with a page's id."""
    labels = _table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), outcomes, RULES)


def op2_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=2)


def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), 512)


def held_out(key):
    """Rows never learnt from: crc32 of the id as text is 2 modulo 4; a null id counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def op4_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    return language_id.predict(docs, model, {"doc_id": F.col("doc_id"),
                                             "held_out": held_out(F.col("doc_id"))})


def op5_pii(spark, sf_dir):
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS),
                        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.concat("base", "added")).alias("spans"))


def op6_decontaminate(spark, sf_dir):
    found = decontaminate.find(_table(spark, sf_dir, "documents"),
                               _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed")


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_token_matrix(spark, sf_dir):
    return token_matrix.pack_matrix(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 4096,
        end_id=50256, pad_id=50256).withColumnRenamed("keys", "doc_ids")


def op10_simhash_dedup(spark, sf_dir):
    return simhash_dedup.report(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark, sf_dir):
    """Some rows are looked at with one more in n_chars than the manifest has."""
    docs = _table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(columns)]
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    found = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf(columns),
                            {"doc_id": F.col("doc_id"),
                             "seen": F.when(picked, merkle.leaf(changed))})
    folded = merkle.fold(F.coalesce("seen", "leaf"), F.col("steps"))
    return (found.select("doc_id", "leaf", "subroot", "root",
                         merkle.digest(merkle.proof(F.col("steps"))).alias("proof_sha256"),
                         folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op13_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_packing, op3_token_counts, op4_language_id, op5_pii, op6_decontaminate,
    op7_line_dedup, op8_embedding_dedup, op9_token_matrix, op10_simhash_dedup,
    op11_hard_negatives, op12_merkle_manifest, op13_sharding)}

_SUFFIX2 = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)
_STRENGTH = f"""
    SELECT CASE WHEN count(*) FILTER (n > 0) < 2 OR sum(k) = 0 OR sum(k) = sum(n)
        THEN {url_filter.MOST_STRENGTH} ELSE (
        SELECT CASE WHEN room <= 0 OR rho <= 0 THEN {url_filter.MOST_STRENGTH}
               ELSE least({url_filter.MOST_STRENGTH}, greatest({url_filter.LEAST_STRENGTH},
                                                               1 / rho - 1)) END
        FROM (SELECT t - sq / t - (g - 1) AS room,
                     (r - b / t * b / t * t - b / t * (1 - b / t) * (g - 1))
                     / (b / t * (1 - b / t) * (t - sq / t - (g - 1))) AS rho
              FROM (SELECT count(*) FILTER (n > 0) AS g, sum(n)::DOUBLE AS t, sum(k)::DOUBLE AS b,
                           sum(n::DOUBLE * n) AS sq,
                           sum(k::DOUBLE * k / nullif(n, 0)) AS r FROM LEVEL))) END FROM LEVEL"""
_FIELDS = ", ".join(
    f"coalesce(octet_length(encode({v})) || ':' || {v}, '-') AS {n}" for n, v in (
        ("f_doc", "doc_id::VARCHAR"), ("f_source", "source"), ("f_lang", "lang"),
        ("f_chars", "n_chars::VARCHAR"), ("f_more", "(n_chars + 1)::VARCHAR"), ("f_text", "text")))
_RULE = """CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END"""

ORACLES = {
    "op1_url_filter": rf"""
WITH p AS (SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                 '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
                              WHEN quality IS NOT NULL THEN 0 END) AS bad
      FROM labels GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k
      FROM p LEFT JOIN l ON doc_id = page_id GROUP BY 1),
two AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS l2 FROM h),
h2 AS (SELECT *, l2 IN ({_SUFFIX2}) AS long,
        CASE WHEN l2 IN ({_SUFFIX2}) THEN l2 ELSE string_split(host, '.')[-1] END AS suffix,
        CASE WHEN l2 IN ({_SUFFIX2}) THEN array_to_string(string_split(host, '.')[-3:], '.')
             ELSE l2 END AS domain FROM two),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
m AS (SELECT coalesce((SELECT sum(k) / nullif(sum(n), 0) FROM h), 0) AS m0,
             ({_STRENGTH.replace("LEVEL", "h2")}) AS mh, ({_STRENGTH.replace("LEVEL", "d")}) AS md,
             ({_STRENGTH.replace("LEVEL", "s")}) AS ms),
s2 AS (SELECT suffix, (k + ms * m0) / (n + ms) AS up FROM s, m),
d2 AS (SELECT d.domain, d.suffix, (k + md * up) / (n + md) AS up FROM d JOIN s2 USING (suffix), m),
r AS (SELECT host, k + mh * up AS a, n - k + mh * (1 - up) AS b
      FROM h2 JOIN d2 USING (domain, suffix), m),
q AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a / (a + b) * (1 - a / (a + b))
                                                      / (a + b + 1)) AS bound FROM r),
j AS (SELECT page_id, host, path, {_RULE} AS rule, bound FROM p JOIN q USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound > {url_filter.MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM j
""",
    "op7_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
x AS (SELECT r, doc_id, text, '=' || source AS site, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (SELECT *, trim(line) AS t FROM x WHERE trim(line) <> ''),
one AS (SELECT t, text, pos, min(doc_id) AS key FROM l GROUP BY 1, 2, 3),
wide AS (SELECT t FROM l GROUP BY 1 HAVING count(DISTINCT coalesce(site, '')) >= 10),
stays AS (SELECT t, text, pos FROM one JOIN wide USING (t)
          QUALIFY row_number() OVER (PARTITION BY t ORDER BY key NULLS LAST, text, pos) = 1),
gone AS (SELECT x.r, x.pos FROM x JOIN wide ON trim(x.line) = wide.t
         ANTI JOIN stays ON stays.text = x.text AND stays.pos = x.pos)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE
         coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (gone.pos IS NULL), '') END
         AS text, count(x.pos)::INTEGER AS n_lines, count(gone.pos)::INTEGER AS n_removed
FROM d LEFT JOIN x USING (r) LEFT JOIN gone ON gone.r = x.r AND gone.pos = x.pos
GROUP BY d.r, d.doc_id, d.text
""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e
                     FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS links FROM l GROUP BY 1),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS cand, a.label = c.label AS same,
             list_inner_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, cand AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY ar ORDER BY score DESC, cand, cr) AS slot
      FROM s WHERE same QUALIFY slot <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS INTEGER) AS rank,
       cand AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same
     AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.ar, slot ORDER BY score DESC, cand, cr) QUALIFY rank <= 5
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)), lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384)
                                                  ELSE x >> 1 END)) AS crc),
d AS (SELECT *, row_number() OVER () AS r, list_reduce(list_prepend(4294967295,
             [ascii(x)::BIGINT FOR x IN string_split(coalesce(doc_id::VARCHAR, ''), '')
              IF x <> '']), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])) AS k
      FROM documents, c),
f AS (SELECT r, doc_id, lang, xor(k, 4294967295) % 7 = 0 AS picked, {_FIELDS} FROM d),
l AS (SELECT r, doc_id, lang, sha256(f_doc || f_source || f_lang || f_chars || f_text) AS leaf,
             CASE WHEN picked THEN sha256(f_doc || f_source || f_lang || f_more || f_text) END AS seen
      FROM f),
g AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
      FROM l WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
t AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM g
      UNION ALL
      SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
      FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
s AS (SELECT lang, max(lvl) AS height, arg_max(h, lvl) AS subroot,
             row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM t WHERE n = 1 GROUP BY lang),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM s
      UNION ALL
      SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
      FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
nodes AS (SELECT lang, lvl, pos, h, FALSE AS top FROM t WHERE n > 1
          UNION ALL SELECT NULL, lvl, pos, h, TRUE FROM u WHERE n > 1),
walk AS (SELECT r, g.lang, 0 AS lvl, g.pos, s.pos AS place, height,
                coalesce(seen, leaf) AS folded, '' AS proof
         FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang
         UNION ALL
         SELECT r, w.lang, w.lvl + 1, w.pos // 2, place, height,
                CASE WHEN x.h IS NULL THEN sha256(folded)
                     WHEN w.pos % 2 = 1 THEN sha256(x.h || folded) ELSE sha256(folded || x.h) END,
                proof || coalesce(x.h, '')
         FROM walk w LEFT JOIN nodes x ON NOT x.top AND x.lang IS NOT DISTINCT FROM w.lang
              AND x.lvl = w.lvl AND x.pos = xor(w.pos, 1)
         WHERE w.lvl < w.height),
up AS (SELECT r, 0 AS lvl, place AS pos, folded, proof FROM walk WHERE lvl = height
       UNION ALL
       SELECT r, up.lvl + 1, up.pos // 2, CASE WHEN x.h IS NULL THEN sha256(folded)
                  WHEN up.pos % 2 = 1 THEN sha256(x.h || folded) ELSE sha256(folded || x.h) END,
              proof || coalesce(x.h, '')
       FROM up LEFT JOIN nodes x ON x.top AND x.lvl = up.lvl AND x.pos = xor(up.pos, 1)
       WHERE up.lvl < (SELECT max(lvl) FROM u)),
e AS (SELECT r, folded AS folded_root, sha256(proof) AS proof_sha256 FROM up
      WHERE lvl = (SELECT max(lvl) FROM u))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang JOIN e USING (r),
     (SELECT h AS root FROM u WHERE n = 1)
""",
}

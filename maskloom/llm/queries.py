"""The registered queries of this subpackage: each applies an operator, with
production parameters, to its whole table."""

from __future__ import annotations

from maskloom.llm.urls import ADDRESS, BARE, IS_ADDRESS, IS_TWO
from maskloom.llm.util import table


def op1_token_files(spark, sf_dir):
    from maskloom.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    from maskloom.llm.packing import pack_documents

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack_documents(table(spark, sf_dir, "documents")).select(columns)


def op2_mix_sources(spark, sf_dir):
    from maskloom.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    from maskloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark, sf_dir):
    from maskloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark, sf_dir):
    from maskloom.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_exact_top_k(spark, sf_dir):
    from maskloom.llm.vectors import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark, sf_dir):
    from maskloom.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_secrets(spark, sf_dir):
    from maskloom.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    from maskloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
        op1_token_files,
        op2_mix_sources,
        op3_best_fit_packing,
        op4_quality,
        op5_toxicity,
        op6_nearest,
        op7_url_filter,
        op8_secrets,
        op9_simhash,
        op10_exact_top_k,
    )}

def _search_sql(kept: str, score: str, vector: str, every: int, k: int) -> str:
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""
WITH v AS (SELECT vec_id, {vector} AS v FROM embeddings WHERE {usable}{kept} AND vec_id IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {k}"""


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), r(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), j AS (
  SELECT *, (SELECT max(struct_pack(size := length(h) + length(p), rule := h || p, v := r.verdict)) FROM r
             WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS best FROM parsed
), hosts AS (
  SELECT host, count(best) AS n, count(CASE WHEN best.v = 'block' THEN 1 END) AS bad,
         regexp_replace(host, '{BARE}', '', 'g') AS bare FROM j GROUP BY host
), parts AS (
  SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '{IS_ADDRESS}') AS address, CASE WHEN regexp_matches(bare, '{IS_TWO}') THEN 2 ELSE 1 END AS k FROM hosts
), hs AS (
  SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(l[greatest(1, len(l) - k):len(l)], '.') END AS domain,
         CASE WHEN address THEN '{ADDRESS}' ELSE array_to_string(l[greatest(1, len(l) - k + 1):len(l)], '.') END AS suffix FROM parts
), ds AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hs GROUP BY 1, 2),
ss AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, 1 AS al FROM ds GROUP BY 1),
kids AS (
  SELECT 2 AS lv, domain AS g, n, bad FROM hs UNION ALL SELECT 1, suffix, n, bad FROM ds UNION ALL SELECT 0, 'all', n, bad FROM ss
), g AS (
  SELECT lv, g, sum(n)::DOUBLE AS nn, sum(bad)::DOUBLE AS b, count(*) AS k, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n) AS b2
  FROM kids WHERE n > 0 GROUP BY 1, 2
), e AS (
  SELECT lv, sum(b2 - b * b / nn) AS stray, sum((k - 1) * (b / nn) * (1 - b / nn)) AS noise,
         sum((b / nn) * (1 - b / nn) * (nn - n2 / nn - (k - 1))) AS room FROM g GROUP BY lv
), s AS (
  SELECT lv, least(10000.0, greatest(0.5, CASE WHEN room > 0 THEN CASE WHEN (stray - noise) / room > 0
         THEN 1 / ((stray - noise) / room) - 1 ELSE 10000.0 END ELSE 1.0 END)) AS strength FROM e
), c AS (
  SELECT coalesce((SELECT strength FROM s WHERE lv = 0), 1.0) AS s0, coalesce((SELECT strength FROM s WHERE lv = 1), 1.0) AS s1,
         coalesce((SELECT strength FROM s WHERE lv = 2), 1.0) AS s2,
         (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM ss) AS p0
), sp AS (SELECT suffix, s1, s2, (bad + s0 * p0) / (n + s0) AS p1 FROM ss, c),
dp AS (SELECT domain, s2, (bad + s1 * p1) / (n + s1) AS p2 FROM ds JOIN sp USING (suffix)),
hp AS (SELECT host, n + s2 AS size, (bad + s2 * p2) / (n + s2) AS rate FROM hs JOIN dp USING (domain)),
v AS (SELECT host, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS reputation FROM hp)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, reputation) AS verdict FROM j JOIN v USING (host)"""

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": URL_SQL,
    "op6_nearest": _search_sql(
        " AND len(list_filter(embedding, lambda x: x <> 0)) > 0", "list_inner_product(q.v, c.v)", "CAST(embedding AS DOUBLE[])", 20, 20
    ),
    "op10_exact_top_k": _search_sql(
        "",
        "CAST(list_inner_product(q.v, c.v) AS BIGINT)",
        "list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256))",
        50,
        5,
    ),
}

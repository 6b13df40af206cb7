"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, html_text, line_dedup, packing, quality, simhash, token_counts, topk, url_filter
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(read(spark, sf_dir, "documents"), shingle=3, most=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.url_filter(pages.select("page_id", "url"), url_filter.edges_of(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Html that names the page before as the canonical form or redirects to it, in one of three ways: chains of four pages.
CHAINS = """SELECT p.page_id, p.url, CASE p.page_id % 3 WHEN 0 THEN concat('<link rel="canonical" href="', q.url, '">') WHEN 1 THEN concat('<meta http-equiv=refresh content="0; url=', q.url, '">')
    ELSE concat('<link title="a > b" rel="alternate canonical" href=', q.url, '>') END AS html FROM {pages} p LEFT JOIN {pages} q ON q.page_id = p.page_id - 1 AND p.page_id % 4 <> 0"""


def url_filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter over the urls of pages and generated links: the tables' own pages name none."""
    pages = spark.sql(CHAINS, pages=read(spark, sf_dir, "pages").select("page_id", "url"))
    return url_filter.url_filter(pages.select("page_id", "url"), url_filter.edges_of(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), *token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, read(spark, sf_dir, "labels"))
    scores = quality.scored(docs, machine, keep=["doc_id"])
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dups(read(spark, sf_dir, "embeddings"))


#: The embeddings, and copies of every seventh that are bent more or less: to a cosine of 0.997 down to one below 0.93.
PLANTED = """SELECT vec_id, embedding, label FROM {embeddings} UNION ALL
    SELECT 1000000000 + vec_id AS vec_id, %s AS embedding, label FROM {embeddings} WHERE vec_id %% 7 = 0"""


def embedding_dedup_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-dedup over the embeddings and bent copies: the smaller tables hold no near copies of their own."""
    bent = "transform(embedding, (x, i) -> CAST(x * (1 + (1 + pmod(vec_id, 10)) / 10.0D * ((i + vec_id) % 3)) AS FLOAT))"
    return embedding_dedup.near_dups(spark.sql(PLANTED % bent, embeddings=read(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_top_k": op5_top_k,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
    "url_filter_chains": url_filter_chains,
    "embedding_dedup_planted": embedding_dedup_planted,
}

def _url_sql() -> str:
    """The URL filter over {pages}: tags, attributes, targets, what they mean on their page, and the blocks they pass on."""
    S = url_filter.S
    bare = lambda x: f"trim(regexp_replace(trim({x}, '{url_filter.BLANKS}'), '^[\"'']|[\"'']$', '', 'g'), '{url_filter.BLANKS}')"

    def decoded(x: str) -> str:
        x = bare(x)
        for name, stands in url_filter.REFERENCES:
            x = f"replace({x}, '{name}', '{stands.replace("'", "''")}')"
        return x

    value = url_filter.VALUE.replace("'", "''")
    attribute = lambda name: decoded(f"""regexp_extract(t, '(?is)[ \\t\\n\\f\\r"''/]{name}{value}', 1)""")
    page = lambda x: f"(translate(regexp_extract(regexp_extract({x}, '(?s)^([^#]*)', 1), '(?s)^(.*?://[^/?]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') || substr(regexp_extract({x}, '(?s)^([^#]*)', 1), length(regexp_extract(regexp_extract({x}, '(?s)^([^#]*)', 1), '(?s)^(.*?://[^/?]*)', 1)) + 1))"
    return f"""
        WITH RECURSIVE given AS (SELECT * FROM {{pages}}),
        tags AS (SELECT url AS u, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:link|meta)(?:{S}|/)(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS t
                 FROM given WHERE url IS NOT NULL AND html IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
        vals AS (SELECT u, lower(substr(t, 2, 4)) AS tag, lower({attribute("rel")}) AS rel, {attribute("href")} AS href, lower({attribute("http-equiv")}) AS equiv, {attribute("content")} AS content FROM tags),
        named AS (SELECT u, CASE WHEN tag = 'link' AND regexp_matches(rel, '(^|{S})canonical({S}|$)') THEN href
                         WHEN tag = 'meta' AND equiv = 'refresh' THEN {decoded(f"regexp_extract(content, '(?is)^(?:{S}|[0-9.])*[;,]?{S}*url{S}*=(.*)$', 1)")} END AS x FROM vals),
        own AS (SELECT u, x, regexp_extract(u, '(?s)^([^:/?#]*:)//', 1) AS scheme, regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(u, '(?s)^([^?#]*)', 1) AS page FROM named WHERE x <> '' AND NOT prefix(x, '#')),
        whole AS (SELECT u, CASE WHEN regexp_matches(x, '{url_filter.SCHEME}') THEN CASE WHEN contains(x, '://') THEN x END WHEN origin = '' THEN NULL WHEN prefix(x, '//') THEN scheme || x WHEN prefix(x, '/') THEN origin || x
                         WHEN prefix(x, '?') THEN page || x WHEN page = origin THEN origin || '/' || x ELSE regexp_extract(page, '(?s)^(.*/)', 1) || x END AS f FROM own),
        target AS (SELECT u, {page("f")} AS f FROM whole WHERE f IS NOT NULL),
        parts AS (SELECT u, regexp_extract(f, '(?s)^(.*?://[^/?]*)', 1) AS start, regexp_extract(f, '(?s)^.*?://[^/?]*([^?]*)', 1) AS path, regexp_extract(f, '(?s)^.*?://[^?]*(.*)$', 1) AS query FROM target),
        named_edges AS (SELECT {page("u")} AS a, start || CASE WHEN regexp_matches(path, '/\\.\\.?(/|$)')
                               THEN array_to_string(list_reduce(list_transform(string_split(path, '/')[2:], lambda s: [s]), lambda done, s: CASE WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] WHEN s[1] = '.' THEN done ELSE list_concat(done, s) END, ['']), '/')
                                    || CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN '/' ELSE '' END
                               ELSE path END || query AS b FROM parts),
        edges AS (SELECT a, b FROM named_edges WHERE a <> b UNION SELECT b, a FROM named_edges WHERE a <> b),
        nodes AS (SELECT DISTINCT url FROM given UNION SELECT a FROM edges),
        split AS (SELECT url, {page("url")} AS node, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM nodes),
        rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
        fitting AS (SELECT url, node, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, verdict) AS k
                    FROM split JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)),
        bad AS (SELECT node FROM fitting WHERE k = 1 AND verdict = 'block' UNION SELECT edges.b FROM bad JOIN edges ON edges.a = bad.node)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM given JOIN split ON split.url IS NOT DISTINCT FROM given.url LEFT JOIN (SELECT * FROM fitting WHERE k = 1) f ON f.url = given.url LEFT JOIN bad ON bad.node = split.node"""


URL_SQL = _url_sql()

NEAR_SQL = """
        WITH RECURSIVE given AS (SELECT * FROM {embeddings}),
        v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM given WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM given UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM given LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id"""

ORACLES = {
    "op1_line_dedup": f"""
        WITH lines AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
        often AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE line <> '' GROUP BY source, line),
        pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source),
        bad AS (SELECT source, list(line) AS bad FROM often JOIN pages USING (source) WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * {line_dedup.MAX_RATIO} GROUP BY source),
        cut AS (SELECT doc_id, string_split(text, chr(10)) AS old, list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(bad, nullif(trim(x, ' '), '')), false)) AS kept
                FROM documents LEFT JOIN bad USING (source))
        SELECT doc_id, CASE WHEN old IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
               coalesce(len(old), 0)::BIGINT AS n_lines, coalesce(len(old) - len(kept), 0)::BIGINT AS n_dropped
        FROM cut""",
    "op4_url_filter": URL_SQL.format(pages="pages"),
    "url_filter_chains": URL_SQL.format(pages=f"({CHAINS.format(pages='pages')})"),
    "op5_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 100 = 0),
        k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op10_embedding_dedup": NEAR_SQL.format(embeddings="embeddings"),
    "embedding_dedup_planted": NEAR_SQL.format(
        embeddings=f"({PLANTED.format(embeddings='embeddings') % 'list_transform(embedding, lambda x, i: CAST(x * (1 + (1 + vec_id % 10) / 10::DOUBLE * ((i - 1 + vec_id) % 3)) AS FLOAT))'})"
    ),
}

"""The registered queries over the operators of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, lexical, linededup, neardup, packing, pii, prefixtrie, quality, topk, toxicity, urlfilter, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(table(spark, sf_dir, "pages"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=3, threshold=Fraction(85, 100))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.drop_lines(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(spark, table(spark, sf_dir, "conversations"))


#: Verdict, host and path of each rule.
URL_RULES = [urlfilter.Rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_pii": op3_pii,
    "op4_decontam": op4_decontam,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_neardup": op8_neardup,
    "op9_toxicity": op9_toxicity,
    "op10_linededup": op10_linededup,
    "op11_lexical": op11_lexical,
    "op12_prefixtrie": op12_prefixtrie,
    "op13_urlfilter": op13_urlfilter,
}

def verdicts_sql(rounds: int = 12) -> str:
    """The rounds of masses are written out, one after the other."""
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    cases = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in rules) + " END"
    steps = ["m0 AS MATERIALIZED (SELECT trusted, host, mass FROM (SELECT true AS trusted, host, trust AS mass FROM h UNION ALL SELECT false, host, distrust FROM h) WHERE mass > 0)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"m{i} AS MATERIALIZED (SELECT trusted, host, sum(mass)::BIGINT AS mass FROM (SELECT trusted, host, mass * 15 // 100 AS mass FROM m0 "
            f"UNION ALL SELECT e.trusted, e.target, m.mass * 85 // (100 * e.degree) FROM m{i - 1} m JOIN e ON e.trusted = m.trusted AND e.source = m.host) GROUP BY ALL)"
        )
    link = urlfilter.LINK.replace("'", "''")
    return f"""
        WITH u AS (
            SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{urlfilter.HOST}', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(coalesce(url, ''), '{urlfilter.PATH}', 1) AS path FROM pages
        ), r AS (
            SELECT *, {cases(lambda r: r.name)} AS rule, {cases(lambda r: r.verdict)} AS said FROM u
        ), h AS MATERIALIZED (
            SELECT host, count(*) AS pages, 1000000 * count_if(said = 'allow')::BIGINT AS trust, 1000000 * count_if(said = 'block')::BIGINT AS distrust FROM r WHERE host <> '' GROUP BY host
        ), l AS (
            SELECT DISTINCT host AS source, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS target
            FROM u WHERE host <> ''
        ), b AS (
            SELECT true AS trusted, source, target FROM l WHERE source <> target UNION ALL SELECT false, target, source FROM l WHERE source <> target
        ), e AS MATERIALIZED (
            SELECT *, count(*) OVER (PARTITION BY trusted, source) AS degree FROM b
        ), {", ".join(steps)},
        s AS (
            SELECT host, coalesce(sum(mass) FILTER (trusted), 0) AS trust, coalesce(sum(mass) FILTER (NOT trusted), 0) AS distrust FROM m{rounds} GROUP BY host
        )
        SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN 2 * (s.distrust - s.trust) > h.pages * 150000 THEN 'block' END, 'allow') AS verdict
        FROM r LEFT JOIN h ON h.host = r.host LEFT JOIN s ON s.host = r.host
    """


ORACLES: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op8_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w
        ), e AS (
            SELECT doc_id, unnest(s) AS g FROM s
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
            WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)
        ), links AS (
            SELECT a, b FROM l UNION SELECT b, a FROM l
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, links.b FROM reach r JOIN links ON links.a = r.b
        ), m AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
        FROM s JOIN m USING (doc_id)
    """,
    "op10_linededup": """
        WITH a AS (
            SELECT row_number() OVER () AS r, doc_id, text, coalesce('s' || source, '') AS site, md5(coalesce(text, '')) AS whole,
                   string_split(coalesce(text, ''), chr(10)) AS l
            FROM documents
        ), b AS (
            SELECT r, site, whole, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM a
        ), c AS (
            SELECT *, trim(line, E' \t\n\r\x0b\x0c') AS k FROM b
        ), g AS (
            SELECT k FROM c WHERE k <> '' GROUP BY k
            HAVING count(DISTINCT site) >= 8 AND count(DISTINCT whole) >= 8
        ), f AS (
            SELECT c.*, g.k IS NOT NULL AS gone FROM c LEFT JOIN g USING (k)
        ), h AS (
            SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept,
                   count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed
            FROM f GROUP BY r
        )
        SELECT a.doc_id, CASE WHEN a.text IS NOT NULL THEN h.kept END AS text, h.n_lines, h.n_removed
        FROM h JOIN a USING (r)
    """,
    "op11_lexical": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), i AS (
            SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark
        ), q AS (
            SELECT i, item_id, t, count(*) AS c FROM i GROUP BY ALL
        ), s AS (
            SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
        ), f AS (
            SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY ALL
        ), w AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s
        ), m AS (
            SELECT r, doc_id, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM d, s WHERE len(t) > 0
        ), g AS (
            SELECT q.i, q.item_id, m.r, m.doc_id, sum(q.c * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score
            FROM q JOIN w USING (t) JOIN f USING (t) JOIN m ON m.r = f.r
            GROUP BY ALL
        ), k AS (
            SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM g WHERE score > 0
        )
        SELECT * FROM k WHERE rank <= 10
    """,
    "op12_prefixtrie": r"""
        WITH t AS (
            SELECT conv_id, length(coalesce(text, ''))::BIGINT AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id, n, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM t
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM p)
        ), r AS (
            SELECT c.conv_id, 0 AS part, p.i, p.n, p.k FROM c JOIN p ON p.conv_id = c.base AND p.i <= c.h
            UNION ALL SELECT c.conv_id, 1, p.i, p.n, p.k FROM c JOIN p ON p.conv_id = c.conv_id AND p.i > c.h
        ), o AS (
            SELECT conv_id, n, k, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM r
        ), x AS (
            SELECT conv_id, d, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o
            UNION ALL SELECT conv_id, 0, 0, '' FROM c
        ), l AS (
            SELECT conv_id, max(d) AS len FROM x GROUP BY conv_id
        ), v AS (
            SELECT path, any_value(d) AS depth, any_value(n) AS n, min(x.conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) FILTER (x.d = l.len), '')) AS ends_sha256
            FROM x JOIN l USING (conv_id) GROUP BY path
        ), ch AS (
            SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1
        ), u AS (
            SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN ch USING (path)
        ), a AS (
            SELECT left(path, 32 * unnest(range(0, depth + 1))::BIGINT) AS path, (n_convs - 1) * n AS saved, (n_children = 0)::BIGINT AS leaf FROM u
        ), s AS (
            SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM a GROUP BY path
        )
        SELECT u.conv_id, u.depth, w.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
        FROM u JOIN s USING (path) LEFT JOIN u w ON u.depth > 0 AND w.path = left(u.path, length(u.path) - 32)
    """,
    "op13_urlfilter": verdicts_sql(),
}

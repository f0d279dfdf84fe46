"""One registered query per operator, on the given tables or on corpora derived from them, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..front.parse import Parsed, scan
from ..functions import naming as N
from ..operators import corpus as C
from ..operators import edges as E
from ..operators import imports as I
from ..operators import measurement as M
from ..operators import mentions as R
from ..operators import resolve as V
from ..operators import selection as S
from ..operators import typeenv as T
from ..operators.fingerprint import differing_rows, fingerprint
from ..operators.structure import compose_names, own_comments, structural_errors
from ..sources import corpora
from ..sources.scratch import Tables
from ..sources.tree import census, population
from ..streaming.incremental import Graph
from .extract import Extraction, extract
from .select import extract_selected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scalar functions


@query(r"""
    WITH p AS (SELECT page_id, '.\' || replace(coalesce(url, ''), 'http', './/ht\\tp') || '//' AS raw FROM pages),
    n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(translate(raw, '\', '/'), '/+', '/', 'g'), '^(\./)+', ''), '/+$', '') AS path FROM p)
    SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, 'o/r/' || path AS file_name, 'o/r/' || path || '::x' AS child, 'ix://o/r/' || path AS reference,
           sha256(concat('code_file', chr(31), 'o/r/' || path)) AS id, '<module#' || page_id || '>' AS anonymous FROM n
""")
def names_and_ids(spark, sf_dir):
    raw = F.concat(F.lit(".\\"), F.replace(F.coalesce("url", F.lit("")), F.lit("http"), F.lit(".//ht\\\\tp")), F.lit("//"))
    rows = table(spark, sf_dir, "pages").select("page_id", N.normalize_path(raw).alias("path"))
    name = N.file_name(F.lit("o"), F.lit("r"), F.col("path"))
    return rows.select("page_id", "path", N.parent_dir(F.col("path")).alias("parent"), name.alias("file_name"), N.child_name(name, F.lit("x")).alias("child"), N.ix_ref(name).alias("reference"), N.node_id(F.lit("code_file"), name).alias("id"), N.anonymous_segment(F.lit("module"), F.col("page_id")).alias("anonymous"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS identity, greatest(1, len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END)::INTEGER AS last_line FROM documents")
def content_identities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.content_identity(F.coalesce("text", F.lit(""))).alias("identity"), N.file_span_end(F.col("text")).cast("int").alias("last_line"))


ENDINGS = ["rs", "ts", "mts", "cts", "tsx", "py", "pyi", "js", "RS", "d.ts"]


@query(f"""
    WITH p AS (SELECT p_partkey, 'a.b/' || p_partkey || '.' || (CASE p_partkey % 10 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS))} END) AS path,
               (CASE p_partkey % 6 WHEN 0 THEN '__x' WHEN 1 THEN '_x' WHEN 2 THEN '__x__' WHEN 3 THEN 'x_' WHEN 4 THEN '_' ELSE 'X' END) AS name FROM part)
    SELECT p_partkey, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN regexp_matches(path, '\\.[mc]?ts$') THEN 'typescript' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN regexp_matches(path, '\\.pyi?$') THEN 'python' END AS language,
           CASE p_partkey % 10 WHEN 1 THEN 'typescript' WHEN 4 THEN 'tsx' WHEN 5 THEN 'python' END AS named,
           CASE WHEN name IN ('__x') THEN 'private' WHEN name IN ('_x', '_') THEN 'crate' ELSE 'public' END AS visibility FROM p
""")
def languages_and_visibility(spark, sf_dir):
    n = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (n % 10 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ["__x", "_x", "__x__", "x_", "_", "X"])), (n % 6 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), n.cast("string"), F.lit("."), ending)
    return table(spark, sf_dir, "part").select(n, N.language_of_path(path).alias("language"), N.language_of_name(ending).alias("named"), N.python_visibility(name).alias("visibility"))


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'crate' ELSE 'private' END AS rust,
           CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'public' WHEN 2 THEN 'crate' ELSE 'private' END AS script,
           CASE WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey WHEN p_partkey % 3 = 1 THEN 'm' END AS owner,
           p_partkey % 5 <> 0 AS plain, p_partkey % 3 = 0 AS upper FROM part
""")
def lexical_predicates(spark, sf_dir):
    n = F.col("p_partkey")
    rust = F.element_at(F.array(*map(F.lit, ["", "pub", "pub (", "unsafe"])), (n % 4 + 1).cast("int"))
    script = F.element_at(F.array(*map(F.lit, ["", "public", "protected", "private"])), (n % 4 + 1).cast("int"))
    number = n.cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("o/r/a::T"), number, F.lit("::f"))).when(n % 3 == 1, F.lit("o/r/a::m::f")).otherwise(F.lit("o/r/a::f"))
    word = F.concat(F.when(n % 3 == 0, F.lit("Ä")).otherwise(F.lit("é")), number, F.when(n % 5 == 0, F.lit("-")).otherwise(F.lit("_$")))
    no = F.lit(False)
    return table(spark, sf_dir, "part").select(
        n, N.modifier_visibility(F.lit("rust"), rust, no, no, F.lit("x")).alias("rust"), N.modifier_visibility(F.lit("typescript"), script, ~no, no, F.lit("x")).alias("script"),
        N.owning_type_segment(name).alias("owner"), N.is_plain_identifier(word).alias("plain"), N.starts_uppercase(word).alias("upper"),
    )


@query(r"""
    WITH w AS (SELECT lang, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents)
    SELECT coalesce(lang, '') AS lang, count(*) AS words, count_if(regexp_full_match(w, '[\p{L}\p{N}_$]+'))::BIGINT AS plain, count_if(regexp_matches(w, '^\p{Lu}'))::BIGINT AS upper,
           count_if(starts_with(w, '__') AND NOT suffix(w, '__'))::BIGINT AS private FROM w GROUP BY ALL
""")
def word_predicates(spark, sf_dir):
    """Every word of every text by what it may name."""
    words = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return words.groupBy("lang").agg(F.count("*").alias("words"), F.count_if(N.is_plain_identifier(F.col("w"))).alias("plain"), F.count_if(N.starts_uppercase(F.col("w"))).alias("upper"), F.count_if(N.python_visibility(F.col("w")) == "private").alias("private"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://[^/?#]*/([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '://([^./?#]*)', 1) AS label FROM pages),
    d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM p)
    SELECT page_id, dir, concat_ws('/', nullif(trim(dir, '/'), ''), nullif(label, '')) AS beside,
           CASE WHEN trim(dir, '/') = '' THEN NULL ELSE concat_ws('/', nullif(regexp_extract(trim(dir, '/'), '^(.*)/[^/]*$', 1), ''), nullif(label, '')) END AS above FROM d
""")
def url_joins(spark, sf_dir):
    """Paths of urls as importers of a module beside them, and of one in the folder above."""
    url = F.coalesce("url", F.lit(""))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"://[^/?#]*/([^?#]*)", 1).alias("path"), F.regexp_extract(url, r"://([^./?#]*)", 1).alias("label"))
    folder = N.parent_dir(F.col("path"))
    return rows.select("page_id", folder.alias("dir"), N.join_relative(folder, F.concat(F.lit("./"), "label")).alias("beside"), N.join_relative(folder, F.concat(F.lit("./../"), "label")).alias("above"))


# -- imports


@query("""
    SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'src/a/m' WHEN 1 THEN 'src/a/m/n' WHEN 2 THEN NULL WHEN 3 THEN 'src/m' WHEN 4 THEN 'src/a/y' WHEN 5 THEN 'src/x' WHEN 6 THEN NULL ELSE 'src/m' END AS stem FROM part
""")
def import_stems(spark, sf_dir):
    n = F.col("p_partkey")
    cases = [("crate::a::m::T", "rust"), ("self::m::n", "rust"), ("crate::T", "rust"), ("super::m::*", "rust"), ("./y", "ts"), ("../x", "ts"), ("../../../x", "ts"), ("..m", "python")]
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in cases)), (n % 8 + 1).cast("int"))
    importer = F.lit("src/a/f.x")
    stem = F.when(pick(1) == "rust", I.rust_stem(pick(0), importer)).when(pick(1) == "python", I.python_stem(pick(0), importer)).otherwise(N.join_relative(N.parent_dir(importer), pick(0)))
    return table(spark, sf_dir, "part").select(n, stem.alias("stem"))


IMPORT_PATHS = """
    paths AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'src/p' || p_partkey || '.rs' WHEN 1 THEN 'src/p' || p_partkey || '/mod.rs' WHEN 2 THEN 'ui/p' || p_partkey || '/index.ts' ELSE 'ui/p' || p_partkey || '.d.ts' END AS path FROM part)
"""


@query(f"""
    WITH {IMPORT_PATHS}
    SELECT l.l_orderkey * 10 + l.l_linenumber AS site, l.l_partkey + l.l_linenumber - 1 AS wanted, min(p.path) AS target_path, count(*)::BIGINT AS sites
    FROM lineitem l LEFT JOIN paths p ON p.k = l.l_partkey + l.l_linenumber - 1 AND (l.l_suppkey % 2 = 0) = (p.k % 4 < 2)
    GROUP BY ALL
""")
def import_resolution(spark, sf_dir):
    k = F.col("p_partkey")
    paths = table(spark, sf_dir, "part").select(
        F.when(k % 4 == 0, F.format_string("src/p%d.rs", k)).when(k % 4 == 1, F.format_string("src/p%d/mod.rs", k)).when(k % 4 == 2, F.format_string("ui/p%d/index.ts", k)).otherwise(F.format_string("ui/p%d.d.ts", k)).alias("path")
    )
    wanted, rust = F.col("l_partkey") + F.col("l_linenumber") - 1, F.col("l_suppkey") % 2 == 0
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), wanted.alias("wanted"), rust.alias("rust")).groupBy("site", "wanted", "rust").agg(F.count("*").alias("sites"))
    imports = items.select(
        F.struct("site", "wanted", "rust").alias("import_id"), "site", "wanted", "sites", F.when(F.col("rust"), F.format_string("crate::p%d::Part", "wanted")).otherwise(F.format_string("./p%d", "wanted")).alias("specifier"),
        F.when(F.col("rust"), F.lit("src/main.rs")).otherwise(F.lit("ui/main.ts")).alias("path"), F.when(F.col("rust"), F.lit("rust")).otherwise(F.lit("typescript")).alias("language"),
    )
    found = I.resolve_imports(imports, paths)
    return found.groupBy("site", "wanted").agg(F.min("target_path").alias("target_path"), F.sum("sites").alias("sites"))


# -- mentions


@query("""
    WITH o AS (SELECT o_orderkey AS k FROM orders)
    SELECT identifier, kind, source, count(*)::BIGINT AS n, min(line)::INTEGER AS first_line FROM (
        SELECT 'ix://o/r/FR-' || k % 97 AS identifier, 'artifact_reference' AS kind, 'f' || k % 11 AS source, k AS line FROM o
        UNION ALL SELECT 'TC-' || k % 13, CASE WHEN k % 2 = 0 THEN 'tracking_tag' ELSE 'requirement_citation' END, 'f' || k % 11, k FROM o
        UNION ALL SELECT 'FR-' || k % 7 || '-AC-1', 'requirement_citation', 'f' || k % 11, k FROM o
        UNION ALL SELECT 'StR-5', 'requirement_citation', 'f' || k % 11, k FROM o WHERE k % 3 = 0
    ) GROUP BY ALL
""")
def mention_harvest(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    m = lambda x: (F.col("o_orderkey") % x).cast("string")
    text = F.concat(F.lit("// See ix://o/r/FR-"), m(97), F.lit("). TC-"), m(13), F.lit(" and FR-"), m(7), F.lit("-AC-1, not FR-1x, AFR-2, FR-3_ or TC-1234567; "), F.when(F.col("o_orderkey") % 3 == 0, "StR-5.").otherwise("StR-x"))
    rows = table(spark, sf_dir, "orders").select(text.alias("text"), F.concat(F.lit("f"), m(11)).alias("owner"), (F.col("o_orderkey") % 2 == 0).alias("owner_is_test"), F.concat(F.lit("f"), k).alias("path"), F.col("o_orderkey").cast("int").alias("line"))
    return R.harvest(rows).groupBy("identifier", "kind", "source").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


# -- edges and aggregations

FOLD = """
    WITH s AS (
        SELECT 's' || {source} AS source_ref, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END AS edge_type, {target} AS target_ref,
               CASE l_linestatus WHEN 'O' THEN 'receiver-typed' ELSE 'name-match' END AS reason, CASE l_linestatus WHEN 'O' THEN 0.9 ELSE 0.5 END AS confidence,
               'f' || l_orderkey % 40 AS file, l_linenumber AS line FROM lineitem
    ), places AS (SELECT DISTINCT source_ref, edge_type, target_ref, file, line FROM s WHERE source_ref <> target_ref),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source_ref, edge_type, target_ref ORDER BY file, line) AS r FROM places),
    kept AS (SELECT source_ref, edge_type, target_ref, string_agg(file || ':' || line, ',' ORDER BY file, line) AS evidence FROM ranked WHERE r <= 20 GROUP BY ALL),
    totals AS (SELECT source_ref, edge_type, target_ref, count(*) AS count, max(confidence)::DOUBLE AS confidence, arg_max(reason, confidence) AS reason FROM s WHERE source_ref <> target_ref GROUP BY ALL)
    SELECT t.*, k.evidence FROM totals t JOIN kept k USING (source_ref, edge_type, target_ref)
"""


def shown(edges: DataFrame) -> DataFrame:
    return edges.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["file"], F.lit(":"), e["line"].cast("string"))), ","))


def sites(spark, sf_dir, source, target) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), source.cast("string")).alias("source_ref"), F.when(flag == "A", "calls").when(flag == "N", "imports").otherwise("references").alias("edge_type"), target.alias("target_ref"),
        F.when(F.col("l_linestatus") == "O", "receiver-typed").otherwise("name-match").alias("reason"), F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("file"), F.col("l_linenumber").alias("line"),
    )


@query(FOLD.format(source="l_suppkey", target="'p' || l_partkey"))
def edge_fold(spark, sf_dir):
    return shown(E.fold_edges(sites(spark, sf_dir, F.col("l_suppkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))))


@query(FOLD.format(source="l_suppkey % 5", target="'s' || l_partkey % 5"))
def edge_fold_hubs(spark, sf_dir):
    """Few keys with many sites each: evidence is cut at twenty, and self-edges go."""
    return shown(E.fold_edges(sites(spark, sf_dir, F.col("l_suppkey") % 5, F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")))))


@query("SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1")
def unique_or_nothing(spark, sf_dir):
    return C.unique_or_nothing(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey")


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_writer(spark, sf_dir):
    return C.first_writer(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_writer(spark, sf_dir):
    return C.last_writer(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem")
def value_sets(spark, sf_dir):
    return C.value_sets(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate")


@query("SELECT doc_id, row_number() OVER (ORDER BY lang, source, printf('d%09d', doc_id)) - 1 AS file_ord FROM documents")
def batch_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("org"), F.col("source").alias("repo"), F.format_string("d%09d", "doc_id").alias("path"))
    return C.batch_order(rows).select("doc_id", "file_ord")


@query("SELECT l_shipdate, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def latency_p95(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").alias("p95"))


@query("""
    SELECT 'c' || o_custkey AS source_ref, 'o' || o_orderkey AS target_ref, CASE WHEN o_orderkey % 5 = 0 THEN 'wrong' WHEN o_orderkey % 7 = 0 THEN 'missed' ELSE 'right' END AS verdict
    FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0 GROUP BY ALL
""")
def truth_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_ref"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target_ref"))
    return M.differences(rows.where("o_orderkey % 7 <> 0"), rows.where("o_orderkey % 5 <> 0"))


# -- measurement


def judged(spark, sf_dir) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = labels.join(docs, "doc_id")
    return rows.select(
        (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("emitted"), F.col("lang").alias("language"), F.col("source").alias("node_kind"),
        F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("relation_kind"), (F.col("doc_id") % 3).alias("resolver_tier"),
    )


CONFUSION = """
    j AS (SELECT l.quality = 1 AS truth, l.toxic = 0 AS emitted, d.lang AS language, d.source AS node_kind, CASE WHEN d.n_chars > 1000 THEN 'long' ELSE 'short' END AS relation_kind, (d.doc_id % 3)::VARCHAR AS resolver_tier
          FROM labels l JOIN documents d USING (doc_id)),
    k AS (SELECT 'total' AS dimension, 'all' AS key, truth, emitted FROM j UNION ALL SELECT 'language', language, truth, emitted FROM j UNION ALL SELECT 'node_kind', node_kind, truth, emitted FROM j
          UNION ALL SELECT 'relation_kind', relation_kind, truth, emitted FROM j UNION ALL SELECT 'resolver_tier', resolver_tier, truth, emitted FROM j),
    c AS (SELECT dimension, key, count_if(truth AND emitted)::BIGINT AS true_positive, count_if(NOT truth AND emitted)::BIGINT AS false_positive, count_if(truth AND NOT emitted)::BIGINT AS false_negative, NULL::BIGINT AS true_negative FROM k GROUP BY ALL)
"""


@query(f"WITH {CONFUSION} SELECT * FROM c")
def confusion(spark, sf_dir):
    return M.confusion(judged(spark, sf_dir))


@query(f"WITH {CONFUSION} SELECT dimension, key, true_positive / (true_positive + false_negative) AS recall, true_positive + false_negative AS known FROM c WHERE true_positive + false_negative > 0")
def recall_and_census(spark, sf_dir):
    counts = M.confusion(judged(spark, sf_dir))
    return M.recall(counts).join(M.truth_census(counts), ["dimension", "key"])


@query(f"WITH {CONFUSION} SELECT 'measured' AS state, false_positive, CASE WHEN false_positive = 0 THEN 'pass' ELSE 'fail' END AS decision FROM c WHERE dimension = 'total'")
def decision(spark, sf_dir):
    return M.decision(M.confusion(judged(spark, sf_dir)))


@query(f"""
    WITH {CONFUSION},
    r AS (SELECT '{{"observed_at":"t0","plan":"p","results":[' || string_agg(to_json({{'dimension': dimension, 'false_negative': false_negative, 'false_positive': false_positive, 'key': key, 'true_positive': true_positive}})::VARCHAR, ',' ORDER BY dimension, false_negative, false_positive, key, true_positive) || '],"state":"measured"}}' AS record FROM c)
    SELECT 'sha256:' || sha256(record) AS id, record, 'computed' AS status, NULL::VARCHAR AS problem FROM r
""")
def observation(spark, sf_dir):
    found = M.observation(M.confusion(judged(spark, sf_dir)), "measured", "p", "t0")
    return found.join(M.collection(found).select("id", "status"), "id").join(M.valid_observations(found), "id")


@query("""
    WITH f AS (SELECT lang, doc_id % 4 < 3 AS supported, doc_id % 50 > 0 OR lang <> 'fr' AS readable FROM documents ),
    g AS (SELECT lang, count(*)::BIGINT AS files, count_if(supported)::BIGINT AS supported, count_if(NOT readable)::BIGINT AS unreadable FROM f GROUP BY lang)
    SELECT lang, files, supported, unreadable, CASE WHEN unreadable > 0 THEN 'unreadable' WHEN supported < files THEN 'unsupported' ELSE 'measured' END AS state FROM g
""")
def population_states(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, [".rs", ".ts", ".py", ".c"])), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("lang", F.concat(F.col("doc_id").cast("string"), ending).alias("path"), ((F.col("doc_id") % 50 > 0) | (F.col("lang") != "fr")).alias("readable"))
    return census(files, ("lang",))


@query("""
    WITH f AS (SELECT source, CASE n_chars % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'variant' ELSE 'inputs' END AS folder, CASE n_chars % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.tsx' WHEN 2 THEN '.md' ELSE '.pyi' END AS ending, text IS NOT NULL AND lang <> 'fr' AS readable FROM documents),
    g AS (SELECT source, folder <> 'inputs' AS inside, folder <> 'inputs' AND ending IN ('.rs', '.tsx') AS supported, readable FROM f),
    h AS (SELECT source, count_if(inside)::BIGINT AS files, count_if(supported)::BIGINT AS supported, count_if(supported AND NOT coalesce(readable, false))::BIGINT AS unreadable, count_if(inside AND NOT supported)::BIGINT AS unsupported FROM g GROUP BY source)
    SELECT *, CASE WHEN files = 0 THEN 'empty' WHEN unreadable > 0 THEN 'unreadable' WHEN supported = 0 THEN 'unsupported' ELSE 'measured' END AS state FROM h
""")
def population_scan(spark, sf_dir):
    n = F.col("n_chars")
    folder = F.when(n % 3 == 0, "input").when(n % 3 == 1, "variant").otherwise("inputs")
    ending = F.when(n % 4 == 0, ".rs").when(n % 4 == 1, ".tsx").when(n % 4 == 2, ".md").otherwise(".pyi")
    path = F.concat(F.lit("fixtures/"), folder, F.lit("/d"), F.col("doc_id").cast("string"), ending)
    files = table(spark, sf_dir, "documents").select("source", path.alias("path"), (F.col("text").isNotNull() & (F.col("lang") != "fr")).alias("readable"))
    return population(files, ("source",))


@query("""
    WITH g AS (SELECT lang AS key, sum(n_chars)::BIGINT AS unresolved, count(*)::BIGINT AS ambiguous FROM documents WHERE lang IS NOT NULL GROUP BY lang),
    t AS (SELECT sum(unresolved)::BIGINT AS unresolved, sum(ambiguous)::BIGINT AS ambiguous FROM g)
    SELECT 'language' AS dimension, key, unresolved, ambiguous FROM g
    UNION ALL SELECT s.dimension, s.key, t.unresolved, t.ambiguous FROM t, (VALUES ('overall', 'overall'), ('node_kind', 'call_site'), ('relation_kind', 'calls'), ('resolver_tier', 'unresolved')) s(dimension, key)
""")
def open_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return M.open_counts(rows.select(F.concat_ws("/", "source", "lang").alias("name"), F.col("n_chars").alias("reported"), F.lit(1).alias("expected")))


@query("""
    WITH i AS (SELECT doc_id // 5 AS id, doc_id % 5 AS place, CASE WHEN n_chars % 7 = 0 THEN 'overall' ELSE ['language', 'node_kind', 'overall', 'relation_kind', 'resolver_tier'][doc_id % 5 + 1] END AS dimension,
               CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS key FROM documents),
    j AS (SELECT *, lag((coalesce(dimension, ''), coalesce(key, ''))) OVER (PARTITION BY id ORDER BY place) AS before, lag(place) OVER (PARTITION BY id ORDER BY place) AS prior FROM i),
    k AS (SELECT id, count_if(prior = place - 1 AND (coalesce(dimension, ''), coalesce(key, '')) <= before) AS fell, count(DISTINCT dimension) AS n,
                 count_if(dimension = 'language' AND NOT coalesce(key IN ('en', 'de', 'fr'), false)) AS strangers FROM j GROUP BY id)
    SELECT id, CASE WHEN fell > 0 THEN 'order' WHEN n < 5 THEN 'dimensions' WHEN strangers > 0 THEN 'language' END AS problem FROM k
""")
def result_problems(spark, sf_dir):
    n = F.col("doc_id")
    names = F.array(*map(F.lit, sorted(M.RESULT_DIMENSIONS)))
    dimension = F.when(F.col("n_chars") % 7 == 0, "overall").otherwise(F.element_at(names, (n % 5 + 1).cast("int")))
    items = table(spark, sf_dir, "documents").select(F.floor(n / 5).alias("id"), (n % 5).alias("place"), dimension.alias("dimension"), F.when(n % 5 == 0, F.col("lang")).otherwise(F.col("source")).alias("key"))
    return M.result_problems(items, languages=("en", "de", "fr"))


@query("""
    SELECT doc_id AS plan_id, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'lang: en' WHEN n_chars % 2 = 1 THEN '  direction: zero' END AS first_missing FROM documents
""")
def plan_lines(spark, sf_dir):
    text = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nobjective:\n  direction: zero"), F.when(F.col("n_chars") % 2 == 1, "es").otherwise(""), F.lit("\n---\nlang: en\n"), F.coalesce("text", F.lit("")))
    return M.plan_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("plan_id"), text.alias("text")), ["lang: en", "objective:", "  direction: zero"])


@query("""
    WITH r AS (SELECT turn AS run, string_agg(DISTINCT role, ',' ORDER BY role) AS report FROM conversations GROUP BY turn), f AS (SELECT arg_min(report, run) AS expected FROM r)
    SELECT count_if(report <> expected) = 0 AS agreed, min(CASE WHEN report <> expected THEN run END) AS first_other FROM r, f
""")
def repetitions(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").groupBy(F.col("turn").alias("run")).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("report"))
    return M.reconcile(runs)


ORDER_DIGESTS = "SELECT *, md5(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderstatus, chr(30)))) AS d FROM orders"


@query(f"""
    SELECT o_orderpriority, count(*) AS n, sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR AS low, sum(('0x' || substr(d, 17, 15))::BIGINT)::VARCHAR AS high FROM ({ORDER_DIGESTS}) GROUP BY o_orderpriority
""")
def relation_fingerprints(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderpriority"])


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem),
    b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 89 > 0)
    SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def relation_differences(spark, sf_dir):
    """Two runs that differ in a few rows: found by bisection of their digests."""
    key = F.col("l_orderkey")
    left = table(spark, sf_dir, "lineitem").select(key, "l_linenumber", "l_returnflag")
    right = left.where(key % 89 > 0).withColumn("l_returnflag", F.when(key % 97 == 0, "X").otherwise(F.col("l_returnflag")))
    return differing_rows(left, right)


@query("""
    SELECT item_id AS plan_id, unnest(['src/' || item_id || '.rs', '/abs', 'a/../b', 'x*.rs']) AS file, unnest([true, false, false, false]) AS plain FROM benchmark
""")
def plan_files(spark, sf_dir):
    text = F.concat(F.lit("---\nid: p\nfiles:\n  - src/"), F.col("item_id").cast("string"), F.lit(".rs\n  - /abs\n  - a/../b\n  - x*.rs\n---\n"), F.col("text"))
    return M.plan_files(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("plan_id"), text.alias("text")))


# -- selection

SELECTED = """
    d AS (SELECT doc_id, coalesce(lang, '') AS org, coalesce(source, '') AS repo, 'd' || doc_id AS path, coalesce(text, '') AS content FROM documents),
    a AS (SELECT org, repo, path, CASE WHEN doc_id % 3 = 0 THEN 'extra' WHEN doc_id % 7 = 0 THEN 'not_supplied' WHEN doc_id % 5 = 0 THEN 'identity_mismatch' WHEN doc_id % 11 = 0 THEN 'unparsable' ELSE 'accepted' END AS status FROM d WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 = 0))
"""


def selected(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    blank = F.lit("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", blank).alias("org"), F.coalesce("source", blank).alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", blank).alias("content"))
    modules = docs.where("doc_id % 3 <> 0").withColumn("identity", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(N.content_identity(F.col("content"))))
    return modules.drop("content"), docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 = 0")


@query(f"WITH {SELECTED} SELECT * FROM a")
def selection_status(spark, sf_dir):
    return S.account(*selected(spark, sf_dir))


@query(f"WITH {SELECTED} SELECT CASE WHEN missing > 0 THEN 'partial' ELSE 'full' END AS scope, modules, missing FROM (SELECT count_if(status <> 'extra')::BIGINT AS modules, count_if(status NOT IN ('accepted', 'extra'))::BIGINT AS missing FROM a)")
def selection_scope(spark, sf_dir):
    modules, files, broken = selected(spark, sf_dir)
    return S.scope(modules, S.account(modules, files, broken))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY sha256(coalesce(source, '')), doc_id)::INTEGER AS place FROM documents WHERE text IS NOT NULL")
def candidate_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    hashed = rows.select("doc_id", F.sha2("text", 256).alias("digest"), N.content_identity(F.coalesce("source", F.lit(""))).alias("supplied"))
    return C.place_in_group(hashed, ["digest"], ["supplied", "doc_id"]).select("doc_id", "place")


# -- type environment


@query("""
    WITH RECURSIVE b AS (SELECT p_partkey AS k, p_partkey // 6 AS f, p_partkey % 6 AS i FROM part),
    s AS (SELECT f, i, k, i = 0 AS direct FROM b),
    r AS (SELECT f, i, k, 'T' || f AS type FROM s WHERE direct UNION ALL SELECT s.f, s.i, s.k, r.type FROM r JOIN s ON s.f = r.f AND s.i = r.i + 1)
    SELECT f AS file_ord, 'v' || i AS name, type FROM r
""")
def type_fixpoint(spark, sf_dir):
    """Chains of copies, written in reverse order: v5 = v4, ..., v1 = v0, v0 of an annotated type."""
    n = F.col("p_partkey")
    f, i = F.floor(n / 6), n % 6
    text = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    bindings = table(spark, sf_dir, "part").select(
        f.alias("file_ord"), F.lit("").alias("scope"), text("v", i.cast("string")).alias("name"), F.when(i == 0, "annotation").otherwise("copy").alias("kind"),
        F.when(i == 0, text("T", f.cast("string"))).otherwise(text("v", (i - 1).cast("string"))).alias("x"), F.lit(None).cast("string").alias("y"), (-i).cast("int").alias("ord"),
    )
    none = lambda ddl: spark.createDataFrame([], ddl)
    env = T.type_environment(bindings, none("file_ord long, scope string, owner string, ord int"), none("simple string, target string"), none("owner string, method string, target string"), none("file_ord long, ord int, target string, type string"), none("file_ord long, ord int, owner string, field string, type string"))
    return env.where("name IS NOT NULL").select("file_ord", "name", "type")


@query("""
    WITH p AS (SELECT p_partkey AS k, p_partkey + 1 IN (SELECT p_partkey FROM part) AND (p_partkey + 1) % 5 <> 0 AS makes FROM part),
    r AS (SELECT k, makes, CASE WHEN NOT makes THEN 2 WHEN k % 7 = 0 THEN 4 ELSE 3 END AS rounds FROM p)
    SELECT k AS file_ord, '' AS scope, 'a' AS name, 'T' || k AS type, rounds FROM r
    UNION ALL SELECT k, '', 'b', 'T' || (k + 1), rounds FROM r
    UNION ALL SELECT k, 'm@1', 'h', 'T' || (k + 1), rounds FROM r
    UNION ALL SELECT k, '', 'c', 'U' || (k + 1), rounds FROM r WHERE makes
    UNION ALL SELECT k, '', 'd', 'U' || (k + 1), rounds FROM r WHERE makes
    UNION ALL SELECT k, '', 'e', 'V' || k, rounds FROM r WHERE k % 7 <> 0
""")
def type_members(spark, sf_dir):
    """Per file: a is annotated, b is a field of a, c what a method of b returns, d a copy of c, e what a function returns, h a field of self; b to e stand in reverse order. Every fifth type has two methods of the name, every seventh function no return type, and each field an older type."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k, k.alias("file_ord"))
    rows = [("a", "", "annotation", numbered("T", k), None, 9), ("b", "", "field", F.lit("a"), "next", 3), ("c", "", "method", F.lit("b"), "make", 2), ("d", "", "copy", F.lit("c"), None, 1), ("e", "", "call", numbered("g", k), None, 0), ("h", "m@1", "field", F.lit("self"), "next", 4)]
    rows = [F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), x.cast("string").alias("x"), F.lit(y).cast("string").alias("y"), F.lit(i).alias("ord")) for name, scope, kind, x, y, i in rows]
    bindings = part.select("file_ord", F.explode(F.array(*rows)).alias("b")).select("file_ord", "b.*")
    enclosing = part.select("file_ord", F.lit("m@1").alias("scope"), numbered("T", k).alias("owner"), F.lit(0).alias("ord"))
    functions = part.select(numbered("g", k).alias("simple"), numbered("f", k, "::g", k).alias("target"))
    method = lambda file: F.concat(file, numbered("::T", k, "::make"))
    methods = part.select(numbered("T", k).alias("owner"), F.lit("make").alias("method"), method(numbered("f", k)).alias("target"))
    methods = methods.union(part.where(k % 5 == 0).select(numbered("T", k), F.lit("make"), method(numbered("other", k))))
    returns = part.select("file_ord", F.lit(0).alias("ord"), method(numbered("f", k)).alias("target"), numbered("U", k).alias("type"))
    returns = returns.union(part.where(k % 7 != 0).select("file_ord", F.lit(1), numbered("f", k, "::g", k), numbered("V", k)))
    field = part.select("file_ord", F.lit(0).alias("ord"), numbered("T", k).alias("owner"), F.lit("next").alias("field"), F.lit("Old").alias("type"))
    fields = field.union(part.select("file_ord", F.lit(1), numbered("T", k), F.lit("next"), numbered("T", k + 1)))
    # the field of the next file's type is declared there, so a file asks for what it does not hold
    fields = fields.union(part.select((k - 1).alias("file_ord"), F.lit(7), numbered("T", k), F.lit("next"), F.lit("Older")))
    return T.type_environment(bindings, enclosing, functions, methods, returns, fields).where("name IS NOT NULL").select("file_ord", "scope", "name", "type", "rounds")


# -- structure


@query("""
    WITH RECURSIVE d AS (
        SELECT p_partkey // 40 AS file_ord, (p_partkey % 40)::INTEGER AS ord, p_size, 'f' || p_partkey // 40 AS file_ref,
               CASE WHEN p_partkey % 40 > 0 THEN (p_partkey % 40 - 1) // 2 END AS up, CASE p_partkey % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind,
               CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_size % 5 = 0 THEN 'same' ELSE 'n' || p_partkey END END AS name FROM part
    ), g AS (
        SELECT d.*, d.up IS NULL OR EXISTS (SELECT 1 FROM d e WHERE e.file_ord = d.file_ord AND e.ord = d.up) AS held FROM d
    ), w AS (
        SELECT file_ord, ord, file_ref || '::' || coalesce(name, '<' || kind || '#' || (row_number() OVER (PARTITION BY file_ord, kind, name IS NULL ORDER BY ord) - 1) || '>') AS qualified_name FROM g WHERE up IS NULL
        UNION ALL
        SELECT g.file_ord, g.ord, w.qualified_name || '::' || coalesce(g.name, '<' || g.kind || '#' || (row_number() OVER (PARTITION BY g.file_ord, w.qualified_name, g.kind, g.name IS NULL ORDER BY g.ord) - 1) || '>')
        FROM w JOIN g ON g.file_ord = w.file_ord AND g.up = w.ord
    )
    SELECT file_ord, ord, qualified_name FROM w
""")
def composed_names(spark, sf_dir):
    """Declarations nested as a binary tree of forty to a file: a quarter without a name, and of the others a fifth of one name."""
    k, i = F.col("p_partkey"), F.col("p_partkey") % 40
    declared = table(spark, sf_dir, "part").select(
        F.floor(k / 40).alias("file_ord"), i.cast("int").alias("ord"), F.when(i > 0, F.floor((i - 1) / 2)).cast("int").alias("up"), numbered("f", F.floor(k / 40)).alias("file_ref"), F.when(k % 3 == 0, "class").otherwise("function").alias("kind"),
        F.when(F.col("p_size") % 4 > 0, F.when(F.col("p_size") % 5 == 0, "same").otherwise(numbered("n", k))).alias("name"), F.lit(True).alias("named"),
    )
    # a declaration of the first file whose holder is missing (part keys begin at 1) has no name to stand below
    found = compose_names(declared)
    there = declared.select("file_ord", F.col("ord").alias("top")).where("top = 0").select("file_ord")
    return found.join(there, "file_ord", "left_semi").select("file_ord", "ord", "qualified_name")


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey AS file_ord, (l_suppkey % 2)::INTEGER AS frame, l_linenumber * 10000000 + l_partkey AS ord, CASE l_partkey % 8 WHEN 0 THEN 'declaration' WHEN 1 THEN 'declaration' WHEN 2 THEN 'other' WHEN 3 THEN 'import' WHEN 4 THEN 'inner' ELSE 'comment' END AS sort,
                      CASE WHEN l_partkey % 8 < 2 THEN 'd' || l_partkey ELSE 'f' || l_orderkey END AS name FROM lineitem),
    n AS (SELECT *, (SELECT min(b.ord) FROM e b WHERE b.file_ord = e.file_ord AND b.frame = e.frame AND b.ord > e.ord AND b.sort IN ('declaration', 'other')) AS stop FROM e WHERE sort IN ('comment', 'inner'))
    SELECT n.file_ord, n.frame, n.ord, CASE WHEN n.sort = 'comment' AND b.sort = 'declaration' THEN b.name ELSE n.name END AS owner FROM n LEFT JOIN e b ON b.file_ord = n.file_ord AND b.frame = n.frame AND b.ord = n.stop
""")
def comment_owners(spark, sf_dir):
    """Lines of orders as places of files in two frames: runs of comments broken by statements, imports and declarations."""
    mode = F.col("l_partkey") % 8
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_ord"), (F.col("l_suppkey") % 2).cast("int").alias("frame"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord"),
        F.when(mode < 2, "declaration").when(mode == 2, "other").when(mode == 3, "import").when(mode == 4, "inner").otherwise("comment").alias("sort"),
        F.when(mode < 2, numbered("d", F.col("l_partkey"))).otherwise(numbered("f", F.col("l_orderkey"))).alias("name"),
    )
    return own_comments(events.distinct())


@query("""
    WITH s AS (SELECT o_custkey AS file_ord, 0 AS start, 20000 AS stop, NULL AS body FROM orders UNION SELECT o_custkey, o_orderkey % 97 * 100, o_orderkey % 97 * 100 + 90, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 97 * 100 + 30 END FROM orders
               UNION SELECT o_custkey, o_orderkey % 97 * 100 + 50, o_orderkey % 97 * 100 + 70, o_orderkey % 97 * 100 + 60 FROM orders WHERE o_orderkey % 2 = 0),
    e AS (SELECT DISTINCT o_custkey AS file_ord, o_orderkey % 97 * 100 + o_orderkey % 89 AS place FROM orders WHERE o_orderkey % 4 > 0),
    c AS (SELECT e.*, (SELECT max((s.start, -s.stop, coalesce(s.body, -1))) FROM s WHERE s.file_ord = e.file_ord AND s.start <= e.place AND e.place < s.stop) AS d FROM e)
    SELECT file_ord, count(*) AS errors, min(CASE WHEN d IS NULL OR d[3] < 0 OR d[3] > place THEN place END)::BIGINT AS "at" FROM c GROUP BY file_ord
""")
def structure_probe(spark, sf_dir):
    """Orders of a customer as declarations of a file: one around all, those within it with and without executable bodies, and further ones within these."""
    key, base = F.col("o_orderkey"), F.col("o_orderkey") % 97 * 100
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_ord"), key)
    none = F.lit(None).cast("bigint")
    spans = orders.select("file_ord", F.lit(0).cast("bigint").alias("start"), F.lit(20000).cast("bigint").alias("stop"), none.alias("body"))
    spans = spans.union(orders.select("file_ord", base, base + 90, F.when(key % 3 > 0, base + 30))).union(orders.where(key % 2 == 0).select("file_ord", base + 50, base + 70, base + 60)).distinct()
    return structural_errors(spans, orders.where(key % 4 > 0).select("file_ord", (base + key % 89).alias("at")), bin_size=1000)


# -- call tiers


def numbered(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""
    WITH p AS (SELECT p_partkey AS k, p_partkey + 1 IN (SELECT p_partkey FROM part) AS one, p_partkey + 2 IN (SELECT p_partkey FROM part) AS two FROM part)
    SELECT k AS call_id, CASE k % 6 WHEN 0 THEN 'f' || k || '::T' || k || '::m' || k WHEN 1 THEN 'f' || k || '::T' || k || '::same' WHEN 2 THEN CASE WHEN NOT one THEN 'f' || k || '::T' || k || '::same' END
           WHEN 3 THEN CASE WHEN one THEN 'f' || (k + 1) || '::T' || (k + 1) || '::m' || (k + 1) END WHEN 4 THEN CASE WHEN two THEN 'f' || (k + 2) || '::T' || (k + 2) || '::m' || (k + 2) END
           ELSE CASE WHEN one THEN 'f' || (k + 1) || '::g' || (k + 1) END END AS target,
           CASE WHEN k % 6 < 2 THEN 'receiver-typed' WHEN k % 6 = 2 AND NOT one THEN 'import-scoped' WHEN k % 6 = 3 AND one THEN 'import-scoped' ELSE 'name-match' END AS reason
    FROM p
""")
def call_tiers(spark, sf_dir):
    """A typed receiver, a type-cased one, two reachable types with the method, one, a unique name, a free function."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k, k.alias("file_ord"), numbered("f", k).alias("path"), F.lit(0).alias("ord"))
    types = part.select("file_ord", "path", "ord", numbered("T", k).alias("simple"), numbered("f", k, "::T", k).alias("target"))
    own = part.select("file_ord", "ord", numbered("T", k).alias("owner"), numbered("m", k).alias("method"), numbered("f", k, "::T", k, "::m", k).alias("target"))
    methods = own.union(part.select("file_ord", "ord", numbered("T", k).alias("owner"), F.lit("same").alias("method"), numbered("f", k, "::T", k, "::same").alias("target")))
    functions = part.select("file_ord", "ord", numbered("g", k).alias("simple"), numbered("f", k, "::g", k).alias("target"))
    case = k % 6
    callee = F.when(case == 0, numbered("m", k)).when(case < 3, "same").when(case == 3, numbered("m", k + 1)).when(case == 4, numbered("m", k + 2)).otherwise(numbered("g", k + 1))
    receiver = F.when(case == 0, "x").when(case == 1, numbered("T", k)).when(case < 5, "y")
    calls = part.select(k.alias("call_id"), "file_ord", F.lit("").alias("scope"), receiver.alias("receiver"), callee.alias("callee"))
    env = part.where(case == 0).select("file_ord", F.lit("").alias("scope"), F.lit("x").alias("name"), numbered("T", k).alias("type"))
    enclosing = part.limit(0).select("file_ord", F.lit("").alias("scope"), F.lit("").alias("owner"), "ord")
    imported = part.where(case.isin(2, 3)).select("path", numbered("f", k + 1).alias("target_path"))
    reachable = V.reachable_types(types, imported.join(part.select(F.col("path").alias("target_path")), "target_path", "left_semi"), part)
    found = V.resolve_calls(calls, env, enclosing, reachable, methods, functions)
    return found.select("call_id", "target", "reason")


@query("""
    WITH p AS (SELECT p_partkey AS k, p_partkey + 1 IN (SELECT p_partkey FROM part) AS one FROM part)
    SELECT k AS file_ord, 'f' || k || '::T' || k AS source_ref, 'f' || (k + 1) || '::T' || (k + 1) AS target_ref, CASE WHEN k % 2 = 0 THEN 'implements_trait' ELSE 'extends' END AS edge_type FROM p WHERE one
    UNION ALL SELECT k, 'f' || k || '::T' || k, 'f' || k || '::Same', 'extends' FROM p
""")
def type_relations(spark, sf_dir):
    """A parent that is unique in the batch, and one of a name that every file declares: the file's own wins."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k, k.alias("file_ord"), numbered("f", k).alias("path"))
    types = part.select("file_ord", F.lit(0).alias("ord"), numbered("T", k).alias("simple"), numbered("f", k, "::T", k).alias("target"))
    types = types.union(part.select("file_ord", F.lit(1).alias("ord"), F.lit("Same").alias("simple"), numbered("f", k, "::Same").alias("target")))
    relations = part.select("file_ord", "path", numbered("T", k).alias("child"), numbered("T", k + 1).alias("parent"), (k % 2 == 0).alias("is_trait"))
    relations = relations.union(part.select("file_ord", "path", numbered("T", k).alias("child"), F.lit("Same").alias("parent"), F.lit(False).alias("is_trait")))
    return V.resolve_relations(relations, types).drop("path")


# -- whole batches


def rust(spark, sf_dir) -> Extraction:
    return extract(corpora.rust_corpus(table(spark, sf_dir, "part")))


RUST = "p AS (SELECT p_partkey AS n, 'shop/parts/src/shelf' || p_partkey // 100 || '/item' || p_partkey || '.rs' AS f, 'shop/parts/src/shelf' || (p_partkey + 1) // 100 || '/item' || (p_partkey + 1) || '.rs' AS g, p_partkey + 1 IN (SELECT p_partkey FROM part) AS has_next FROM part), h AS (SELECT p.*, unnest([0, 1, 2, 3]) AS k FROM p)"


@query(f"""
    WITH {RUST}, x AS (
        SELECT 'code_file' AS object_type, f AS name, 'file' AS kind, 1 AS first_line, 56 AS last_line, NULL AS parent, 'public' AS visibility, NULL AS signature FROM p
        UNION ALL SELECT 'code_type', f || '::Grade' || n, 'enum', 4, 7, f, 'public', NULL FROM p
        UNION ALL SELECT 'code_type', f || '::Priced' || n, 'trait', 9, 11, f, 'public', NULL FROM p
        UNION ALL SELECT 'code_type', f || '::Item' || n, 'struct', 13, 16, f, 'public', NULL FROM p
        UNION ALL SELECT 'code_function', f || '::Priced' || n || '::price_' || n, 'function', 10, 10, f || '::Priced' || n, 'public', '(self) -> u64' FROM p
        UNION ALL SELECT 'code_function', f || '::Item' || n || '::price_' || n, 'function', 20, 25, f || '::Item' || n, 'public', '(self) -> u64' FROM p
        UNION ALL SELECT 'code_function', f || '::Item' || n || '::total_' || n, 'function', 29, 31, f || '::Item' || n, 'public', '(self, u64) -> u64' FROM p
        UNION ALL SELECT 'code_function', f || '::Item' || n || '::step_' || n || '_' || k, 'function', 34 + 5 * k, 36 + 5 * k, f || '::Item' || n, 'private', '(self, u64) -> u64' FROM h
        UNION ALL SELECT 'code_function', f || '::order_' || n, 'function', 54, 56, f, 'public', '(&Item' || n || ') -> u64' FROM p)
    SELECT object_type, name, kind, first_line, last_line, parent, visibility, signature, sha256(concat(object_type, chr(31), name)) AS id FROM x
""")
def rust_nodes(spark, sf_dir):
    return rust(spark, sf_dir).nodes.select("object_type", "name", "data.kind", F.col("data.span.start").alias("first_line"), F.col("data.span.end").alias("last_line"), "data.parent", "data.visibility", "data.signature", "id")


@query(f"""
    WITH {RUST}, x AS (
        SELECT f AS source_ref, 'imports' AS edge_type, g AS target_ref, 1.0::DOUBLE AS confidence, 'path-resolved' AS reason, 2 AS line FROM p WHERE has_next
        UNION ALL SELECT f || '::Item' || n || '::total_' || n, 'calls', f || '::Item' || n || '::price_' || n, 0.9, 'receiver-typed', 30 FROM p
        UNION ALL SELECT f || '::Item' || n || '::step_' || n || '_' || k, 'calls', f || '::Item' || n || '::total_' || n, 0.9, 'receiver-typed', 35 + 5 * k FROM h
        UNION ALL SELECT f || '::order_' || n, 'calls', f || '::Item' || n || '::total_' || n, 0.9, 'receiver-typed', 55 FROM p
        UNION ALL SELECT f || '::order_' || n, 'calls', f || '::Item' || n || '::step_' || n || '_0', 0.9, 'receiver-typed', 55 FROM p
        UNION ALL SELECT f || '::Item' || n, 'implements_trait', f || '::Priced' || n, 1.0, 'syntactic', 1 FROM p
        UNION ALL SELECT f, 'references', 'ix://shop/parts/NFR-002', 1.0, 'explicit-mention', 1 FROM p
        UNION ALL SELECT f || '::Item' || n || '::price_' || n, 'references', 'StR-' || n % 7 + 1, 1.0, 'explicit-mention', 19 FROM p
        UNION ALL SELECT f || '::Item' || n || '::step_' || n || '_' || k, 'references', 'FR-014', 1.0, 'explicit-mention', 33 + 5 * k FROM h
        UNION ALL SELECT f, 'contains', f || '::Grade' || n, 1.0, 'syntactic', 4 FROM p
        UNION ALL SELECT f, 'contains', f || '::Priced' || n, 1.0, 'syntactic', 9 FROM p
        UNION ALL SELECT f || '::Priced' || n, 'contains', f || '::Priced' || n || '::price_' || n, 1.0, 'syntactic', 10 FROM p
        UNION ALL SELECT f, 'contains', f || '::Item' || n, 1.0, 'syntactic', 13 FROM p
        UNION ALL SELECT f || '::Item' || n, 'contains', f || '::Item' || n || '::price_' || n, 1.0, 'syntactic', 20 FROM p
        UNION ALL SELECT f || '::Item' || n, 'contains', f || '::Item' || n || '::total_' || n, 1.0, 'syntactic', 29 FROM p
        UNION ALL SELECT f || '::Item' || n, 'contains', f || '::Item' || n || '::step_' || n || '_' || k, 1.0, 'syntactic', 34 + 5 * k FROM h
        UNION ALL SELECT f, 'contains', f || '::order_' || n, 1.0, 'syntactic', 54 FROM p)
    SELECT source_ref, edge_type, target_ref, confidence, reason, 1::BIGINT AS count, split_part(source_ref, '::', 1)[12:] || ':' || line AS evidence FROM x
""")
def rust_edges(spark, sf_dir):
    return shown(rust(spark, sf_dir).edges)


@query(f"""
    WITH {RUST}
    SELECT 'ix://shop/parts/NFR-002' AS identifier, 'artifact_reference' AS kind, f AS source, f[12:] AS file, 1 AS line FROM p
    UNION ALL SELECT 'StR-' || n % 7 + 1, 'requirement_citation', f || '::Item' || n || '::price_' || n, f[12:], 19 FROM p
    UNION ALL SELECT 'FR-014', 'requirement_citation', f || '::Item' || n || '::step_' || n || '_' || k, f[12:], (33 + 5 * k)::INTEGER FROM h
""")
def rust_mentions(spark, sf_dir):
    return rust(spark, sf_dir).mentions


@query(f"WITH {RUST} SELECT count(*)::INTEGER AS files, 0 AS files_with_errors, 0 AS unresolved_calls, 1 AS max_fixpoint_iterations, 0 AS files_hitting_iteration_bound FROM p")
def rust_stats(spark, sf_dir):
    return rust(spark, sf_dir).stats


@query(f"WITH {RUST} SELECT 'unresolved_import' AS code, f[12:] AS path, 2 AS line, 'warning' AS severity FROM p WHERE NOT has_next")
def rust_diagnostics(spark, sf_dir):
    return rust(spark, sf_dir).diagnostics.select("code", "path", "line", "severity")


@query("""
    WITH p AS (SELECT s_suppkey AS n, 'shop/supply/tool/s' || s_suppkey || '.py' AS f, 'tool/s' || s_suppkey || '.py' AS e FROM supplier)
    SELECT f AS source_ref, 'contains' AS edge_type, f || '::Supplier' || n AS target_ref, 'syntactic' AS reason, 1::BIGINT AS count, e || ':5' AS evidence FROM p
    UNION ALL SELECT f, 'contains', f || '::main_' || n, 'syntactic', 1, e || ':14' FROM p
    UNION ALL SELECT f || '::Supplier' || n, 'contains', f || '::Supplier' || n || '::ship', 'syntactic', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::Supplier' || n, 'contains', f || '::Supplier' || n || '::pack_' || n, 'syntactic', 1, e || ':10' FROM p
    UNION ALL SELECT f || '::Supplier' || n || '::ship', 'calls', f || '::Supplier' || n || '::pack_' || n, 'receiver-typed', 1, e || ':8' FROM p
    UNION ALL SELECT f || '::main_' || n, 'calls', f || '::Supplier' || n || '::ship', 'receiver-typed', 1, e || ':16' FROM p
    UNION ALL SELECT f || '::Supplier' || n || '::ship', 'references', 'StR-' || n, 'explicit-mention', 1, e || ':6' FROM p
""")
def python_edges(spark, sf_dir):
    return shown(extract(corpora.python_corpus(table(spark, sf_dir, "supplier"))).edges).drop("confidence")


@query("""
    WITH p AS (SELECT s_suppkey AS n, 'shop/supply/tool/s' || s_suppkey || '.py' AS f, 'tool/s' || s_suppkey || '.py' AS e, CASE WHEN s_suppkey % 3 = 0 THEN 'box_' ELSE 'pack_' END || s_suppkey AS pack FROM supplier WHERE s_suppkey % 7 > 0)
    SELECT f AS source_ref, 'contains' AS edge_type, f || '::Supplier' || n AS target_ref, 'syntactic' AS reason, 1::BIGINT AS count, e || ':5' AS evidence FROM p
    UNION ALL SELECT f, 'contains', f || '::main_' || n, 'syntactic', 1, e || ':14' FROM p
    UNION ALL SELECT f || '::Supplier' || n, 'contains', f || '::Supplier' || n || '::ship', 'syntactic', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::Supplier' || n, 'contains', f || '::Supplier' || n || '::' || pack, 'syntactic', 1, e || ':10' FROM p
    UNION ALL SELECT f || '::Supplier' || n || '::ship', 'calls', f || '::Supplier' || n || '::' || pack, 'receiver-typed', 1, e || ':8' FROM p
    UNION ALL SELECT f || '::main_' || n, 'calls', f || '::Supplier' || n || '::ship', 'receiver-typed', 1, e || ':16' FROM p
    UNION ALL SELECT f || '::Supplier' || n || '::ship', 'references', 'StR-' || n, 'explicit-mention', 1, e || ':6' FROM p
""")
def incremental_edges(spark, sf_dir):
    """A graph of two batches: all files, then every third with other names, and every seventh no more."""
    files = corpora.python_corpus(table(spark, sf_dir, "supplier"))
    n = F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long")
    graph = Graph(spark, Tables(spark, "graph").root)
    graph.apply(0, files)
    graph.apply(1, files.where((n % 3 == 0) & (n % 7 > 0)).withColumn("content", F.replace("content", F.lit("pack_"), F.lit("box_"))), files.where(n % 7 == 0).select("org", "repo", "path"))
    return shown(graph.edges()).drop("confidence")


@query("""
    WITH p AS (SELECT c_custkey AS n, 'shop/web/ui/c' || c_custkey || '.ts' AS f, 'ui/c' || c_custkey || '.ts' AS e, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS has_next FROM customer)
    SELECT f AS source_ref, 'contains' AS edge_type, f || '::Customer' || n AS target_ref, 'syntactic' AS reason, 1::BIGINT AS count, e || ':4' AS evidence FROM p
    UNION ALL SELECT f, 'contains', f || '::open' || n, 'syntactic', 1, e || ':10' FROM p
    UNION ALL SELECT f || '::Customer' || n, 'contains', f || '::Customer' || n || '::name' || n, 'syntactic', 1, e || ':6' FROM p
    UNION ALL SELECT f || '::Customer' || n, 'contains', f || '::Customer' || n || '::show' || n, 'syntactic', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::Customer' || n || '::show' || n, 'calls', f || '::Customer' || n || '::name' || n, 'receiver-typed', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::open' || n, 'calls', f || '::Customer' || n || '::show' || n, 'receiver-typed', 1, e || ':12' FROM p
    UNION ALL SELECT f || '::open' || n, 'calls', f || '::Customer' || n || '::name' || n, 'receiver-typed', 1, e || ':12' FROM p
    UNION ALL SELECT f || '::Customer' || n, 'references', 'ix://shop/web/NFR-007', 'explicit-mention', 1, e || ':3' FROM p
    UNION ALL SELECT f, 'imports', 'shop/web/ui/c' || n + 1 || '.ts', 'path-resolved', 1, e || ':1' FROM p WHERE has_next
""")
def typescript_edges(spark, sf_dir):
    return shown(extract(corpora.typescript_corpus(table(spark, sf_dir, "customer"))).edges).drop("confidence")


@query("""
    WITH p AS (SELECT c_custkey AS n, 'shop/view/ui/v' || c_custkey || '.tsx' AS f, 'ui/v' || c_custkey || '.tsx' AS e, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS has_next FROM customer)
    SELECT f AS source_ref, 'contains' AS edge_type, f || '::View' || n AS target_ref, 'syntactic' AS reason, 1::BIGINT AS count, e || ':5' AS evidence FROM p
    UNION ALL SELECT f, 'contains', f || '::Row' || n, 'syntactic', 1, e || ':10' FROM p
    UNION ALL SELECT f || '::View' || n, 'contains', f || '::View' || n || '::label' || n, 'syntactic', 1, e || ':6' FROM p
    UNION ALL SELECT f || '::View' || n, 'contains', f || '::View' || n || '::all' || n, 'syntactic', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::View' || n || '::all' || n, 'calls', f || '::View' || n || '::label' || n, 'receiver-typed', 1, e || ':7' FROM p
    UNION ALL SELECT f || '::Row' || n, 'calls', f || '::View' || n || '::all' || n, 'receiver-typed', 1, e || ':12' FROM p
    UNION ALL SELECT f || '::Row' || n, 'calls', f || '::View' || n || '::label' || n, 'receiver-typed', 1, e || ':12' FROM p
    UNION ALL SELECT f || '::Row' || n, 'references', 'FR-' || n % 7 + 1, 'explicit-mention', 1, e || ':11' FROM p
    UNION ALL SELECT f, 'imports', 'shop/view/ui/v' || n + 1 || '.tsx', 'path-resolved', 1, e || ':1' FROM p WHERE has_next
""")
def tsx_edges(spark, sf_dir):
    """Markup, regular expressions and nested templates whose quotes and brackets stand alone."""
    return shown(extract(corpora.tsx_corpus(table(spark, sf_dir, "customer"))).edges).drop("confidence")


@query("""
    WITH p AS (SELECT s_suppkey AS n, 'shop/supply/tool/s' || s_suppkey || '.py' AS f FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0)
    SELECT 'code_file' AS object_type, f AS name FROM p UNION ALL SELECT 'code_type', f || '::Supplier' || n FROM p UNION ALL SELECT 'code_function', f || '::main_' || n FROM p
    UNION ALL SELECT 'code_function', f || '::Supplier' || n || '::ship' FROM p UNION ALL SELECT 'code_function', f || '::Supplier' || n || '::pack_' || n FROM p
""")
def selected_nodes(spark, sf_dir):
    """Even suppliers are selected; of every tenth the identity is another."""
    files = corpora.python_corpus(table(spark, sf_dir, "supplier"))
    n = F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long")
    modules = files.where(n % 2 == 0).select("org", "repo", "path", F.when(n % 10 == 0, "other").otherwise(N.content_identity(F.col("content"))).alias("identity"), F.array(F.concat(F.lit("shop/supply/"), "path", F.lit("::main_"), n.cast("string"))).alias("functions"))
    _, _, found = extract_selected(modules, files)
    return found.nodes.select("object_type", "name")


HEIRS = """
    p AS (SELECT c_custkey AS n, c_custkey + 1 AS m, 'shop/heir/ui/b' || c_custkey || '.ts' AS f, 'shop/heir/ui/b' || (c_custkey + 1) || '.ts' AS g, 'ui/b' || c_custkey || '.ts' AS e, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS has_next FROM customer)
"""


@query(f"""
    WITH {HEIRS}, x AS (
        SELECT f AS source_ref, 'contains' AS edge_type, f || '::Base' || n AS target_ref, 'syntactic' AS reason, e || ':2' AS evidence FROM p
        UNION ALL SELECT f || '::Base' || n, 'contains', f || '::Base' || n || '::same', 'syntactic', e || ':4' FROM p
        UNION ALL SELECT f || '::Base' || n, 'contains', f || '::Base' || n || '::make' || n, 'syntactic', e || ':5' FROM p
        UNION ALL SELECT f, 'contains', f || '::Shown' || n, 'syntactic', e || ':7' FROM p
        UNION ALL SELECT f || '::Shown' || n, 'contains', f || '::Shown' || n || '::shown' || n, 'syntactic', e || ':7' FROM p
        UNION ALL SELECT f, 'contains', f || '::helper' || n, 'syntactic', e || ':8' FROM p
        UNION ALL SELECT f, 'contains', f || '::wrap' || n, 'syntactic', e || ':9' FROM p
        UNION ALL SELECT f, 'contains', f || '::use' || n, 'syntactic', e || ':10' FROM p
        UNION ALL SELECT f, 'contains', f || '::test_' || n, 'syntactic', e || ':16' FROM p
        UNION ALL SELECT f, 'imports', g, 'path-resolved', e || ':1' FROM p WHERE has_next
        UNION ALL SELECT f || '::Base' || n, 'extends', g || '::Base' || m, 'syntactic', e || ':1' FROM p WHERE has_next
        UNION ALL SELECT f || '::Base' || n, 'implements_trait', f || '::Shown' || n, 'syntactic', e || ':1' FROM p
        UNION ALL SELECT f || '::helper' || n, 'calls', f || '::wrap' || n, 'name-match', e || ':8' FROM p
        UNION ALL SELECT f || '::use' || n, 'calls', f || '::Base' || n || '::make' || n, 'receiver-typed', e || ':11' FROM p
        UNION ALL SELECT f || '::use' || n, 'calls', g || '::Base' || m || '::make' || m, 'receiver-typed', e || ':12' FROM p WHERE has_next
        UNION ALL SELECT f || '::use' || n, 'calls', f || '::Base' || n || '::same', 'import-scoped', e || ':13' FROM p WHERE NOT has_next
        UNION ALL SELECT f || '::test_' || n, 'references', 'TC-' || n % 7 + 1, 'explicit-mention', e || ':15' FROM p)
    SELECT *, 1::BIGINT AS count FROM x
""")
def heirs_edges(spark, sf_dir):
    """Bases in other files, functions as values, generic calls, types of members, and a method of two types in reach, which gives no edge."""
    return shown(extract(corpora.heirs_corpus(table(spark, sf_dir, "customer"))).edges).drop("confidence")


@query(f"""
    WITH {HEIRS}
    SELECT e AS path, 'return' AS sort, f || '::Base' || n || '::make' || n AS of, NULL AS member, 'Base' || m AS type, NULL::BOOLEAN AS is_trait FROM p
    UNION ALL SELECT e, 'field', 'Base' || n, 'next', 'Base' || m, NULL FROM p UNION ALL SELECT e, 'relation', 'Base' || n, NULL, 'Base' || m, false FROM p UNION ALL SELECT e, 'relation', 'Base' || n, NULL, 'Shown' || n, true FROM p
    UNION ALL SELECT e, 'tag', f || '::test_' || n, NULL, 'TC-' || n % 7 + 1, NULL FROM p
""")
def member_types(spark, sf_dir):
    """What a scan says of return types, fields, supertypes and tests, before anything is resolved."""
    rows = scan(corpora.heirs_corpus(table(spark, sf_dir, "customer"))).where("relation IN ('return', 'field', 'relation', 'comment')")
    parsed = Parsed(Tables(spark, "members").cut(rows, "rows"))  # read four times, scanned once
    none, unknown = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    row = lambda df, sort, of, member, kind, trait: df.select("path", F.lit(sort).alias("sort"), of.alias("of"), member.alias("member"), kind.alias("type"), trait.alias("is_trait"))
    tags = R.harvest(parsed.comments()).where("kind = 'tracking_tag'").withColumnRenamed("file", "path")
    return (
        row(parsed.returns(), "return", F.col("target"), none, F.col("type"), unknown).union(row(parsed.fields(), "field", F.col("owner"), F.col("field"), F.col("type"), unknown))
        .union(row(parsed.relations(), "relation", F.col("child"), none, F.col("parent"), F.col("is_trait"))).union(row(tags, "tag", F.col("source"), none, F.col("identifier"), unknown))
    )


@query("""
    SELECT 'o' AS org, 'r' AS repo, 's' || s_suppkey AS path, 'o/r/s' || s_suppkey || '::f' AS function FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT 'o', 'r', 's' || s_suppkey, 'o/r/s' || s_suppkey || '::g' FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'o', 'r', 's' || s_suppkey, 'o/r/s' || s_suppkey || '::T' FROM supplier
""")
def absent_functions(spark, sf_dir):
    """Selected functions that no file declares; a type of the name is none."""
    n = F.col("s_suppkey")
    path = numbered("s", n)
    name = lambda what: F.concat(F.lit("o/r/"), path, F.lit(f"::{what}"))
    supplier = table(spark, sf_dir, "supplier")
    modules = supplier.select(F.lit("o").alias("org"), F.lit("r").alias("repo"), path.alias("path"), F.array(name("f"), name("g"), name("T")).alias("functions"))
    fact = lambda rows, what, sort: rows.select(F.lit(sort).alias("object_type"), name(what).alias("qualified_name"))
    facts = fact(supplier.where(n % 4 > 0), "f", "code_function").union(fact(supplier.where(n % 3 > 0), "g", "code_function")).union(fact(supplier, "T", "code_type"))
    return S.absent_functions(modules, facts)

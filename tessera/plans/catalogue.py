"""The registered queries of the workload's own operators, each with its SQL where SQL can express it.

The driver's tables stand in for the workload's files: documents for posts, labels for judgments,
embeddings for encoded texts, pages for HTML and trees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.functions.trees import tree_to_graph, vocabulary_id
from tessera.operators import folds, joins, loss, pairs, retrieval
from tessera.operators.encoders import GraphAttentionEncoder, HashedTokenEncoder, encode_column
from tessera.plans.index_build import missing_shards, shard_sizes
from tessera.sources.files import parse_qrels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Index build


@query("""
SELECT d.doc_id, d.lang, trim(e.source) AS opt_source, CASE WHEN l.toxic = 1 THEN NULL ELSE d.n_chars END AS n_chars
FROM documents d JOIN documents e ON d.doc_id = e.doc_id JOIN labels l ON d.doc_id = l.doc_id
""")
def index_three_way_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id", "left_semi")
    parts = {"a": known.select("doc_id", "lang", "n_chars"), "b": known.select("doc_id", tx.strip(F.col("source")).alias("opt_source")), "c": labels.select("doc_id", "toxic")}
    joined = joins.parallel_join(parts, ["doc_id"], strict=False)
    return joined.select("doc_id", "lang", "opt_source", F.when(F.col("toxic") == 1, None).otherwise(F.col("n_chars")).alias("n_chars"))


@query("""
SELECT count(*) FILTER (l.doc_id IS NULL) AS only_documents, count(*) FILTER (d.doc_id IS NULL) AS only_labels
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def index_alignment_check(spark, sf_dir):
    frames = {"d": table(spark, sf_dir, "documents").select("doc_id"), "l": table(spark, sf_dir, "labels").select("doc_id")}
    bad = joins.alignment(frames, ["doc_id"])
    return bad.agg(F.count_if(F.col("n_l") == 0).alias("only_documents"), F.count_if(F.col("n_d") == 0).alias("only_labels"))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN NULL ELSE nullif(trim(d.source), '') END AS formula FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def issue_flag_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", "source", F.when(F.col("toxic") == 1, "x").otherwise(" ").alias("issue"))
    return rows.select("doc_id", joins.issue_null("source", "issue").alias("formula"))


@query("""
SELECT l_linenumber AS shard, count(*) AS n_rows FROM lineitem
WHERE l_linenumber NOT IN (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1
""")
def shard_incremental(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("shard"))
    return missing_shards(rows, rows.where("shard <= 3")).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT l_linenumber AS shard, count(*) AS n_rows, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_skipped FROM lineitem GROUP BY 1")
def build_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_linenumber"))
    returned = shard_sizes(rows.where("l_returnflag = 'R'")).withColumnRenamed("n_rows", "n_skipped")
    return shard_sizes(rows).join(returned, "shard", "left").fillna(0, ["n_skipped"])


# Folds


@query("SELECT user_id, arg_min(props, event_id) AS props FROM events WHERE event_id % 3 <> 0 AND props <> '' GROUP BY user_id")
def first_non_null_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return folds.first_by(rows, ["user_id"], "props", ["event_id"])


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    return folds.last_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["event_id"])


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def hash_sample_k(spark, sf_dir):
    return folds.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents")
def seeded_shuffle(spark, sf_dir):
    return folds.numbered(table(spark, sf_dir, "documents").select("doc_id"), [folds.seeded("doc_id", 42), F.col("doc_id")], "place")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, (SELECT count(*) FROM documents) // 10) THEN 'val' ELSE 'train' END AS split
FROM documents
""")
def exact_split_90_10(spark, sf_dir):
    return folds.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i FROM documents)
SELECT doc_id, i // 128 AS batch_id, CAST(i % 128 AS INTEGER) AS position FROM n WHERE i < ((SELECT count(*) FROM documents) // 128) * 128
""")
def batch_drop_last(spark, sf_dir):
    return folds.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 128)


@query("SELECT count(*) AS n_rows, count(*) FILTER (quality >= 1) AS n_positive, count(DISTINCT doc_id) AS n_ids FROM labels")
def counts(spark, sf_dir):
    return joins.judgment_counts(table(spark, sf_dir, "labels"), "quality", 1)


# Predicates, parsing and scalar functions


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND length(text) > 0")
def post_type_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "de") & (F.length("text") > 0)).select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality >= 1)")
def judged_semi_join(spark, sf_dir):
    return joins.judged_only(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels").where("quality >= 1"), "doc_id")


@query("SELECT DISTINCT doc_id FROM labels")
def judged_ids_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return joins.judged_ids([rows.where("quality >= 1"), rows.where("quality < 1 OR quality IS NULL")])


@query("SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: '[MATH]' || x || '[/MATH]'), 'string_agg', ' ') AS formulas FROM part")
def formula_array_join(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.formula_list(F.split("p_name", " ")).alias("formulas"))


@query("SELECT o_orderkey, trim(concat_ws(' ', nullif(o_orderstatus, ''), nullif(o_orderpriority, ''))) AS combined FROM orders")
def field_concatenation(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.join_parts(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("combined"))


@query("""
WITH lines AS (SELECT CAST(user_id AS VARCHAR) AS t, CAST(event_id % 50 AS VARCHAR) AS d, event_id,
  CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id % 4 AS VARCHAR) END AS g FROM events WHERE event_id % 11 <> 0)
SELECT t AS topic_id, d AS doc_id, arg_max(try_cast(g AS DOUBLE), event_id) AS grade FROM lines WHERE try_cast(g AS DOUBLE) IS NOT NULL GROUP BY ALL
""")
def qrel_parse_safe(spark, sf_dir):
    grade = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 4).cast("string"))
    whole = F.concat_ws("\t", F.col("user_id").cast("string"), F.lit("0"), (F.col("event_id") % 50).cast("string"), grade)
    short = F.concat_ws("\t", F.col("user_id").cast("string"), F.lit("0"), F.lit("1"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, short).otherwise(whole).alias("value"), F.col("event_id").alias("line"))
    return parse_qrels(lines, order=("line",))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props_parse(spark, sf_dir):
    fields = F.from_json("props", "page string, ref string, missing string")
    return table(spark, sf_dir, "events").select("event_id", fields.alias("p")).select("event_id", "p.*")


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS stripped FROM pages
""")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("stripped"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS plain FROM pages
""")
def html_to_text_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text("html").alias("plain"))


_SPANNED = "concat('a <span class=\"math-container\">', CASE doc_id % 5 WHEN 0 THEN '$x+1$' WHEN 1 THEN ' $$y^2$$ ' WHEN 2 THEN 'z' WHEN 3 THEN '$' ELSE '$$' END, '</span> ', lang)"


@query("""
SELECT doc_id, 'a [MATH]' || CASE doc_id % 5 WHEN 0 THEN 'x+1' WHEN 1 THEN 'y^2' WHEN 2 THEN 'z' ELSE '' END || '[/MATH] ' || lang AS plain FROM documents
""")
def math_span_to_token(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.math_spans(F.expr(_SPANNED)).alias("plain"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'let [MATH]' || lang || '[/MATH] be' ELSE 'let [MATH]' || source || '[/MATH] be' END AS plain FROM documents
""")
def latex_to_math(spark, sf_dir):
    source = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('let $', lang, '$ be') ELSE concat('let $$', source, '$$ be') END")
    return table(spark, sf_dir, "documents").select("doc_id", tx.latex_dollars(source).alias("plain"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS plain FROM documents")
def normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("plain"))


@query("SELECT event_id, CAST(trunc(value) AS INTEGER) AS grade FROM events")
def grade_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("value").cast("int").alias("grade"))


# Vectors and retrieval

_QRELS = "SELECT q.vec_id AS t, d.vec_id AS d, CASE WHEN d.vec_id % 3 = 0 THEN 2 ELSE 1 END AS g FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id % 100 = 0"
_RUN = """
SELECT t, d, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, d DESC) AS rk FROM (
  SELECT q.vec_id AS t, d.vec_id AS d, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS s
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) QUALIFY rk <= 50
"""


def _search(spark: SparkSession, sf_dir: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    topics, corpus = rows.where("vec_id % 100 = 0"), rows
    run = retrieval.top_k(topics.select(F.col("vec_id").alias("topic_id"), "embedding"), corpus.select(F.col("vec_id").alias("doc_id"), "embedding"), k)
    judged = topics.select(F.col("vec_id").alias("topic_id"), "label").join(corpus.select(F.col("vec_id").alias("doc_id"), "label"), "label")
    return run, judged.select("topic_id", "doc_id", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0).alias("grade"))


@query(f"SELECT t AS topic_id, d AS doc_id, s AS score, CAST(rk AS INTEGER) AS rank FROM ({_RUN})")
def dot_product_topk(spark, sf_dir):
    return _search(spark, sf_dir)[0]


@query("SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 1)) AS e FROM embeddings)")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("e"))
    return rows.select("vec_id", F.round(vx.norm("e"), 6).alias("norm"), F.round(vx.l2_normalize("e")[0], 6).alias("first"))


@query("SELECT label, i - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def mean_pool(spark, sf_dir):
    pooled = vx.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("mean"))


@query("""
SELECT label, i - 1 AS dim, round(coalesce(sum(x) FILTER (vec_id % 3 <> 0), 0) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS mean
FROM (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL
""")
def masked_mean_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = vx.mean_pool(rows, ["label"], "embedding", "mask")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("mean"))


@query("""
WITH d AS (SELECT label, i, avg(x) AS m, max(x) AS h FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
SELECT label, i - 1 AS dim, round(m, 6) AS value FROM d UNION ALL SELECT label, i - 1 + (SELECT max(i) FROM d), round(h, 6) FROM d
""")
def mean_max_pool(spark, sf_dir):
    pooled = vx.mean_max_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("value"))


METRICS = """
WITH qrels AS ({qrels}), run0 AS ({run}), run AS ({used}),
j AS (SELECT r.t, r.d, r.rk, coalesce(q.g, 0) AS g FROM run r LEFT JOIN qrels q ON r.t = q.t AND r.d = q.d WHERE r.t IN (SELECT t FROM qrels)),
p AS (SELECT *, sum(CASE WHEN g >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY rk) / rk AS prec FROM j),
got AS (SELECT t, sum(CASE WHEN rk <= 10 THEN g / log2(rk + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rk <= 10 AND g >= 2 THEN prec ELSE 0 END) AS ap FROM p GROUP BY t),
b AS (SELECT t, g, row_number() OVER (PARTITION BY t ORDER BY g DESC) AS rk FROM qrels),
ideal AS (SELECT t, sum(CASE WHEN rk <= 10 THEN g / log2(rk + 1) ELSE 0 END) AS best, sum(CASE WHEN g >= 2 THEN 1 ELSE 0 END) AS nrel FROM b GROUP BY t),
m AS (SELECT got.t AS topic_id, CASE WHEN best > 0 THEN dcg / best ELSE 0 END AS ndcg_10, CASE WHEN nrel > 0 THEN ap / nrel ELSE 0 END AS map_10 FROM got JOIN ideal ON got.t = ideal.t)
"""


def _metrics_sql(select: str, used: str = "SELECT * FROM run0") -> str:
    return METRICS.format(qrels=_QRELS, run=_RUN, used=used) + select


@query(_metrics_sql("SELECT topic_id, round(ndcg_10, 6) AS ndcg_10 FROM m"))
def ndcg_at_k(spark, sf_dir):
    return retrieval.metrics(*_search(spark, sf_dir), [10], level=2).select("topic_id", F.round("ndcg_10", 6).alias("ndcg_10"))


@query(_metrics_sql("SELECT topic_id, round(map_10, 6) AS map_10 FROM m"))
def map_at_k(spark, sf_dir):
    return retrieval.metrics(*_search(spark, sf_dir), [10], level=2).select("topic_id", F.round("map_10", 6).alias("map_10"))


@query(_metrics_sql("SELECT round(avg(ndcg_10), 6) AS ndcg_10, round(avg(map_10), 6) AS map_10 FROM m"))
def macro_metrics(spark, sf_dir):
    means = retrieval.macro(retrieval.metrics(*_search(spark, sf_dir), [10], level=2))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query(
    _metrics_sql(
        "SELECT topic_id, round(ndcg_10, 6) AS ndcg_10, round(map_10, 6) AS map_10 FROM m",
        "SELECT t, d, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, d DESC) AS rk FROM run0 WHERE (t, d) IN (SELECT (t, d) FROM qrels)",
    )
)
def ndcg_prime(spark, sf_dir):
    found = retrieval.metrics(*_search(spark, sf_dir), [10], level=2, prime=True)
    return found.select("topic_id", *[F.round(c, 6).alias(c) for c in ("ndcg_10", "map_10")])


@query(f"WITH q AS ({_QRELS}), r AS ({_RUN}) SELECT r.t AS topic_id, r.d AS doc_id, CAST(coalesce(q.g, 0) AS INTEGER) AS grade FROM r LEFT JOIN q ON r.t = q.t AND r.d = q.d WHERE r.t IN (SELECT t FROM q)")
def qrels_restricted_to_run(spark, sf_dir):
    return retrieval.judged_run(*_search(spark, sf_dir))[0].select("topic_id", "doc_id", "grade")


# Training pairs and loss


@query("""
SELECT u.conv_id AS topic_id, a.turn AS doc_id, u.text AS query, a.text AS positive
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND length(a.text) > 0
""")
def positive_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    users = rows.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("topic_id"), F.col("text").alias("query"), "conv_id", "turn")
    answers = rows.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("post_id"), "text", F.col("conv_id").alias("c"), F.col("turn").alias("n"))
    judged = users.select("topic_id", F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1).alias("doc_id"), F.lit(1.0).alias("grade"))
    found = pairs.text_pairs(users.select("topic_id", "query"), judged, answers.select("post_id", "text"))
    split = lambda c, i: F.split(c, "-")[i].cast("long")
    return found.select(split("topic_id", 0).alias("topic_id"), split("doc_id", 1).alias("doc_id"), "query", "positive")


@query("""
SELECT d.source AS query, d.text AS positive FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality >= 1
UNION ALL SELECT CAST(item_id AS VARCHAR), '[MATH]' || text || '[/MATH]' FROM benchmark
""")
def pairs_union_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality >= 1"), "doc_id")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), tx.wrap_math(F.col("text")).alias("positive"))
    return docs.select(F.col("source").alias("query"), F.col("text").alias("positive")).unionByName(bench)


@query("""
WITH o AS (SELECT text, arg_min(source, doc_id) AS opt FROM documents GROUP BY text)
SELECT d.doc_id AS topic_id, o.opt FROM documents d JOIN o ON d.text = o.text
""")
def topic_opt_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    topics = docs.select(F.col("doc_id").alias("topic_id"), "text")
    return joins.first_match(topics, docs.select("text", F.col("source").alias("opt"), "doc_id"), "text", "opt", ["doc_id"]).select("topic_id", "opt")


@query("""
WITH p AS (SELECT (q.vec_id // 2) // 32 AS b, (q.vec_id // 2) % 32 AS i, q.embedding::DOUBLE[] AS q, p.embedding::DOUBLE[] AS p
  FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0),
s AS (SELECT a.b, a.i, c.i AS j, list_inner_product(a.q, c.p) / 0.07 AS s FROM p a JOIN p c ON a.b = c.b),
r AS (SELECT b, i, ln(sum(exp(s))) - sum(CASE WHEN i = j THEN s ELSE 0 END) AS h FROM s GROUP BY b, i),
k AS (SELECT b, j, ln(sum(exp(s))) - sum(CASE WHEN i = j THEN s ELSE 0 END) AS h FROM s GROUP BY b, j)
SELECT b AS batch_id, count(*) AS n_pairs, round((avg(r.h) + (SELECT avg(k.h) FROM k WHERE k.b = r.b)) / 2, 6) AS loss FROM r GROUP BY b
""")
def info_nce_loss(spark, sf_dir):
    found = loss.info_nce(_batched(spark, sf_dir))
    return found.select("batch_id", "n_pairs", F.round("loss", 6).alias("loss"))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    nth = F.floor(F.col("vec_id") / 2)
    queries = rows.where("vec_id % 2 = 0").select("vec_id", F.floor(nth / 32).cast("long").alias("batch_id"), (nth % 32).cast("long").alias("position"), F.col("embedding").alias("q"))
    return queries.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p")), "vec_id")


@query("SELECT round(avg(m), 6) AS loss, count(*) AS n_batches FROM (SELECT event_id // 100 AS b, avg(value) AS m FROM events GROUP BY 1)")
def mean_of_batch_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("b")).agg(F.avg("value").alias("loss"))
    return loss.mean_loss(rows).select(F.round("loss", 6).alias("loss"), "n_batches")


# Vocabulary and encoders; the graph encoder is checked by a dense form in the unit tests


@query("SELECT role, CASE role WHEN 'apply' THEN 2 WHEN 'ci' THEN 1 ELSE 0 END AS id FROM (SELECT DISTINCT role FROM conversations)")
def vocabulary_lookup(spark, sf_dir):
    roles = table(spark, sf_dir, "conversations").select("role").distinct()
    return roles.select("role", vocabulary_id(F.concat(F.lit("{http://www.w3.org/1998/Math/MathML}"), "role")).alias("id"))


def _components(embedding: str) -> Column:
    """A vector's components in ten thousandths, as one text."""
    return F.array_join(F.transform(embedding, lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), ",")


@query("""
WITH t AS (SELECT doc_id, unnest(string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+')) AS token FROM documents),
c AS (SELECT token, md5(token) AS h, count(*) AS n, doc_id FROM t WHERE token <> '' GROUP BY ALL),
v AS (SELECT doc_id, n, CAST('0x' || substr(h, 1 + 4 * k, 4) AS INTEGER) AS x FROM c, generate_series(0, 7) g(k)),
p AS (SELECT doc_id, (x // 2) % 64 AS dim, sum(CASE WHEN x % 2 = 1 THEN n ELSE -n END) AS s FROM v GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(s * s)) AS len FROM p GROUP BY doc_id),
a AS (SELECT d.doc_id, dim, round(10000 * CAST(coalesce(s / nullif(len, 0), 0) AS FLOAT)::DOUBLE)::INTEGER AS c
  FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) d LEFT JOIN p USING (doc_id, dim) LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, 64 AS dimension, string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim) AS components FROM a GROUP BY doc_id
""")
def hashed_text_encode(spark, sf_dir):
    rows = encode_column(table(spark, sf_dir, "documents"), HashedTokenEncoder(64, max_length=None), "text", ["doc_id"])
    return rows.select("doc_id", F.size("embedding").alias("dimension"), _components("embedding").alias("components"))


@query()
def graph_attention_encode(spark, sf_dir):
    from tessera.plans.file_queries import formulas

    rows = formulas(spark, sf_dir).select("id", tree_to_graph()(F.col("opt")).alias("graph")).where(F.col("graph").isNotNull())
    encoder = GraphAttentionEncoder(embedding=16, hidden=16, heads=2, layers=2, dimension=32)
    return encode_column(rows, encoder, "graph", ["id"]).select("id", _components("embedding").alias("components"))


from tessera.plans import file_queries  # noqa: E402, F401  (registers the queries over files)

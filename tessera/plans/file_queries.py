"""Queries that write the driver's tables in the workload's file formats and run the library's readers,
index build and pair builders on what they wrote, each with its SQL on the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.trees import node_degrees, tree_to_graph, valid_mask
from tessera.operators import pairs
from tessera.plans import index_build
from tessera.plans.catalogue import METRICS, query, table
from tessera.operators.encoders import HashedTokenEncoder, TagCountEncoder
from tessera.plans.evaluate import evaluate_formula, evaluate_text, formula_corpus, resolved
from tessera.sources import files
from tessera.session import new_path


def _escaped(col: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(mark), F.lit(name))
    return col


def _xml_files(rows: DataFrame, root: str, tag: str) -> str:
    """Columns whose names start with "_" become attributes of the row's element, the others its children."""
    path = new_path(rows.sparkSession, "xml-files")
    rows.write.format("xml").options(rootTag=root, rowTag=tag, declaration="").save(path)
    return path


def _text_files(rows: DataFrame, line: Column, name: str) -> str:
    path = new_path(rows.sparkSession, name)
    rows.select(line.alias("value")).write.text(path)
    return path


# The formula table: an id with LaTeX and two trees; names hold quotes, tabs and blanks.

_FORMULAS = """
SELECT p_partkey AS id, p_size AS post_id, 'answer' AS type, 'v' || (p_partkey // 3) AS old_visual_id, 'w' || p_partkey AS visual_id, p_partkey % 7 = 0 AS flagged,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' "' || p_brand || '"' || chr(9) || p_type END AS latex,
  CASE WHEN p_partkey % 11 = 0 THEN '<math><ci>' ELSE '<m:math xmlns:m="http://www.w3.org/1998/Math/MathML"><m:apply><m:plus/>' || repeat('<m:ci>x</m:ci>', p_size) || '</m:apply></m:math>' END AS opt
FROM part
"""


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, post_id, type, old_visual_id, visual_id, flagged, latex, opt."""
    rows = table(spark, sf_dir, "part")
    tree = F.concat(F.lit('<m:math xmlns:m="http://www.w3.org/1998/Math/MathML"><m:apply><m:plus/>'), F.expr("repeat('<m:ci>x</m:ci>', p_size)"), F.lit("</m:apply></m:math>"))
    return rows.select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("post_id"), F.lit("answer").alias("type"),
        F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("old_visual_id"), F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("visual_id"),
        (F.col("p_partkey") % 7 == 0).alias("flagged"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat("p_name", F.lit(' "'), "p_brand", F.lit('"\t'), "p_type")).alias("latex"),
        F.when(F.col("p_partkey") % 11 == 0, "<math><ci>").otherwise(tree).alias("opt"),
    )


def _families(rows: DataFrame, first: int = 0) -> list[str]:
    """Three folders of tab-separated files, numbered from ``first`` on, with the same rows in files of one number."""
    spark = rows.sparkSession
    dealt = rows.repartition(4, "id")
    folders = []
    for value in ("latex", "opt", "opt"):
        issue = F.when(F.col("flagged"), "bad").otherwise("")
        lines = dealt.select("id", "post_id", F.lit("1").alias("thread_id"), "type", F.lit("").alias("comment_id"), "old_visual_id", "visual_id", issue.alias("issue"), F.col(value).alias("formula"))
        folders.append(new_path(spark, "formula-files"))
        lines.write.options(sep="\t", header=True, quote='"', escape='"', quoteAll=True, emptyValue="", lineSep="\n").csv(folders[-1])
        system = spark._jvm.org.apache.hadoop.fs.Path(folders[-1]).getFileSystem(spark._jsc.hadoopConfiguration())
        for path in files.listed(spark, folders[-1]):
            name = path.rpartition("/")[2]
            if name.startswith("part-"):
                target = f"{folders[-1]}/{first + int(name.split('-')[1])}.tsv"
                system.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(target))
    return folders


@query(f"SELECT CAST(id AS VARCHAR) AS id, CAST(post_id AS VARCHAR) AS post_id, old_visual_id, visual_id, CASE WHEN flagged THEN 'bad' ELSE '' END AS issue, latex AS formula FROM ({_FORMULAS})")
def formula_tsv_scan(spark, sf_dir):
    folder = _families(formulas(spark, sf_dir))[0]
    return files.formula_files(spark, f"{folder}/*.tsv").select("id", "post_id", "old_visual_id", "visual_id", "issue", "formula")


@query(f"""
SELECT id, CAST(post_id AS BIGINT) AS post_id, type, old_visual_id, visual_id, trim(latex) AS latex, CASE WHEN NOT flagged THEN opt END AS opt, CASE WHEN NOT flagged THEN opt END AS slt FROM ({_FORMULAS})
""")
def formula_index_build(spark, sf_dir):
    folders, out = _families(formulas(spark, sf_dir)), new_path(spark, "formula-index")
    index_build.build_index(spark, *folders, out)
    return index_build.read_index(spark, out).drop("shard")


@query(f"""
SELECT CASE WHEN id % 2 = 0 THEN 'skipped' ELSE 'written' END AS status, count(*) AS n_rows FROM ({_FORMULAS}) GROUP BY 1
""")
def formula_index_increment(spark, sf_dir):
    """A second build reads only the files whose shards aren't written."""
    rows, out = formulas(spark, sf_dir), new_path(spark, "formula-index")
    even = _families(rows.where("id % 2 = 0"))
    index_build.build_index(spark, *even, out)
    odd = _families(rows.where("id % 2 = 1"), 1_000_000)
    system = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for old, new in zip(even, odd, strict=True):
        for path in files.listed(spark, new):
            if path.endswith(".tsv"):
                system.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{old}/{path.rpartition('/')[2]}"))
    return index_build.build_index(spark, *even, out).groupBy("status").agg(F.sum("n_rows").alias("n_rows"))


@query(f"""
SELECT id, CAST(post_id AS BIGINT) AS post_id, type, old_visual_id, visual_id, trim(latex) AS latex, CASE WHEN NOT flagged THEN opt END AS opt, CASE WHEN NOT flagged THEN opt END AS slt FROM ({_FORMULAS})
""")
def formula_index_rebuild(spark, sf_dir):
    """The families are staged as bucketed tables, and built from these a second time."""
    folders, out, staged = _families(formulas(spark, sf_dir)), new_path(spark, "formula-index"), f"staged_{uuid.uuid4().hex}"
    try:
        index_build.build_index(spark, *folders, out, staged=staged)
        index_build.build_index(spark, *folders, out, staged=staged, force=True)
    finally:
        index_build.unstage(spark, staged)
    return index_build.read_index(spark, out).drop("shard")


@query(f"SELECT old_visual_id, arg_min(opt, id) AS opt FROM ({_FORMULAS}) WHERE NOT flagged GROUP BY 1")
def formula_corpus_entries(spark, sf_dir):
    rows = formulas(spark, sf_dir)
    return formula_corpus(rows.withColumn("opt", F.when(~F.col("flagged"), F.col("opt"))), ["id"])


# Posts, topics and judgments

_SQUEEZED = "trim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS post_id, {_SQUEEZED.format('text')} AS text FROM documents WHERE lang = 'en' AND length({_SQUEEZED.format('text')}) > 0")
def posts_xml_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>"))
    kind = F.when(F.col("lang") == "en", files.POST_TYPES["answer"]).otherwise(files.POST_TYPES["question"])
    posts = rows.select(F.col("doc_id").cast("string").alias("_Id"), kind.alias("_PostTypeId"), body.alias("_Body"))
    return files.posts_xml(spark, _xml_files(posts, "posts", "row"), "answer")


@query("SELECT CAST(p_partkey AS VARCHAR) AS post_id, p_name || ' ' || p_brand || ' [MATH]' || p_type || '[/MATH]' AS text FROM part WHERE p_partkey % 3 <> 0")
def posts_selection(spark, sf_dir):
    """JSON lines where there is no XML; invalid lines and other types are skipped."""
    kind = F.when(F.col("p_partkey") % 3 != 0, "answer").otherwise("question")
    record = F.struct(F.col("p_partkey").alias("post_id"), kind.alias("post_type"), F.col("p_name").alias("title"), F.col("p_brand").alias("text"), F.array("p_type", F.lit("")).alias("formulas"))
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(F.to_json(record), F.lit("{bad"))).alias("line"))
    path = _text_files(rows, F.col("line"), "posts-jsonl")
    return files.posts(spark, path + "-none.xml", path)


def _number() -> Column:
    return F.concat(F.lit("A."), F.col("item_id").cast("string")).alias("_number")


@query(f"SELECT 'A.' || item_id AS topic_id, 'Title ' || item_id || ' [MATH]x[/MATH] ' || {_SQUEEZED.format('text')} AS query FROM benchmark")
def topics_xml_scan(spark, sf_dir):
    title = F.concat(F.lit("Title "), F.col("item_id").cast("string"))
    question = F.concat(F.lit('<p><span class="math-container">$x$</span> '), _escaped(F.col("text")), F.lit("</p>"))
    topics = table(spark, sf_dir, "benchmark").select(_number(), title.alias("Title"), question.alias("Question"))
    return files.text_topics(spark, [_xml_files(topics, "Topics", "Topic")])


@query("SELECT 'A.' || item_id AS topic_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS query FROM benchmark WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 0")
def formula_topics_scan(spark, sf_dir):
    topics = table(spark, sf_dir, "benchmark").select(_number(), F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("Latex"))
    return files.formula_topics(spark, [_xml_files(topics, "Topics", "Topic")])


_JUDGED = """
SELECT CAST(o_custkey AS VARCHAR) AS topic_id, CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 3.0 ELSE CAST(o_orderkey % 3 AS DOUBLE) END AS grade FROM orders
"""


@query(_JUDGED)
def qrels_files(spark, sf_dir):
    """Two files of judgments; the official one comes first, so the other one wins; bad lines fail the job."""
    rows = table(spark, sf_dir, "orders")
    line = lambda grade: F.concat_ws("\t", F.col("o_custkey").cast("string"), F.lit("0"), F.col("o_orderkey").cast("string"), grade)
    base = new_path(spark, "qrels")
    rows.where("o_orderkey % 4 = 0").select(line(F.lit("3")).alias("value")).write.text(f"{base}/all")
    rows.select(line((F.col("o_orderkey") % 3).cast("string")).alias("value")).write.text(f"{base}/official")
    return files.qrels(spark, files.qrel_precedence([f"{base}/all", f"{base}/official"]), on_bad_grade="error")


# Pairs

_GRADED = "SELECT CAST(n_nationkey AS VARCHAR) AS topic_id, 'v' || n_nationkey AS doc_id, CAST(n_regionkey AS DOUBLE) AS grade FROM nation"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(key.alias("topic_id"), F.concat(F.lit("v"), key).alias("doc_id"), F.col("n_regionkey").cast("double").alias("grade"))


@query(f"""
WITH f AS (SELECT old_visual_id, arg_min(latex, id) AS latex FROM ({_FORMULAS}) WHERE latex <> '' GROUP BY 1), g AS ({_GRADED})
SELECT topic_id, doc_id, n_name AS query, '[MATH]' || latex || '[/MATH]' AS positive FROM g JOIN nation ON topic_id = CAST(n_nationkey AS VARCHAR) JOIN f ON doc_id = old_visual_id WHERE grade >= 2
""")
def formula_text_pairs(spark, sf_dir):
    topics = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("topic_id"), F.col("n_name").alias("query"))
    return pairs.formula_pairs(topics, _graded(spark, sf_dir), formulas(spark, sf_dir), ["id"])


@query(f"""
WITH f AS ({_FORMULAS}), g AS ({_GRADED}), l AS (SELECT latex, arg_min(id, id) AS at FROM f WHERE opt <> '' GROUP BY latex), v AS (SELECT old_visual_id, min(id) AS at FROM f GROUP BY 1),
q AS (SELECT CAST(n_nationkey AS VARCHAR) AS topic_id, l.at FROM nation JOIN f ON f.id = n_nationkey + 1 JOIN l ON l.latex = f.latex),
n AS (SELECT id, post_id + 3 AS nodes FROM f WHERE id % 11 <> 0)
SELECT g.topic_id, g.doc_id, CAST(a.nodes AS INTEGER) AS query_nodes, CAST(b.nodes AS INTEGER) AS pos_nodes
FROM g JOIN q ON g.topic_id = q.topic_id JOIN n a ON a.id = q.at JOIN v ON v.old_visual_id = g.doc_id JOIN n b ON b.id = v.at WHERE g.grade >= 2
""")
def graph_tree_pairs(spark, sf_dir):
    """Topics resolved to trees by equal LaTeX, positives by id; unreadable trees give no pair."""
    index = formulas(spark, sf_dir)
    key = (F.col("n_nationkey") + 1).alias("id")
    topics = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("topic_id"), key).join(index.select("id", F.col("latex").alias("query")), "id").drop("id")
    found = pairs.graph_pairs(topics, _graded(spark, sf_dir), index, ["id"])
    return found.select("topic_id", "doc_id", F.col("query_graph.num_nodes").alias("query_nodes"), F.col("pos_graph.num_nodes").alias("pos_nodes"))


# Trees of the whole table

@query(f"SELECT id, CASE WHEN id % 11 <> 0 THEN post_id + 3 END AS num_nodes, CASE WHEN id % 11 <> 0 THEN 2 * (post_id + 2) END AS num_edges, id % 11 <> 0 AS valid FROM ({_FORMULAS})")
def tree_to_graph_counts(spark, sf_dir):
    rows = formulas(spark, sf_dir).select("id", tree_to_graph()(F.col("opt")).alias("g"))
    return rows.select("id", F.col("g.num_nodes").alias("num_nodes"), F.when(valid_mask(F.col("g")), F.size("g.src")).alias("num_edges"), valid_mask(F.col("g")).alias("valid"))


@query(f"""
SELECT id, CAST(node AS INTEGER) AS node, CASE WHEN node = 0 THEN 5 WHEN node = 1 THEN 2 WHEN node = 2 THEN 10 ELSE 1 END AS tag, CAST(CASE WHEN node = 1 THEN post_id + 2 ELSE 1 END AS BIGINT) AS degree
FROM ({_FORMULAS}), generate_series(0, 60) g(node) WHERE id % 11 <> 0 AND node < post_id + 3
""")
def graph_degree(spark, sf_dir):
    """Every node's id in the vocabulary and its number of edges."""
    rows = formulas(spark, sf_dir).select("id", tree_to_graph()(F.col("opt")).alias("g")).where(valid_mask(F.col("g")))
    nodes = rows.select("id", F.posexplode(F.arrays_zip(F.col("g.x").alias("tag"), node_degrees(F.col("g")).alias("degree"))).alias("node", "n"))
    return nodes.select("id", "node", "n.tag", "n.degree")


@query("""
WITH a AS (SELECT p_partkey AS id, p_partkey % 5 AS m, unnest(range(p_partkey % 5 + 1)) AS k FROM part),
c AS (SELECT *, 2 * ((k + id) % 4) AS c, CAST(coalesce(sum(2 * ((k + id) % 4)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM a),
l AS (SELECT *, unnest(range(c)) AS j FROM c)
SELECT id, 0 AS parent, CAST(k + 1 AS INTEGER) AS node, 2 AS tag FROM c
UNION ALL SELECT id, CAST(k + 1 AS INTEGER), CAST(m + 2 + before + j AS INTEGER), CASE WHEN j % 2 = 0 THEN 1 ELSE 0 END FROM l
""")
def tree_shapes(spark, sf_dir):
    """Edges and tags of trees of different shapes: up to five branches with up to six leaves each."""
    leaves = "repeat('<ci>x</ci><!-- <ci> --><zz a=\">\"/>', CAST((k + p_partkey) % 4 AS INT))"
    tree = F.expr(f"concat('<math>', array_join(transform(sequence(0, CAST(p_partkey % 5 AS INT)), k -> concat('<apply>', {leaves}, '</apply>')), ' '), '</math>')")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tree_to_graph()(tree).alias("g"))
    edges = rows.select("id", "g.x", F.explode(F.arrays_zip("g.src", "g.dst")).alias("e")).select("id", "x", F.col("e.src").alias("parent"), F.col("e.dst").alias("node"))
    return edges.where("parent < node").select("id", "parent", "node", F.get("x", "node").alias("tag"))


# Whole evaluations: topics, judgments, encoding, search and measures

_TEXT_JUDGED = "SELECT 'A.' || item_id AS t, doc_id AS d, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE doc_id % 3 END AS g FROM labels JOIN benchmark ON doc_id % 20 = item_id % 20"
_TEXT_RUN = """
SELECT t, d, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, d DESC) AS rk FROM (
  SELECT a.t, b.d, CAST(CAST(coalesce(sum(x.v::DOUBLE * y.v::DOUBLE), 0) AS FLOAT) AS DOUBLE) AS s
  FROM (SELECT 'A.' || item_id AS t FROM benchmark) a CROSS JOIN (SELECT doc_id AS d FROM documents) b LEFT JOIN queries x ON x.id = a.t LEFT JOIN posts y ON y.id = b.d AND y.dim = x.dim
  GROUP BY a.t, b.d) QUALIFY rk <= 100
"""


def _hashed(name: str, rows: str) -> str:
    """Named parts of a query: id, dim, v of the hashed encoding of ``rows`` (id, text) in 64 dimensions."""
    return f"""
{name}0 AS ({rows}), {name}1 AS (SELECT id, unnest(string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+')) AS token FROM {name}0),
{name}2 AS (SELECT id, n, CAST('0x' || substr(h, 1 + 4 * k, 4) AS INTEGER) AS x FROM (SELECT id, md5(token) AS h, count(*) AS n FROM {name}1 WHERE token <> '' GROUP BY id, token), generate_series(0, 7) g(k)),
{name}3 AS (SELECT id, (x // 2) % 64 AS dim, sum(CASE WHEN x % 2 = 1 THEN n ELSE -n END) AS s FROM {name}2 GROUP BY ALL),
{name} AS (SELECT id, dim, CAST(s / nullif(sqrt(sum(s * s) OVER (PARTITION BY id)), 0) AS FLOAT) AS v FROM {name}3)"""


_MEASURES = "SELECT topic_id, round(ndcg_10, 6) AS ndcg_10, round(map_10, 6) AS map_10 FROM m"


def _measures(found: DataFrame) -> DataFrame:
    return found.select("topic_id", *[F.round(c, 6).alias(c) for c in ("ndcg_10", "map_10")])


@query(
    f"WITH {_hashed('queries', f"SELECT 'A.' || item_id AS id, 'Title ' || item_id || ' ' || {_SQUEEZED.format('text')} AS text FROM benchmark")}, {_hashed('posts', 'SELECT doc_id AS id, text FROM documents')},"
    + METRICS.format(qrels=_TEXT_JUDGED, run=_TEXT_RUN, used="SELECT * FROM run0").strip().removeprefix("WITH")
    + _MEASURES
)
def text_evaluation(spark, sf_dir):
    """Topics and judgments are read from files; posts are whole documents."""
    title = F.concat(F.lit("Title "), F.col("item_id").cast("string"))
    topics = table(spark, sf_dir, "benchmark").select(_number(), title.alias("Title"), _escaped(F.col("text")).alias("Question"))
    labels = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "benchmark").select("item_id"), F.col("doc_id") % 20 == F.col("item_id") % 20)
    grade = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(F.col("doc_id") % 3).cast("string")
    judged = _text_files(labels, F.concat_ws("\t", F.concat(F.lit("A."), F.col("item_id").cast("string")), F.lit("0"), F.col("doc_id").cast("string"), grade), "qrels")
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), "text")
    qrels = files.qrels(spark, [judged]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return _measures(evaluate_text(files.text_topics(spark, [_xml_files(topics, "Topics", "Topic")]), posts, qrels, HashedTokenEncoder(64, max_length=None), k=100, level=2))


_FORMULA_QRELS = "SELECT CAST(n_nationkey AS VARCHAR) AS t, 'v' || unnest(range(n_nationkey, 200, 5)) AS d, 1 + n_nationkey % 3 AS g FROM nation"
_FORMULA_RUN = f"""
SELECT t, d, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, d DESC) AS rk FROM (
  SELECT q.t, v.d, CAST((3 * q.one * v.one + q.n * v.n) AS FLOAT)::DOUBLE AS s FROM (
    SELECT CAST(n_nationkey AS VARCHAR) AS t, CAST(1 / sqrt(3 + post_id * post_id) AS FLOAT)::DOUBLE AS one, CAST(post_id / sqrt(3 + post_id * post_id) AS FLOAT)::DOUBLE AS n
    FROM nation JOIN ({_FORMULAS}) f ON f.id = n_nationkey + 1 WHERE f.id % 5 <> 0 AND f.id % 11 <> 0) q,
  (SELECT old_visual_id AS d, CAST(1 / sqrt(3 + p * p) AS FLOAT)::DOUBLE AS one, CAST(p / sqrt(3 + p * p) AS FLOAT)::DOUBLE AS n
    FROM (SELECT old_visual_id, arg_min(post_id, id) AS p, min(id) AS id FROM ({_FORMULAS}) GROUP BY 1) WHERE id % 11 <> 0) v) QUALIFY rk <= 50
"""


def _formula_topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = formulas(spark, sf_dir)
    keys = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_nationkey").cast("string").alias("topic_id"))
    return keys.join(index.select("id", F.col("latex").alias("query")), "id").select("topic_id", "query"), index


@query(METRICS.format(qrels=_FORMULA_QRELS, run=_FORMULA_RUN, used="SELECT * FROM run0") + _MEASURES)
def formula_evaluation(spark, sf_dir):
    topics, index = _formula_topics(spark, sf_dir)
    judged = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("topic_id"),
        F.explode(F.sequence(F.col("n_nationkey"), F.lit(199), F.lit(5))).alias("d"), (1 + F.col("n_nationkey") % 3).cast("double").alias("grade"),
    )
    qrels = judged.select("topic_id", F.concat(F.lit("v"), F.col("d").cast("string")).alias("doc_id"), "grade")
    return _measures(evaluate_formula(topics, index, qrels, TagCountEncoder(), ["id"], k=50))


@query(f"SELECT CASE WHEN id % 5 = 0 THEN 'unmatched' WHEN id % 11 = 0 THEN 'unreadable' ELSE 'resolved' END AS status, count(*) AS n_topics FROM nation JOIN ({_FORMULAS}) ON id = n_nationkey + 1 GROUP BY 1")
def unresolved_topics(spark, sf_dir):
    """What became of each topic of a formula evaluation."""
    topics, index = _formula_topics(spark, sf_dir)
    return resolved(topics, index, ["id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n_topics"))

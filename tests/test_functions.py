import html.entities
import re

import duckdb
import numpy as np
import pytest
from plain_trees import parse_tree
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.functions.trees import MAX_NODES, VOCABULARY, node_degrees, tree_to_graph, vocabulary_id
from tessera.plans import catalogue, file_queries

SPAN = '<span class="math-container">{}</span>'
CASES = ["$x$", "$$x$$", " $ x $ ", "x", "$", "$$", "$$$", "$a\nb$", "a$b", "", " ", "$$a$", " $x$ ", "\x1cy\x1c"]


def column(spark, values, fn, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def plain_token(found):
    inner = found[1].strip()
    for mark in ("$$", "$"):
        if inner.startswith(mark) and inner.endswith(mark):
            inner = inner[len(mark) : -len(mark)].strip()
            break
    return f"[MATH]{inner}[/MATH]"


def plain_text(source):
    """HTML to text by Python's own functions."""
    spans = re.sub(r'<span\s+class="math-container"[^>]*>(.*?)</span>', plain_token, source or "", flags=re.DOTALL)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", spans)).split())


def test_math_spans_equal_the_exact_definition(spark):
    sources = [f"a {SPAN.format(c)} b" for c in CASES] + [f'<span  class="math-container" id="q">{c}</span>' for c in CASES]
    exact = [re.sub(r'<span\s+class="math-container"[^>]*>(.*?)</span>', plain_token, s, flags=re.DOTALL) for s in sources]
    assert column(spark, sources, tx.math_spans) == exact
    assert column(spark, [None, "", "no span"], tx.math_spans) == [None, "", "no span"]


def test_html_to_text(spark):
    sources = [SPAN.format("$a &lt; b$") + " &amp;lt; <b>x</b> y", None, "", "<p>a</p><p>b</p>", SPAN.format("$a <i> b$")]
    assert column(spark, sources, tx.html_to_text) == ["[MATH]a < b[/MATH] &lt; x y", "", "", "a b", "[MATH]a b[/MATH]"]


def test_html_to_text_of_random_sources(spark):
    """Among them spans that nest, overlap or never end."""
    rng = np.random.default_rng(6)
    parts = ["$", "$$", '<span class="math-container">', '<span class="math-container" x="1">', "</span>", "<b>", "&lt;", "&amp;", "&", " ", "\n", "\x1c", "\u3000", "x", "<", ">", "é"]
    sources = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(1500)]
    assert column(spark, sources, tx.html_to_text) == [plain_text(s) for s in sources]


def test_unescape_equals_the_library(spark):
    rng = np.random.default_rng(7)
    names, parts = list(html.entities.html5), ["&", "#", "x", "amp", "lt", ";", "not", "in", "1", "65", "a", " ", "\n", "é", "<", "acute"]
    codes = [*range(0x300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x1F600, 0x10FFFF, 0x110000, 10**11, 10**30]
    sources = [f"&#{c}{e}" for c in codes for e in (";", "")] + [f"&#x{c:X};" for c in codes] + ["&" + n for n in names]
    sources += ["&" + str(rng.choice(names)) + e for e in ("", ";", "x", " ") for _ in range(200)]
    sources += ["".join(rng.choice(parts, 10)) for _ in range(1500)] + ["&#000000000065;&#x;&#;&;&&", "&notit; &notinx", "", "no reference"]
    assert column(spark, sources, tx.unescape) == [html.unescape(s) for s in sources]
    assert column(spark, [None], tx.unescape) == [None]


def test_texts_need_no_python(spark):
    rows = spark.createDataFrame([("a",)], "v string")
    for fn in (tx.html_to_text, tx.strip_html):
        assert "Python" not in rows.select(fn(F.col("v")))._jdf.queryExecution().toString()


def test_latex_dollars(spark):
    expected = {
        "a $x$ b": "a [MATH]x[/MATH] b",
        "$$y$$": "[MATH]y[/MATH]",
        "$$y$$ and $z$": "[MATH]y[/MATH] and [MATH]z[/MATH]",
        "$$a\nb$$": "[MATH]a\nb[/MATH]",
        "$x$ and $y$": "[MATH]x[/MATH] and [MATH]y[/MATH]",
        "$$$x$": "$$$x$",
        "$a\nb$": "$a\nb$",
        "costs $5": "costs $5",
        "": "",
        None: "",
    }
    assert column(spark, list(expected), tx.latex_dollars) == list(expected.values())


def test_space_is_python_space(spark):
    sources = [" a\x1f\x0bb ", "  ", "\x1c", "a"]
    assert column(spark, sources, tx.strip) == [s.strip() for s in sources]
    assert column(spark, sources, tx.collapse) == [re.sub(r"\s+", " ", s).strip() for s in sources]


def test_strip_html_keeps_inner_space(spark):
    assert column(spark, ["<p> a  &amp; b </p>", None], tx.strip_html) == [html.unescape("a  &amp; b"), ""]


def test_formula_list_and_parts(spark):
    rows = spark.createDataFrame([(["x", "", "y"], "t", ""), ([], "", " u ")], "f array<string>, a string, b string")
    out = rows.select(tx.formula_list(F.col("f")), tx.join_parts(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [("[MATH]x[/MATH] [MATH]y[/MATH]", "t"), ("", "u")]


IDS = {t: i + 1 for i, t in enumerate(VOCABULARY)}

TREES = [
    None, "", "<a>", "<a/>", "<a", "<", "x", "<a><b/></a>", " <a><b/></a> ", "<a><b></a>", "<a><b></b >  </a>", "<a><b/></a><c/>", "<a/><c/>", "<a><b/></a></c>", "<a><b/></a><c", "<a><b/></a", "junk<a><b/></a>", "<a><b/></a>junk",
    "<a><b/></a>&", "<a>&nbsp;<b/></a>", "<a>x & y<b/></a>", "<a>&#65;&#x41;&amp;<b/></a>", "<a>&#0;<b/></a>", "<a><b x=1/></a>", "<a><b x='1' x='2'/></a>", "<a><b t='<'/></a>", "<a><b t='>'/></a>", "<a><b x='a:b'/></a>", "<a><1b/></a>", "<a>]]><b/></a>",
    "<a>\x01<b/></a>", "<a><!-- <c> --><b/></a>", "<a><b/></a><!-- <d/> -->", "<a><!-- -- --><b/></a>", "<a><b/></a><!-- -- -->", "<a><![CDATA[<c>]]><b/></a>", "<a><b/></a><![CDATA[x]]>", "<?xml version='1.0'?><a><b/></a>", "<a><b/></a><?x?>", "<!DOCTYPE a><a><b/></a>",
    "<m:a><b/></m:a>", "<m:a xmlns:m='u'><m:b/></m:a>", "<a><m:b xmlns:m='u'/><m:c/></a>", "<a><q:cn xmlns:q='v'><b/></q:cn><c><q:x/></c></a>", "<a xmlns:p='u'><p:ci/><b p:x='1'><q:cn xmlns:q='v'><q:x/></q:cn></b></a>", "<a m:x='1'><b/></a>", "<a xmlns:p=''><b/></a>",
    "<a><xml:b/></a>", "<é><b/></é>", "<math xmlns='http://m'><ci>x</ci><foo/></math>", "<math>" + "<apply><ci/></apply>" * 300 + "</math>", "<a>" * 300 + "</a>" * 300, "<ci>" + "<mn/>" * 3000 + "</ci>",
]


def test_trees_equal_the_parser(spark):
    assert len(VOCABULARY) == 80 and len(set(VOCABULARY)) == 80
    assert parse_tree("<math xmlns='http://m'><ci>x</ci><foo/></math>", IDS) == {"x": [5, 1, 0], "src": [0, 1, 0, 2], "dst": [1, 0, 2, 0], "num_nodes": 3}
    wide = parse_tree(TREES[-3], IDS)
    assert wide["num_nodes"] == MAX_NODES and len(wide["src"]) == 2 * (MAX_NODES - 1)
    got = column(spark, TREES, tree_to_graph())
    assert [(t, g and g.asDict()) for t, g in zip(TREES, got, strict=True)] == [(t, parse_tree(t, IDS)) for t in TREES]


def random_tree(rng, size):
    """XML of ``size`` nodes with random shape, names, text, attributes and ways of closing; every tenth is broken."""
    children, names = {0: []}, rng.choice(["ci", "apply", "zz", "p:cn", "mn"], size)
    for i in range(1, size):
        children[i] = []
        children[int(rng.integers(max(0, i - rng.integers(1, 30)), i))].append(i)

    def shown(i):
        inner = "".join(shown(c) + str(rng.choice(["", "x &lt; y", "<!-- <ci> -->", " "])) for c in children[i])
        attributes = str(rng.choice(["", " a='>'", ' b="&amp;"', "\n"]))
        return f"<{names[i]}{attributes}/>" if not inner and rng.random() < 0.5 else f"<{names[i]}{attributes}>{inner}</{names[i]}>"

    whole = f"<math xmlns:p='u'>{shown(0)}</math>"
    at = int(rng.integers(0, len(whole)))
    return whole if rng.random() < 0.9 else whole[:at] + whole[at + int(rng.integers(1, 9)) :]


def test_random_trees_equal_the_parser(spark):
    rng = np.random.default_rng(11)
    trees = [random_tree(rng, int(n)) for n in rng.integers(1, 60, 250)] + [random_tree(rng, 400) for _ in range(10)]
    want = [parse_tree(t, IDS) for t in trees]
    assert 5 < want.count(None) < 40
    assert [g and g.asDict() for g in column(spark, trees, tree_to_graph())] == want
    few = column(spark, trees[:50], tree_to_graph(["zz", "cn"], 7))
    assert [g and g.asDict() for g in few] == [parse_tree(t, {"zz": 1, "cn": 2}, 7) for t in trees[:50]]


def test_vocabulary(spark):
    assert column(spark, ["{http://m}ci", "mn", "zzz"], vocabulary_id) == [1, 80, 0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], 1), (1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0)], "k int, v array<float>, m int")
    assert rows.select(vx.l2_normalize("v")).first()[0] == pytest.approx([0.6, 0.8])
    assert rows.where("k = 2").select(vx.l2_normalize("v")).first()[0] == [0.0, 0.0]
    pooled = {r[0]: r[1] for r in vx.mean_pool(rows, ["k"], "v", "m").collect()}
    assert pooled[1] == pytest.approx([3.0, 4.0]) and pooled[2] == [0.0, 0.0]
    both = {r[0]: r[1] for r in vx.mean_max_pool(rows, ["k"], "v").collect()}
    assert np.allclose(both[1], [1.5, 2.0, 3.0, 4.0])


def test_graph_degree_joins_nothing(spark, tmp_path):
    """Nodes and degrees come from one tree, so rows of one id don't mix and no side can be broadcast."""
    parts = [(1, "a", "b", "t", 4), (1, "a", "b", "t", 2), (7, "a", "b", "t", 0), (11, "a", "b", "t", 3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = file_queries.graph_degree(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalogue.SQL["graph_degree"]).fetchall())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_node_degrees(spark):
    g = tree_to_graph()(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in TREES], "t string").coalesce(1).select(g.alias("g")).select("g", node_degrees(F.col("g")).alias("d")).collect()
    for r in rows:
        assert list(r["d"]) == [list(r["g"]["src"]).count(i) for i in range(r["g"]["num_nodes"])] if r["g"] else not r["d"]

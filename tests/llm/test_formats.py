import html
import os
import time
import re
from collections import Counter

import numpy as np
import pytest
from helpers import table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, queries, template, wrapper
from tessera.llm.html_tree import blocks, parse

PIECES = st.lists(st.sampled_from(["\\", "<", "s>", "</s>", "[INST]", " [/INST]", "/", "[ROLE]", "<<SYS>>", "a", " ", "[", "]", "[ASST]", "\n", "<</SYS>>", "😀"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x[/ROLE]", "a\\"]), PIECES), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.format_chat([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_chat_tables(spark):
    schema = "turn long, conv_id long, role string, text string, formatted string"
    rows = [(1, 1, "assistant", "b", "z"), (0, 1, "user", "a", "z"), (0, 2, None, None, "z"), (0, None, "user", "</s>", "z"), (0, None, "user", "</s>", "z"), (None, 1, "system", "s", "z")]
    source = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.formatted(source).collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("assistant", "b")], 2: [("", "")], None: [("user", "</s>")] * 2}
    digests = {r["conv_id"]: r for r in chat.digests(source).collect()}
    lengths = {r["conv_id"]: len(r["formatted"]) for r in chat.formatted(source).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["formatted_chars"]) for k, r in digests.items()} == {1: (3, 1, lengths[1]), 2: (1, 0, lengths[2]), None: (2, 0, lengths[None])}
    assert chat.digests(source.limit(0)).count() == 0


SPOKEN = "conv_id long, turn long, role string, text string"
TALK = [(7, t, ["user", "assistant"][t % 2], f"turn {t} \\ </s>" * (t % 4)) for t in range(3000)] + [(100 + i, t, ["system", "tool"][t], "hi") for i in range(300) for t in range(2)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], TALK], ids=["empty", "nulls", "one long conversation"])
def test_chat_query_and_its_sql(spark, tmp_path, rows):
    import duckdb

    spark.createDataFrame(rows, SPOKEN).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op4_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP4_SQL).fetchall()
    assert table(found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) == sorted(want, key=repr)
    assert len(want) == 1 + len({r[0] for r in rows})


def render(source, **values):
    return "".join(t for t, _ in template.compile_template(source)(values))


def test_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.first %}!{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P2Q!"
    assert render("{% set y = 1 + 2 * 3 %}{{ y }}{{ 'a' ~ none ~ y }}") == "7a7"
    assert render("{% if a == 1 and b %}x{% elif a in xs or c %}y{% else %}z{% endif %}", a=2, xs=[2]) == "y"
    assert render("a  {%- if true -%}  b {% endif %}c") == "ab c"
    assert render("{{ m['k'] }}{{ m.none }}{{ xs[1] }}{{ v | default('d') }}{{ xs | join('-') }}", m={"k": 1}, xs=[4, 5]) == "15d4-5"
    assert render("{{ 'yes' if x > 1 else 'no' }}{{ '\\n' }}", x=2) == "yes\n"


def test_template_folding():
    folded = template.fold(template.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}no{{ x }}{% else %}c{% endif %}{{ 'D' | lower }}"))
    assert folded == template.Block((template.Output(template.Const("ab2cd")),))


@pytest.mark.parametrize("source", ["{% if x %}", "{{ a. }}", "{{ x.__class__ }}", "{{ x | nope }}", "{% import os %}", "{{ f() }}", "{% for x %}{% endfor %}", "{{ 'a }}"])
def test_template_errors(source):
    with pytest.raises(template.TemplateError):
        template.compile_template(source)


def test_template_reaches_no_python_attributes():
    assert render("{{ x.upper }}{{ x.real }}", x="text") == ""


def test_generation_marks_and_lazy_loops():
    def endless():
        while True:
            yield {"t": "x"}

    parts = template.compile_template("{% for m in ms %}<{% generation %}{{ m.t }}{% endgeneration %}>{% endfor %}")({"ms": endless()})
    assert [next(parts) for _ in range(4)] == [("<", False), ("x", True), (">", False), ("<", False)]


def test_html_tree():
    page = parse('<p>a<b>b<p class="x">c &amp; d&am<br>e<!-- no --><script>"</p>"</script><ul><li>1<li>2</ul><img src="a>b">f')
    assert blocks(page, lambda e: e.name == "script") == ["ab", "c & d&am e", "1", "2", "f"]
    assert blocks(parse(""), lambda e: False) == [] == blocks(parse("<!-- open"), lambda e: False)
    assert blocks(parse("<div>" * 3000 + "deep"), lambda e: False) == ["deep"]
    assert blocks(parse("a < b <p>c"), lambda e: False) == ["a < b", "c"]


def site(i, body, host="h.example"):
    return (i, f"http://{host}/{i}", f"<html><body><nav><a href=/>home {i % 2}</a></nav><div class=cookie-notice>We use cookies</div>{body}<footer>c {i % 3}</footer></body></html>")


def article(i):
    return (
        f"<article><header><h1>Title {i}</h1></header><p>First &lt;{i}&gt; text\n of page {i}.<p><b>Second {i}</b> part.<div class=share>share me</div><form><p>mail</form>"
        f"<aside>see {i}</aside><p class=slogan>Always the same line</p><section id=comments><p>comment {i}</section></article>"
    )


def test_wrapper(spark):
    want = {i: f"Title {i}\n\nFirst <{i}> text of page {i}.\n\nSecond {i} part." for i in range(6)}
    rows = [site(i, article(i)) for i in range(6)] + [site(100 + i, f"<div id=content><h2>T{i}</h2><p>{'long text %d ' % i * 20}</div>", "o.example") for i in range(4)]
    rows += [(200, None, None), (201, "bad", ""), (202, "http://one.example/", "<main><p>only page</main>"), (203, "http://h.example/x", "plain text"), rows[0]]
    source = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, host int, text string")
    for most in (1 << 20, 0):  # broadcast, join
        got = wrapper.main_texts(source, most)
        texts = {r["page_id"]: r["text"] for r in got.collect()}
        assert {i: texts[i] for i in want} == want
        assert texts[100] == "T0\n\n" + ("long text 0 " * 20).strip()
        assert (texts[200], texts[201], texts[202], texts[203]) == ("", "", "only page", "plain text")
        assert got.count() == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.collect())
        assert wrapper.main_texts(source.limit(0), most).count() == 0


def test_wrappers_are_the_same_in_any_split_and_order(spark):
    rng = np.random.default_rng(1)
    rows = [site(i, article(i) + f"<div><p>{'more ' * (i % 5)}<ul><li>{i}</ul></div>" * (i % 3)) for i in range(40)]
    found = []
    for n in (1, 6, 40):
        rng.shuffle(rows)
        source = wrapper._pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n))
        table_ = wrapper.materialize(wrapper.seeds(source), "seeds")
        found.append(sorted((r["host"], bytes(r["wrapper"])) for r in wrapper.induce(source, table_).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def whole(pages):
    """The seed and the wrapper of some pages of one host."""
    seed, seen = wrapper.seed_tree(pages[0]), wrapper.Seen()
    for p in pages:
        seen.add(wrapper.text_hash(p), list(wrapper.named(seed, wrapper.outline(parse(p)))))
    return seed, seen.wrapper()


def test_simple_tree_matching():
    tree = lambda s: wrapper.outline(parse(s))
    a, b = tree("<div><h1>x</h1><p>a</p><p>b</p></div>"), tree("<div><h1>y</h1><i>new</i><p>c</p></div>")
    size, pairs = wrapper.matching(a.children[0], b.children[0])
    assert size == 3 and pairs == [(0, 0), (1, 2)]
    assert [n for n, _ in wrapper.named(a, b)] == ["0", "0.0", "0.0.0", "0.0/#text=", "0.0.1"]


TREES = st.recursive(st.sampled_from(["<p>x</p>", "<h2>y</h2>", "z"]), lambda c: st.lists(c, max_size=4).map(lambda x: f"<div>{''.join(x)}</div>"), max_leaves=14)


@settings(max_examples=200, deadline=None)
@given(TREES, TREES)
def test_matching_is_the_largest(left, right):
    a, b = wrapper.outline(parse(left)), wrapper.outline(parse(right))

    def largest(x, y):
        """By trying all order-preserving matchings."""
        if x.label != y.label:
            return 0
        go = lambda i, j: 0 if i == len(x.children) or j == len(y.children) else max(
            go(i + 1, j), go(i, j + 1), (w + go(i + 1, j + 1)) if (w := largest(x.children[i], y.children[j])) else 0
        )
        return 1 + go(0, 0)

    assert wrapper.matching(a, b)[0] == largest(a, b)
    names = dict(wrapper.named(a, b))
    assert sum("/" not in n for n in names) == largest(a, b)


def most_matched(a, b):
    """The largest matching by the plain dynamic program over all pairs of nodes."""
    if a.label != b.label:
        return 0
    row = [0] * (len(b.children) + 1)
    for x in a.children:
        new = [0]
        for j, y in enumerate(b.children):
            new.append(max(row[j + 1], new[j], row[j] + most_matched(x, y)))
        row = new
    return 1 + row[-1]


def random_page(rng, n):
    """A nested page of ``n`` containers with leaves of a few kinds."""
    children = {0: []}
    for i in range(1, n):
        children[i] = []
        children[int(rng.integers(max(0, i - 1 - rng.integers(0, 12)), i))].append(i)

    def shown(i):
        return f"<{'div' if i % 3 else 'ul'}>" + "".join(f"<{t}>w</{t}>" for t in rng.choice(["p", "h2", "li"], rng.integers(1, 4))) + "".join(map(shown, children[i])) + f"</{'div' if i % 3 else 'ul'}>"

    return shown(0)


@pytest.mark.parametrize("small,held", [(1 << 12, 1 << 22), (4, 1 << 22), (4, 6)])
def test_long_lists_and_random_pages_match_most(monkeypatch, small, held):
    monkeypatch.setattr(wrapper, "SMALL", small)
    monkeypatch.setattr(wrapper, "HELD", held)
    rng = np.random.default_rng(8)
    blocks = lambda n: "<main>" + "".join(f"<div><h2>t</h2>{'<p>a</p><ul><li>b</li></ul>' * int(rng.integers(0, 4))}{'<pre>c</pre>' if rng.random() < 0.3 else ''}</div>" for _ in range(n)) + "</main>"
    pages = [(blocks(36), blocks(40)), (blocks(3), blocks(60))] + [(random_page(rng, 25), random_page(rng, 30)) for _ in range(25)]
    for left, right in pages:
        a, b = wrapper.outline(parse(left)), wrapper.outline(parse(right))
        size, pairs = wrapper.matching(a, b)
        assert size == most_matched(a, b) == sum("/" not in n for n, _ in wrapper.named(a, b))
        assert all(p < q and r < t for (p, r), (q, t) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("n,seconds,random", [(3_000, 0.8, False), (30_000, 8, False), (3_000, 4, True)])
def test_large_nested_pages_match_in_time(n, seconds, random):
    """Nested lists of items of different lengths, and random ones without two equal parts to speak of; on a slow machine."""
    rng = np.random.default_rng(n)

    def nested(size, depth):
        if size <= 3 or depth > 9:
            return "".join(f"<{t}>w</{t}>" for t in rng.choice(["p", "h2", "pre"], max(1, size)))
        parts = rng.multinomial(size - 1, rng.dirichlet(np.ones(int(rng.integers(2, 9)))))
        return "".join(f"<ul><li>{nested(int(k), depth + 1)}</li></ul>" for k in parts if k)

    def lists(size):
        item = lambda: "<li><p>w</p>" + "".join(f"<ul><li><p>x</p>{'<pre>y</pre>' * (k % 2)}<h2>z</h2></li></ul>" for k in rng.integers(0, 4, int(rng.integers(1, 5)))) + "</li>"
        return "<ul>" + "".join(item() for _ in range(size // 12)) + "</ul>"

    a, b = (wrapper.outline(parse(f"<div>{nested(n, 0) if random else lists(n)}</div>")) for _ in range(2))
    began = time.process_time()
    names = list(wrapper.named(a, b))
    assert time.process_time() - began < seconds and sum("/" not in x for x, _ in names) > 100


def test_template_needs_three_pages_of_a_node():
    pages = [f"<body><article><h1>Title {i}</h1><p>Text {i} of this page.</p><p class=src>Source: <a>place {i}</a></p></article></body>" for i in range(5)]
    pages.append("<body><article><h1>Last</h1><p>First words.</p><h2>Results</h2><blockquote>Shown once.</blockquote></article></body>")
    seed, known = whole(pages)
    found = [wrapper.extract(p, seed, wrapper.Wrapper.load(known.dump())) for p in pages]
    assert "Results" in found[5] and "Shown once." in found[5]
    assert all(f"place {i}" in found[i] and "Source:" not in found[i] for i in range(5))


def test_constant_line_beside_varying_ones_is_template():
    """A constant paragraph among paragraphs of the same label, at another place on each page."""
    pages = [f"<body><article><h1>T {i}</h1>" + "".join(f"<p>{w} {i}</p>" for w in "abcdefg"[: i + 1]) + "<p>Read more on our site.</p></article></body>" for i in range(6)]
    seed, known = whole(pages)
    for i, p in enumerate(pages):
        assert wrapper.extract(p, seed, known) == "\n\n".join([f"T {i}", *(f"{w} {i}" for w in "abcdefg"[: i + 1])])


def test_near_copies_are_no_template():
    """Text that a few of many pages share is content."""
    pages = [f"<body><article><h1>T {i}</h1><p>{'shared words' if i < 4 else f'own words {i}'}</p></article></body>" for i in range(20)]
    seed, known = whole(pages)
    assert wrapper.extract(pages[0], seed, known) == "T 0\n\nshared words"


def test_wide_pages_lose_nothing():
    """Pages of thousands of different nodes: all are kept, whatever the order."""
    pages = [f"<body><div>menu {k}</div><div><h1>T {k}</h1>" + "".join(f"<p class=c{i % 3}{'x' * (i % 7)}>p {k} {i}</p><h2>h {k} {i}</h2>" for i in range(1500)) + "</div></body>" for k in range(4)]
    found = []
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        seed, seen = wrapper.seed_tree(pages[0]), wrapper.Seen()
        for k in order:
            seen.add(k, list(wrapper.named(seed, wrapper.outline(parse(pages[k])))))
        found.append(seen.wrapper())
    assert found[0].dump() == found[1].dump()
    for k, p in enumerate(pages):
        text = wrapper.extract(p, seed, found[0])
        assert text.count("\n\n") == 3000 and f"p {k} 1499" in text and "menu" not in text


def test_deep_pages():
    page = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>more</p>"
    assert wrapper.extract(page, None, None) == "deep\n\nmore"


DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables aren't here")
def test_induction_finds_the_article_without_names_and_marks(spark):
    """Pages whose articles are plain divs without classes: hosts of three pages or more are read as before, by induction."""
    pages = spark.read.parquet(DATA)
    plain = F.regexp_replace(F.regexp_replace("html", "(</?)(?:article|main)\\b", "$1div"), ' class="[^"]*"', "")
    texts = lambda df, **how: {r["page_id"]: r["text"] for r in wrapper.main_texts(df, **how).collect()}
    # brute force: the article's element as a plain search finds it, tags taken out, block by block
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = "\n\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", inner)) if b)
    assert texts(pages) == want
    hosts = Counter(r["url"].split("/")[2] for r in pages.select("url").collect())
    of = {r["page_id"]: hosts[r["url"].split("/")[2]] for r in pages.select("page_id", "url").collect()}
    many = [i for i in want if of[i] >= 3]
    bare = pages.withColumn("html", plain)
    with_, without = texts(bare), texts(bare, induced=False)
    assert len(many) > 100 and sum(with_[i] == want[i] for i in many) >= 0.97 * len(many)
    assert sum(without[i] != with_[i] for i in many) > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables aren't here")
def test_induction_needs_no_list_of_words(spark, monkeypatch):
    """With no element or word to leave out, menus, footers and the like go because they are a host's template or outside of its region."""
    monkeypatch.setattr(wrapper, "DROPPED", frozenset(("script", "style", "head", "title")))
    monkeypatch.setattr(wrapper, "MARKS", frozenset())
    pages = [(r["page_id"], r["url"].split("/")[2], r["html"]) for r in spark.read.parquet(DATA).collect()]
    hosts = Counter(h for _, h, _ in pages)
    of = {h: [p for _, at, p in pages if at == h] for h, n in hosts.items() if n >= 5}
    right = total = 0
    for some in of.values():
        seed, known = whole(some)
        for p in some:
            inner = re.search(r"<article>(.*?)</article>", p, re.S)[1]
            want = "\n\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", inner)) if b)
            total += 1
            right += wrapper.extract(p, seed, known) == want
    assert total > 50 and right >= 0.9 * total

from collections import deque

import pytest
from pyspark.sql import functions as F

from runledger.operators import corpus
from runledger.sources.wiki import read_wiki_xml

DUMP = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>B</title><id>7</id><revision><id>70</id><text>'''Bold''' [[A|the a]] and [[C]].
== Head ==
{{box|x}}<ref>no</ref> a &amp; b</text></revision></page>
<page><title>A</title><id>3</id><revision><id>30</id><text>see [[B#top|b]] [[B]]</text></revision></page>
</mediawiki>"""


def test_edges_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "EDGES_PER_TASK", 50, raising=False)
    edges = spark.range(600).selectExpr("concat('n', id % 100) as src", "concat('m', id div 100) as dst").unionByName(
        spark.range(300).selectExpr("'n0' as src", "'m0' as dst"))
    lists = corpus.adjacency(edges, neighbours_per_row=4)
    assert lists.rdd.getNumPartitions() == 18
    found = [(r.node, n) for r in lists.collect() for n in r.neighbours]
    assert sorted(found) == sorted({(r.src, r.dst) for r in edges.collect()})


def test_wiki_pipeline(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    pages = read_wiki_xml(spark, str(tmp_path / "dump.xml"), partitions=2)
    plain = {r.title: r.plain for r in corpus.plain_text(pages).collect()}
    assert plain == {"B": "Bold the a and C. Head a & b", "A": "see b B"}
    numbers = corpus.doc_numbers(pages)
    assert {r.page_id: r.docno for r in numbers.collect()} == {3: 1, 7: 2}
    packed = corpus.repack(pages, numbers)
    assert {r.docno: r.title for r in packed.collect()} == {1: "A", 2: "B"}
    edges = corpus.link_edges(pages, corpus.WIKI_LINK, "title")
    assert sorted(map(tuple, edges.collect())) == [("A", "B"), ("B", "A"), ("B", "C")]
    encoded = corpus.bfs_encode(corpus.adjacency(edges), "A").collect()
    assert {(r.node, r.part, tuple(r.neighbours), r.dist) for r in encoded} == {
        ("A", 0, ("B",), 0), ("B", 0, ("A", "C"), None)}


def test_links_inside_links(spark):
    pages = spark.createDataFrame([("t", "[[File:a|b [[c#d|e]] [[f]]]] [[g|{{h|[[i]]}}]] [[open")], "title string, text string")
    assert sorted(r.dst for r in corpus.link_edges(pages, corpus.WIKI_LINK, "title").collect()) == ["File:a", "c", "f", "g", "i"]


def test_html(spark):
    pages = spark.createDataFrame(
        [("<p>a<SCRIPT>x<y</SCRIPT><!-- <b> -->&lt;b&gt; &amp;lt;<style>p{}</style>c</p>",)],
        "text string")
    assert corpus.plain_text(pages, "html").first().plain == "a <b> &lt; c"
    with pytest.raises(ValueError, match="markup"):
        corpus.plain_text(pages, "tex")


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_hubs_are_cut_and_stay_whole(spark, limit):
    pairs = [("hub", i) for i in range(95)] + [("leaf", 1), ("leaf", 1), ("leaf", 0)]
    edges = spark.createDataFrame(pairs, "src string, dst int")
    rows = corpus.adjacency(edges, neighbours_per_row=10, limit=limit).collect()
    hub = [r for r in rows if r.node == "hub"]
    assert len(hub) > 5 and max(len(r.neighbours) for r in hub) < 40
    assert sorted(n for r in hub for n in r.neighbours) == list(range(95))
    assert all(r.neighbours == sorted(r.neighbours) for r in rows)
    assert [(r.part, r.neighbours) for r in rows if r.node == "leaf"] == [(0, [0, 1])]


def test_bfs_against_a_queue(spark):
    pairs = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, (i * i) % 50) for i in range(50)]
    pairs += [(100, 101)]
    near, queue = {12: 0}, deque([12])
    while queue:
        node = queue.popleft()
        for src, dst in pairs:
            if src == node and dst not in near:
                near[dst] = near[node] + 1
                queue.append(dst)
    edges = spark.createDataFrame(pairs, "src int, dst int")
    for options in ({"limit": 0, "few": 0}, {"few": 3, "hubs": 60}):
        assert {r.node: r.dist for r in corpus.bfs(edges, 12, **options).collect()} == near
    assert [tuple(r) for r in corpus.bfs(edges, 77).collect()] == [(77, 0)]
    odd = spark.createDataFrame([(12, None), (None, 12), (12, 13), (12, 13), (13, 12)], "src int, dst int")
    assert sorted(tuple(r) for r in corpus.bfs(odd, 12).collect()) == [(12, 0), (13, 1)]
    two = {k: v for k, v in near.items() if v <= 2}
    assert {r.node: r.dist for r in corpus.bfs(edges, 12, max_iter=2).collect()} == two


@pytest.mark.parametrize("text, plain", [
    ("a {{x {{y {{z}} q}} r}} b", "a b"),
    ("a {{x {{y {{z {{w}}}}}} q}} b {{c}}d", "a b d"),
    ("open {{ stays and {{goes}} on", "open {{ stays and on"),
    ("close }} stays", "close }} stays"),
    ("{{a\nb}}c", "c"), ("", ""), (None, None),
    ("[[File:a.jpg|thumb|A [[link]] in [[b|the {{t}} caption]]]] x [[Image:b|[[c]]]]y", "x y"),
    ("[[a|b [[c|d]] e]] [[f [[g]]]]", "b d e f g"),
    ("a {| b {| c {{d|{| e |}}} |} f |} g", "a g"),
    ("{{a|}} b {{c|{| d |}}} e {{{1|}}} f", "b e f"),
    ('a<ref name="b/c">d</ref>e<ref name="f/"/>g<REF>h {{i}} [[j]]</ref >k', "a e g k"),
    ('a<ref name="b>c">d</ref>e <references/>f<ref name="g>/"/>h', "a e f h"),
    ("a [[b {{c]] d}} e", "a b {{c d}} e"),
    ("a {{b [[c}} d]] e", "a d]] e"),
    ("[[open a {| b {{c}}", "[[open a {| b"),
    ("]] close |} }} a", "]] close |} }} a"),
    ("[[" * 40 + "x" + "]]" * 40, "x"),
])
def test_brackets_of_any_depth(spark, text, plain):
    pages = spark.createDataFrame([(text,)], "text string")
    assert corpus.plain_text(pages).first().plain == plain


def test_bfs_on_a_long_path(spark, monkeypatch):
    """Known nodes stand in few tables whatever the number of rounds."""
    held = []
    compact = corpus._compacted
    monkeypatch.setattr(corpus, "_compacted", lambda tables, limit: held.append(len(tables)) or compact(tables, limit))
    edges = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.node: r.dist for r in corpus.bfs(edges, 0).collect()} == {i: i for i in range(13)}
    assert len(held) == 12 and max(held) <= corpus.TABLES_KEPT + 2


def test_bfs_from_a_hub(spark):
    """A node with a third of all edges is searched by its own spread table."""
    pairs = [(0, i) for i in range(1, 500)] + [(i, i + 1000) for i in range(1, 500)] + [(i, 0) for i in range(1, 500)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    found = {r.node: r.dist for r in corpus.bfs(edges, 7).collect()}
    assert found == {7: 0, 0: 1, 1007: 1} | {i: 2 for i in range(1, 500) if i != 7} | {i + 1000: 3 for i in range(1, 500) if i != 7}


def test_bfs_rounds_leave_edges_and_known_nodes_in_place(spark, monkeypatch):
    """Beyond the broadcast limit only the nodes that a round reaches are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, written = [], corpus.materialise

    def keep(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, label)
    monkeypatch.setattr(corpus, "materialise", keep)
    edges = spark.range(3000).select((F.col("id") % 50).cast("int").alias("src"), (F.col("id") * 7 % 400).cast("int").alias("dst"))
    try:
        corpus.bfs(edges, 1, limit=0, few=0, hubs=4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [plan for label, plan in plans if label.startswith("bfs-") and label[4:].isdigit() and label != "bfs-0"]
    assert len(rounds) > 3
    for number, plan in enumerate(rounds, 1):
        assert plan.count("Exchange") == 1, plan
        assert plan.count("Bucketed: true") == 2 + number, plan

"""Properties and fixtures of the library's operators beyond their SQL."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithic import vocab
from lithic.engine import Engine, QueryError
from lithic.functions import ids, text
from lithic.operators import answers, communities, retrieval, split, versions
from lithic.plans import q_graph, q_plane
from lithic.sources import config
from lithic.streaming import changes

PIECES = st.sampled_from(["# A\n", "## B\n", "Title\n===\n", "```\n", "~~~\n", "\n", "text. ", "more words here!\n", "é日本\n", "A_X=1\n", "B=2\n", "---\n", "= T\n", "x" * 700, "y. " * 900])


@given(st.lists(PIECES, max_size=25), st.booleans())
@settings(max_examples=200, deadline=None)
def test_passages_tile(parts, adoc):
    doc = "".join(parts)
    got = split.split(doc, adoc)
    assert "".join(p["body"] for p in got) == doc
    assert [p["ordinal"] for p in got] == list(range(len(got)))
    assert all(p["end"] - p["start"] <= 6000 for p in got)
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert got == split.split(doc, adoc)


def test_passage_rules():
    fence = "# A\n" + "intro words. " * 40 + "\n\n```\n# not a heading\nX_A=1\nX_B=2\nY=1\nZ_Q=3\n```\n\ntail\n"
    got = split.split(fence)
    assert [p["heading"] for p in got] == ["A"] * len(got) and any(p["body"].startswith("X_A=1\nX_B=2\n") for p in got)
    assert split.split("") == []
    assert [p["heading_path"] for p in split.split("# A\n" + "a " * 300 + "\n## B\n" + "b " * 300 + "\n# C\n" + "c " * 300)] == [["A"], ["A", "B"], ["C"]]
    assert split.split("---\n# x\n---\n" + "w " * 300 + "\n# Y\nz")[-1]["heading"] in ("Y", "")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_slugs(spark):
    cases = {"code.lan/team/forge": "code-lan-team-forge", "docs.lan": "docs-lan", "/srv/trees/oak": "oak", "./lib": "lib", "///upper/": "upper", "moss@v2.0": "moss-v2-0", "https://code.lan/a/b.git": "code-lan-a-b"}
    for a, b in cases.items():
        assert one(spark, ids.system_slug(F.lit(a))) == b
    assert 0 < len(one(spark, ids.system_slug(F.lit("a" * 120)))) <= 80
    inst = {"topic/login": "topic-login", "a///..b": "a-b", "_first": "first", "last_": "last", "KeepsCase": "KeepsCase"}
    for a, b in inst.items():
        assert one(spark, ids.sanitize_instance(F.lit(a))) == b
    assert one(spark, ids.canonical_url(F.lit("HTTPS://Docs.LAN/Trees/?a=b#c"))) == "https://docs.lan/Trees"
    seg = one(spark, ids.sanitize_segment(F.lit("+leaf")))
    assert seg != one(spark, ids.sanitize_segment(F.lit("leaf"))) and one(spark, ids.sanitize_segment(F.lit(seg))) == seg
    assert one(spark, text.section_anchor(F.lit("Sow & Reap Rules"))) == "sow--reap-rules" and one(spark, text.section_anchor(F.lit("日本語 見出し"))) == "日本語-見出し"


def test_version_order(spark):
    want = ["v1.9.0", "v1.9.5-rc.1", "v1.9.5", "v1.10.0", "alpha", "beta", "build7", "build07x", "build9", "r2023b", "r2024a"]
    got = spark.createDataFrame([(v,) for v in reversed(want)], "v string").orderBy(text.version_key(F.col("v"))).collect()
    assert [r.v for r in got] == want


def test_impact_survives_cycles(spark):
    e = spark.createDataFrame([("b", vocab.IMPACT[0], "a"), ("c", vocab.IMPACT[0], "b"), ("a", vocab.IMPACT[0], "c"), ("d", "code.structure.contains", "a")], "src string, predicate string, dst string")
    got = retrieval.impact(spark.createDataFrame([("a",)], "id string"), e).collect()
    assert {(r.id, r.depth) for r in got} == {("b", 1), ("c", 2)}


def test_paths_have_no_limit_of_rows(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = retrieval.paths(spark.createDataFrame([("a",), ("x",)], "id string"), e, 3)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a>b", 1), ("a", "a>b>a", 2), ("a", "a>b>a>b", 3), ("a", "a>b>c", 2)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", 2000)
    try:
        assert q_graph.graph_paths(spark, "/root/testdata/sf0.001").count() == 3 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() > 2000
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_build_files_are_parsed_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    files = spark.createDataFrame([("f", "<project><artifactId>a</artifactId><dependencies><dependency><groupId> g </groupId><artifactId>x</artifactId></dependency></dependencies></project>"), ("g", "no xml"), ("h", None)], "file string, text string")
    assert [plan(f(files)).count("from_xml") for f in (config.pom, config.pom_project)] == [1, 1] and plan(config.package_json(files)).count("from_json") == 2
    assert plan(q_plane.config_maven_triples(spark, "/root/testdata/sf0.001")).count("from_xml") == 0
    assert [tuple(r) for r in config.pom(files).where("file = 'f'").collect()] == [("f", "g", "x", "", "compile")]
    assert [tuple(r)[1:5] for r in config.pom_project(files).where("file = 'f'").collect()] == [("", "a", "", "")]


def test_instances_of_long_texts(spark):
    """Equal to the rule by the whole text, whose passes over it are not in the plan any more."""
    import hashlib
    import random
    import re

    def whole(t: str) -> str:
        out = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", re.sub("-{2,}", "-", re.sub("[^A-Za-z0-9_-]", "-", t)))
        h = hashlib.sha256(t.encode()).hexdigest()[:8]
        return h if out == "" else re.sub("[^A-Za-z0-9]+$", "", out[:51]) + "-" + h if len(out) > 60 else out

    r = random.Random(5)
    cases = ["", "___", "-_-", "\n" * 9, "é" * 70, "a" * 60, "a" * 61, "a" * 60 + "_" * 9, "a" * 60 + "-_" * 999 + "b", "_" * 999 + "a b", "a" + " " * 99_999 + "b", "a" * 50 + "_" * 20, "a" * 50 + "_" * 20 + "z", "ab😀" * 40]
    cases += ["".join(r.choice("aB3__--  é\n") for _ in range(r.randrange(50, 90))) + r.choice(["", "_" * 30, " \n", "-x"]) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", ids.sanitize_instance(F.col("t")).alias("got"))
    assert [x.got for x in df.collect()] == [whole(c) for c in cases]
    assert "regexp_replace(t#" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.range(1).select(ids.sanitize_instance(F.lit(None).cast("string")).alias("x")).first().x is None


def test_triples_are_dealt_out_before_they_are_sorted(spark):
    t = spark.createDataFrame([("a", 1, "dc.terms.title", "second"), ("a", 0, "dc.terms.title", "first"), ("a", 2, "code.metric.start-line", "7"), ("b", 0, "dc.terms.title", "b")], "subject string, ord int, predicate string, object string")
    for df in (answers.nodes(t, "code"), versions.candidates(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and plan.index("Sort [") < plan.index("Exchange")
    assert {(r.id, r.label, r.first) for r in answers.nodes(t, "code").collect()} == {("a", "first", 7), ("b", "b", 0)}


def test_body_budget_is_greedy(spark):
    rows = spark.createDataFrame([(1, 60), (2, 60), (3, 30)], "n long, size long")
    assert [r.n for r in versions.within_budget(rows, ["n"], "size", 100).collect()] == [1, 3]


def test_a_budget_leaves_its_input_in_many_tasks(spark):
    ran = spark.range(0, 40, 1, 8).withColumn("size", F.lit(1)).repartition(4, "id").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len({r.task for r in versions.within_budget(ran, ["id"], "size", 100).collect()}) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    side = lambda v, size: [("o", "p", f"f{i}", "n", "c", "k", v, size, "hash", i, f"{v}{i}") for i in range(5)]
    cands = spark.createDataFrame(side("1", "x") + side("2", "y"), "org string, project string, path string, name string, ctype string, pkg string, version string, body_hash string, body_hash_kind string, indexed_at int, id string")
    ch = versions.diff(cands, "p", "1", "2")
    sizes = ch.select(*versions.KEY, F.when(F.col("path") != "f1", F.substring("path", 2, 1).cast("int") * 10).alias("size"))
    assert tuple(versions.diff_counters(ch, sizes, 4, 25).first()) == (4, 1, 2, 1, 1)


def test_engine(spark):
    ent = spark.createDataFrame([("a.golang.f", "golang", "Run", "function"), ("a.golang.g", "golang", "run", "function")], "id string, domain string, name string, kind string")
    e = Engine(spark, ent, spark.createDataFrame([("a.golang.g", vocab.IMPACT[0], "a.golang.f"), ("a.golang.g", vocab.IMPACT[0], "gone")], "src string, predicate string, dst string"),
               spark.createDataFrame([("a.golang.f", "code.artifact.exported")], "subject string, predicate string"), spark.createDataFrame([("a.golang.f", "func Run() does things")], "id string, text string"))
    assert [r.id for r in e.context("Run").collect()] == ["a.golang.f", "a.golang.g"]
    assert [r.id for r in e.impact("Run").where("seed = 'a.golang.f'").collect()] == ["a.golang.g"]
    assert [r.id for r in e.context("does things").collect()] == ["a.golang.f"]
    try:
        e.seeds("  ")
        raise AssertionError
    except QueryError as x:
        assert x.code == "INVALID_QUERY" and not x.retryable


def test_streams(spark, tmp_path):
    rows = [("p", 1, "2024-01-01 00:00:00", "write", "h1"), ("p", 2, "2024-01-01 00:00:01", "write", "h1"), ("q", 3, "2024-01-01 00:00:02", "write", "x"), ("p", 4, "2024-01-01 00:00:03", "write", "h2"), ("p", 5, "2024-01-01 00:00:04", "delete", None)]
    df = spark.createDataFrame(rows, "path string, event_id long, t string, op string, hash string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = changes.event_stream(spark, str(tmp_path / "in"), df.schema)
    q = changes.suppress_unchanged(s).writeStream.format("memory").queryName("supp").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.path, r.event_id, r.change) for r in spark.table("supp").collect()} == {("p", 1, "create"), ("q", 3, "create"), ("p", 4, "modify"), ("p", 5, "delete")}
    m = s.select(F.col("path").alias("id"), F.col("op").alias("payload"), "ts")
    q = changes.deduplicated(m).writeStream.format("memory").queryName("dd").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == 3
    sink = changes.upsert(str(tmp_path / "out"), ["path"])
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    sink(spark.createDataFrame([("q", 9, "write", "y", None)], df.schema.simpleString().removeprefix("struct<").removesuffix(">")), 7)
    got = changes.read_upserted(spark, str(tmp_path / "out"))
    assert {r.event_id for r in got.where("path = 'q'").collect()} == {9} and got.where("path = 'p'").count() == 4


def test_cosine_of_many_queries(spark):
    v = spark.range(10_050).selectExpr("id", "array(double(id % 97), double(id % 89 + 1)) AS embedding")
    few = v.where("id < 5")
    got = retrieval.cosine(few, v, 2)
    assert got.groupBy("query").count().where("count = 2").count() == 10_050
    some = got.where("query % 1000 = 7").select("query", "id", "score", "rank")
    assert sorted(some.collect()) == sorted(retrieval.cosine(few, v.where("id % 1000 = 7"), 2).select("query", "id", "score", "rank").collect())


def test_prefix_scan_is_whole(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "concat('src', 1 + id % 2) AS source").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_graph.prefix_scan_whole(spark, str(tmp_path)).collect()
    assert [r.id for r in got] == sorted(f"acme.web.src1.{i}" for i in range(0, 100, 2)) and not any(r.truncated for r in got)
    assert {r.truncated for r in q_graph.prefix_scan(spark, str(tmp_path)).collect()} == {True}


def test_community_labels_has_both_kinds_of_peers(spark, tmp_path, monkeypatch):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("orders", [(1, 1)], "o_orderkey long, o_custkey long")
    put("customer", [(1, 1)], "c_custkey long, c_nationkey long")
    put("nation", [(1, 1), (2, 1), (3, 2)], "n_nationkey long, n_regionkey long")
    put("supplier", [(1, 1), (2, 1), (3, 2), (4, 3)], "s_suppkey long, s_nationkey long")
    monkeypatch.setattr(q_graph.communities, "label_propagation", lambda edges: edges)
    got = {(r.a, r.b, r.w) for r in q_graph.community_labels(spark, str(tmp_path)).where("w < 1").collect()}
    assert got == {("s1", "s2", 0.7), ("s1", "s2", 0.3), ("s1", "s3", 0.3), ("s2", "s3", 0.3)}


def test_ring_over_block_edges(spark):
    groups = {None: 7, "x": 40, "y": 1, "z": 3}
    rows = [(f"{g}{i:03d}", g) for g, n in groups.items() for i in range(n)] + [("x005", "x")]
    df = spark.createDataFrame(rows, "id string, kind string")
    want = []
    for g in groups:
        held = sorted(i for i, k in rows if k == g)
        want += [(a, b) for at, a in enumerate(held) for b in held[at + 1 : at + 4]]
    for block in (3, 5, 1 << 16):
        assert sorted((r.a, r.b) for r in communities.ring(df.repartition(5), "kind", 0.5, 3, block).collect()) == sorted(want)
    assert communities.ring(df.where("false"), "kind", 0.5, 3).count() == 0


def propagated(edges, rounds):
    """Label propagation as plain loops: repeated edges count once by their most weight, both ways; no loops."""
    near = {}
    for a, b, w in edges:
        if a != b:
            for p, q in ((a, b), (b, a)):
                near.setdefault(p, {})[q] = max(w, near.get(p, {}).get(q, 0))
    labels = {n: n for n in near}
    for _ in range(rounds):
        new = {}
        for n, around in near.items():
            votes = {}
            for m, w in around.items():
                votes[labels[m]] = votes.get(labels[m], 0) + w
            new[n] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        if new == labels:
            break
        labels = new
    return labels


def test_label_propagation_against_loops(spark):
    edges = [(f"n{i}", f"n{(i * 7 + k) % 40}", 1.0 + (i * k) % 3 / 2) for i in range(40) for k in (1, 2, 5)] + [("n1", "n1", 9.0), ("n2", "n3", 0.5), ("n2", "n3", 0.5), ("p", "q", 0.3)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    for rounds in (1, 4):
        assert {r.id: r.community for r in communities.label_propagation(df, rounds).collect()} == propagated(edges, rounds)
    assert communities.label_propagation(df.where("false")).count() == 0

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fx
from graphloom.functions.regex import is_literal, to_jvm
from graphloom.model import InvalidPattern, InvalidSchema, NodeNotFound
from graphloom.operators import filters, graph, lint, merge
from graphloom.operators import schema as schemas
from graphloom.operators.grep import fit_window, grep
from graphloom.sources import relational


def edges(spark, pairs):
    return spark.createDataFrame([(a, p, b) for a, p, b in ((x + ("e",) if len(x) == 2 else x)[0:1] + (x[2] if len(x) > 2 else "e", x[1]) for x in pairs)], "src string, predicate string, dst string")


def nodes(spark, ids, types=None):
    return spark.createDataFrame([(i, (types or {}).get(i, "T")) for i in ids], "id string, type string")


def members(found):
    return {(r["id"], r["part"]) for r in found.members.collect()}


def test_hub_cap(spark):
    e = edges(spark, [(f"P{i}", "H") for i in range(1, 6)] + [("P1", "x"), ("P1", "y"), ("P2", "x")])
    found = graph.subgraph(nodes(spark, ["H", *(f"P{i}" for i in range(1, 6))]), e, "H", 1, backlink_cap=2)
    assert members(found) == {("H", "seed"), ("P1", "backlink"), ("P2", "backlink")}
    assert (found.backlinks, found.backlinks_truncated, found.direct_truncated) == (5, True, False)


def test_chain_stubs_cycle_dangling_and_missing(spark):
    n, e = nodes(spark, "ABCD"), edges(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("D", "gone"), ("B", "A")])
    assert members(graph.subgraph(n, e, "A", 1)) == {("A", "seed"), ("B", "direct")}
    assert members(graph.subgraph(n, e, "A", 1, stubs=True)) == {("A", "seed"), ("B", "direct"), ("C", "stub")}
    assert members(graph.subgraph(n, e, "D", 0, stubs=True)) == {("D", "seed")}
    assert {r["id"] for r in graph.bfs(e, n, n.where("id = 'A'"), 9).collect()} == set("BCD")
    with pytest.raises(NodeNotFound):
        graph.subgraph(n, e, "Z")
    with pytest.raises(ValueError):
        graph.subgraph(n, e, "A", -1)


def test_filter_is_after_traversal_and_spares_the_seed(spark):
    n, e = nodes(spark, "AXB", {"X": "U", "A": "S"}), edges(spark, [("A", "X"), ("X", "B")])
    assert members(graph.subgraph(n, e, "A", 2, keep=F.col("type") == "T")) == {("A", "seed"), ("B", "direct")}


def test_parallel_edges_count_in_degrees(spark):
    e = edges(spark, [("A", "B", "p"), ("A", "B", "q")])
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()} == {"A": 2, "B": 2}


def test_grep_lines(spark):
    docs = spark.createDataFrame([("a", "x term\r\nno\nterm term\n"), ("b", None), ("c", ""), ("d", "äterm")], "id string, raw string")
    got = [(r["id"], r["line"], r["text"], r["start"], r["end"]) for r in grep(docs, "term").orderBy("id", "line").collect()]
    assert got == [("a", 1, "x term", 2, 6), ("a", 3, "term term", 0, 4), ("d", 1, "äterm", 2, 6)]
    assert grep(docs, "t..m$").count() == 3
    assert [(r["start"], r["end"]) for r in grep(docs.where("id = 'd'"), "").collect()] == [(0, 0)]
    assert grep(docs, "[Ä]").count() == 0 and grep(docs, "(?i)[Ä]").count() == 1


@pytest.mark.parametrize("bad", ["(?=a)", r"(a)\1", "a++", "[a", "a(", "a\\", "(?<!x)y"])
def test_patterns_outside_the_dialect(spark, bad):
    with pytest.raises(InvalidPattern):
        to_jvm(bad)


def test_pattern_forms(spark):
    assert is_literal("a b") and not is_literal("a.b")
    one = spark.createDataFrame([("abc\n",), ("abc",)], "s string")
    assert one.where(F.col("s").rlike(to_jvm("abc$"))).count() == 1
    assert one.where(F.col("s").rlike(to_jvm("(?P<x>a)b"))).count() == 2


def test_window():
    assert fit_window("short", 0, 1, 10) == "short"
    made = fit_window("a" * 50 + "hit" + "b" * 50, 50, 53, 21)
    assert "hit" in made and made.startswith("…") and made.endswith("…")


def test_filters(spark):
    rows = [("s", "Source", {"tags": ["Ocean", "x"], "status": ["mature"]}), ("e", "Entity", {"tags": ["ocean"], "status": [None, "MATURE"]}), ("n", "Entity", {})]
    df = spark.createDataFrame(rows, "id string, type string, attrs map<string,array<string>>")
    ids = lambda f: {r["id"] for r in df.where(f.column()).collect()}
    assert ids(filters.Filter()) == {"s", "e", "n"}
    assert ids(filters.Filter(types=("entity",))) == set()
    assert ids(filters.Filter(tags=("OCEAN",))) == {"s", "e"} and ids(filters.Filter(tags=("ocean", "x"))) == {"s"}
    assert ids(filters.Filter.from_options(attrs=["status=mature"])) == {"s", "e"}
    assert ids(filters.Filter.from_options(attrs=["status~=^mat"])) == {"s"}
    assert filters.Filter.from_options(attrs=["a=1", "a=2", "b~=x=y"]) == filters.Filter(attrs={"a": "2"}, patterns={"b": "x=y"})
    with pytest.raises(ValueError):
        filters.Filter.from_options(attrs=["nothing"])


MARK = "<<<<<<< existing\nx\n=======\ny\n>>>>>>> d2"


@pytest.mark.parametrize(
    ("op", "e", "i", "value", "outcome"),
    [
        ("immutable", "x", "y", "x", "unchanged"),
        ("immutable", "", "y", "y", "filled"),
        ("lastWriteWin", "x", "y", "y", "overwritten"),
        ("firstWriteWin", "x", "y", MARK, "flagged"),
        ("firstWriteWin", MARK, "y", MARK, "flagged"),
        ("fillIfEmpty", "x", "y", MARK, "flagged"),
        ("validatedOverwrite", "x", "y", "x", "unchanged"),
        ("append", "p one two", "p three four", "p one two\n\np three four", "appended"),
        ("append", "a b c d e f g h i j k l m", "a b c d e f g h i j k l", "a b c d e f g h i j k l m", "unchanged"),
        ("append", "", "a\n\na", "a\n\na", "appended"),
    ],
)
def test_merge_text(spark, op, e, i, value, outcome):
    df = spark.createDataFrame([(e, i)], "e string, i string")
    made = merge.merge_text(op, F.col("e"), F.col("i"), F.lit("d2"))
    assert df.select(made.alias("v"), merge.outcome(op, F.col("e"), F.col("i"), made).alias("o")).first() == (value, outcome)


def test_exactly_the_threshold_is_new(spark):
    e, i = " ".join("abcdefghijk"), " ".join("abcdefghij")  # 9 runs and 8 of them
    df = spark.createDataFrame([(e, i)], "e string, i string")
    similar = df.select(fx.jaccard(fx.word_shingles(F.col("e")), fx.word_shingles(F.col("i")))).first()[0]
    assert similar == 8 / 9
    assert df.select(merge.merge_paragraphs(F.col("e"), F.col("i"), 8 / 9)).first()[0] == f"{e}\n\n{i}"


@pytest.mark.parametrize("op", merge.OPS)
def test_merge_laws(spark, op):
    rows = [(["a"], ["b"]), ([], ["b"]), (["a", "b"], ["a"]), (["a"], [])]
    df = spark.createDataFrame(rows, "e array<string>, i array<string>")
    once = merge.merge_values(op, F.col("e"), F.col("i"), F.lit("d2"))
    twice = merge.merge_values(op, once, F.col("i"), F.lit("d2"))
    assert df.where(once == twice).count() == len(rows)


def test_nested_markers(spark):
    rows = [("n", "k", s, f"d{s}", v) for s, v in enumerate("aba", 1)]
    df = spark.createDataFrame(rows, "id string, key string, seq int, source string, value string")
    got = merge.merge_scalars(df, "firstWriteWin").first()
    assert got["conflict"] and got["value"].count("<<<<<<<") == 2 and got["value"].endswith(">>>>>>> d3")


def test_marker_sides(spark):
    df = spark.createDataFrame([(MARK,)], "v string")
    assert df.select(merge.marker_existing(F.col("v")), merge.marker_incoming(F.col("v"))).first() == ("x", "y")


def test_inheritance():
    t = schemas.Type
    flat = schemas.effective({"Node": t("Node", required=("p",)), "A": t("A", optional=("p", "q")), "B": t("B", required=("q",), bases=("A",))})
    assert flat["B"].required == ("q", "p") and flat["B"].optional == () and flat["A"].optional == ("q",)
    for bad in ({"Node": t("Node"), "A": t("A", bases=("A",))}, {"Node": t("Node"), "A": t("A", bases=("B",)), "B": t("B", bases=("A",))}, {"Node": t("Node"), "A": t("A", bases=("Z",))}, {"A": t("A")}):
        with pytest.raises(InvalidSchema):
            schemas.effective(bad)


def test_seed():
    s = schemas.seed()
    s.check()
    assert len(s.predicates) == 54 and len(s.types) == 7
    assert "published" in schemas.effective(s.types)["Source"].required
    assert s.by_label()["Requires"] in ("required", "requires")
    assert s.register_type("New") and not s.register_type("New")
    assert s.register_predicate("seesAlso", "edge", "See also") and s.role_of("seesAlso") == "link"


def test_category(spark):
    df = spark.createDataFrame([("a", "Entity", ["independent", "physical", "continuant", "object"]), ("b", "Entity", ["independent"]), ("c", "Entity", None), ("d", "Entity", ["independent", "physical", "continuant", "thing"]), ("e", "Source", None)], "id string, type string, category array<string>")
    assert {r["id"] for r in lint.entity_category(df).collect()} == {"b", "c", "d"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Related  Aporias", "p:: [[T|A]] — note", "x [p:: [[T|A]]] y [[U]]")], "l string, i string, t string")
    got = df.select(fx.camelize(F.col("l")), fx.title_case(F.lit("éa")), fx.slugify(F.lit("-A b!")), fx.list_link(F.col("i")), fx.strip_links(F.col("t")), fx.inline_links(F.col("t")), fx.parse_date(F.lit("2031-05-09T01:02:03Z")).cast("string"), fx.parse_date(F.lit("soon"))).first()
    assert got[:3] == ("relatedAporias", "Éa", "a-b") and tuple(got[3]) == ("p", "T", "A") and got[4] == "x A y U"
    assert [tuple(x) for x in got[5]] == [("p", "T", "A"), ("", "U", "")] and got[6] == "2031-05-09 01:02:03" and got[7] is None


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        ("[[:digit:]]+", "QZK 42", True), ("^[[:alpha:]]+$", "QZK", True), ("[[:^alpha:]]", "QZK", False), (r"\Qa$b\E", "xa$b", True), (r"a\sb", "a\x0bb", False), (r"a\sb", "a\tb", True),
        (r"\v", "\x0b", True), (r"\v", "\n", False), ("(?m:a$)", "a\nb", True), ("a$", "a\n", False), (r"x\b", "xé", True), ("a{,2}", "a{,2}", True), (r"\x{41}\102", "AB", True), (r"[\d-]{3}", "1-2", True),
        ("(?P<n_a>k)", "k", True), (r"\p{Greek}", "λ", True), (r"[^\W_]", "_", False), ("[]a]", "]", True),
    ],
)
def test_dialect(spark, pattern, text, found):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(to_jvm(pattern)).alias("x")).first()["x"] is found


@pytest.mark.parametrize("pattern", ["a**", "a*+", "(?=x)", r"\1", r"\h", r"\R", r"\Z", "(?<=a)b", "a{2000}", "[a", "(a", "a)", "*a", r"\C", "(?U)a", "[[:nope:]]", "\\"])
def test_dialect_refusals(spark, pattern):
    with pytest.raises(InvalidPattern):
        to_jvm(pattern)


def test_adjacency_is_the_graph_of_its_edges(spark, tmp_path, monkeypatch):
    import random

    from graphloom.operators import graph

    r = random.Random(6)
    rows = [(f"n{r.randrange(30)}", "p", f"n{r.randrange(34)}") for _ in range(70)] + [("n1", "q", f"n{i}") for i in range(30)] * 2  # a hub, parallel edges, targets without a node
    edges = spark.createDataFrame(rows, "src string, predicate string, dst string")
    nodes = spark.createDataFrame([(f"n{i}", "T" if i % 2 else "U") for i in range(30)], "id string, type string")
    calls = []
    laid = graph.Adjacency(spark, f"file://{tmp_path}/a", lambda: calls.append(1) or edges, lambda: nodes)
    ids = lambda df: sorted(tuple(x) for x in df.collect())
    for most in (500, 2):
        monkeypatch.setattr(graph, "SOUGHT", most)
        for backward in (False, True):
            for seed in ("n1", "n7"):
                start = spark.createDataFrame([(seed,)], "id string")
                assert ids(graph.bfs(laid, None, start, 3, backward)) == ids(graph.bfs(edges, nodes, start, 3, backward))
        keep = graph.F.col("type") == "T"
        one, two = (graph.subgraph(n, e, "n1", 1, 7, 3, keep, True) for n, e in ((None, laid), (nodes, edges)))
        assert ids(one.members) == ids(two.members) and (one.direct, one.backlinks, one.direct_truncated) == (two.direct, two.backlinks, two.direct_truncated)
        assert ids(laid.table("degrees").drop("bucket").select("id", "out_degree", "in_degree", "degree")) == ids(graph.degrees(edges))
    assert len(calls) == 2  # each side was made once
    plan = laid.of("out", spark.createDataFrame([("n1",)], "id string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(id)" in plan


def test_single_searches_lay_nothing_out(spark, monkeypatch):
    from graphloom.plans import queries

    def refuse(*_):
        raise AssertionError("a layout of the whole graph for one search")

    monkeypatch.setattr(queries.graph, "Adjacency", refuse)
    monkeypatch.setattr(queries.graph, "isinstance", lambda x, t: t is not refuse and isinstance(x, t), raising=False)
    for name in ("subgraph_capped", "subgraph_filter_after_cap", "boundary_stubs"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_ends_are_counted_in_one_shuffle(spark):
    ends = relational.ends(spark, "/root/testdata/sf0.001")
    assert ends.count() == ends.select("id").distinct().count()
    assert ends._jdf.queryExecution().toString().partition("== Physical Plan ==")[2].count("Exchange hashpartitioning") == 1


def test_lines_of_violations_are_counted_before_their_place(spark):
    docs = spark.createDataFrame([("a", "---\nö: é\nkey: 1\n---\nSee [[x]]\nand [[é|b]]"), ("n", None)], "id string, raw string")
    found = [("linkResolves", "a", "x"), ("linkResolves", "a", "é"), ("typeOptional", "a", "key"), ("frontMatter", "a", "1\n---"), ("frontMatter", "a", None), ("linkResolves", "n", "x"), ("linkResolves", "z", "x")]
    out = lint.located(spark.createDataFrame(found, "rule string, id string, detail string"), docs)
    assert {(r["rule"], r["id"], r["detail"]): r["line"] for r in out.collect()} == dict(zip(found, [5, 6, 3, 1, 1, 1, 1]))
    assert "split(" not in out._jdf.queryExecution().toString()  # no document is cut into lines for each of its violations

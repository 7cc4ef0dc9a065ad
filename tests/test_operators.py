"""Golden and property tests of single rules."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, detect, docs, graph, ir, labels, outline, ranking


def one(spark, text):
    return spark.createDataFrame([("d", text)], "doc_id string, text string")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# a\ntext\n## b\n", [(0, 1, "a"), (9, 2, "b")]),
        ("\n# a", [(1, 1, "a")]),
        ("#\n\nnext\n", [(0, 1, "next")]),  # the title may follow on a later line
        ("####### seven", []),
        ("no header", []),
        ("", []),
        (None, []),
        ("```\n# in a fence\n```", [(4, 1, "in a fence")]),
        ("#no space", []),
    ],
)
def test_header_scan(spark, text, expected):
    assert sorted((r.start, r.level, r.title) for r in chunking.md_headers(one(spark, text)).collect()) == expected


def test_level_choice_without_headers(spark):
    r = chunking.choose_header_level(one(spark, "plain")).first()
    assert r.level == 1


def test_sections_stack_and_merge():
    text = "pre\n\n# Swap\ntext\n\n## Leg\na\n\nb\n### Fixed\nc\n## Settle\nd"
    got = [(h[:3], c) for h, c in chunking.sections_of(text, 3, False)]
    assert got == [
        ([None] * 3, "pre"),
        (["Swap", None, None], "# Swap\ntext"),
        (["Swap", "Leg", None], "## Leg\na  \nb"),
        (["Swap", "Leg", "Fixed"], "### Fixed\nc"),
        (["Swap", "Settle", None], "## Settle\nd"),
    ]
    # a header line alone joins the deeper section after it, unless headers are stripped
    assert [c for _, c in chunking.sections_of("# A\n\n## B\nx", 2, False)] == ["# A  \n## B\nx"]
    assert [c for _, c in chunking.sections_of("# A\n\n## B\nx", 2, True)] == ["x"]
    assert len(chunking.sections_of("```\n# no\n```\n# yes\nx", 1, False)) == 2


def test_pieces_bounds_and_overlap():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(20))
    out = chunking.pieces_of(text, 300, 60)
    assert all(len(p) <= 300 for p in out)
    assert set(" ".join(out).split()) == set(text.split())
    assert chunking.pieces_of("x" * 250, 100, 10) and all(len(p) <= 100 for p in chunking.pieces_of("x" * 250, 100, 10))
    assert chunking.pieces_of("", 100, 0) == []


def test_oversize_section_carries_headers(spark):
    text = "# Top\n## Sub\n" + " ".join(f"word{i}" for i in range(400))
    rows = chunking.chunk_documents(one(spark, text), max_header_level=2, max_chars=1000, piece=500, overlap=50).orderBy("section", "piece").collect()
    subs = [r for r in rows if r.is_subchunk]
    assert len(subs) > 3 and all(r.text.startswith("PATH: Top > Sub") and "## Sub" in r.text and r.text.endswith("\n") for r in subs)


def test_chunks_without_text(spark):
    assert chunking.chunk_documents(one(spark, "")).count() == 0
    assert chunking.chunk_documents(one(spark, None)).count() == 0
    with pytest.raises(ValueError):
        chunking.check_parameters(overlap=3000)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("class A(BaseModel):\n    x: int\n", "pydantic_model"),
        ("@dataclass(frozen=True)\nclass A:\n    x: int\n", "dataclass_model"),
        ("<?xml version='1.0'?><xs:schema xmlns:xs='http://www.w3.org/2001/XMLSchema'/>", "xml_instance"),
        ('<?xml version="1.0"?>\n<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"></xs:schema>', "xsd_schema"),
        ("<a x='1'>t</a>", "xml_instance"),
        ("<!DOCTYPE html><html></html>", None),
        ('{"$schema": "x"}', "json_schema"),
        ('{"type": "object", "properties": {}}', "json_schema"),
        ('{"type": "string", "properties": {}}', "json_instance"),
        ("[1, 2]", "json_instance"),
        ("a: 1\nb: 2", "yaml_instance"),
        ("- item", "yaml_instance"),
        ("nothing here", None),
        ("", None),
        (None, None),
    ],
)
def test_kinds(spark, text, kind):
    if text and text.startswith("<?xml version='1.0'?><xs"):
        kind = "xsd_schema"
    assert detect.detect_kind(one(spark, text)).first().kind == kind


def test_decoding_order(spark):
    rows = [(1, "é".encode()), (2, "é".encode("utf-16")), (3, b"\xe9"), (4, b"\xef\xbb\xbfx"), (5, None)]
    got = {r.i: (r.text, r.encoding) for r in detect.decode_text(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got == {1: ("é", "utf-8"), 2: ("é", "utf-16"), 3: ("é", "latin-1"), 4: ("\ufeffx", "utf-8"), 5: (None, None)}


def test_json_outline_rules(spark):
    text = '{"b":[1,2.5],"a":{"x":null,"y":true,"d":"2024-01-02"},"q":"12","e":[],"o":[{"k":1}],"s":"","n":[[1]]}'
    got = {(r.depth, r.name): (r.type, r.example) for r in outline.json_outline(one(spark, text)).collect()}
    assert got[1, "json instance"] == ("object", None)
    assert got[2, "b"] == ("list", "[1, ...]") and got[2, "e"] == ("list", "[]") and got[2, "o"] == ("list", "[{...}, ...]") and got[2, "n"] == ("list", "[[1, ...], ...]")
    assert got[3, "d"] == ("date", "2024-01-02") and got[3, "x"] == ("string", "null") and got[3, "y"] == ("string", "true") and got[2, "q"] == ("string", "12")
    assert sum(1 for k in got if k[0] == 1) == 1
    md = outline.render_markdown(outline.json_outline(one(spark, text))).first().markdown
    assert md.startswith("# json instance\n- type: object\n\n## a\n") and md == md.lower()
    assert outline.json_outline(one(spark, "not json")).count() == 0


def test_enum_preview(spark):
    a = F.array(*[F.lit(str(i)) for i in range(7)])
    r = spark.range(1).select(outline.enum_preview(a, 3).alias("x"), outline.enum_preview(a, 0).alias("y"), outline.enum_preview(a, 9).alias("z")).first()
    assert (r.x, r.y, r.z) == ("0, 1, 2, ... (total: 7)", "... (total: 7)", "0, 1, 2, 3, 4, 5, 6")


def test_rank_limits_and_ties(spark):
    q = spark.createDataFrame([(1, "a b", "pairwise_nano", None), (2, "a", "pairwise_nano", 513), (3, "a", "nope", None), (4, "a", "pairwise_nano", 0), (5, "a", "listwise_medium", None), (6, "a", "pairwise_nano", 1)], "query_id int, query string, model string, max_length int")
    p = spark.createDataFrame([(1, "x", 0, "c"), (1, "y", 1, "a b"), (1, "z", 2, "d")] + [(5, str(i), i, "a") for i in range(51)], "query_id int, passage_id string, pos int, text string")
    checked, _ = ranking.passage_check(ranking.listwise_guard(ranking.effective_max_length(ranking.resolve_model(q)), p), p)
    assert {r.query_id: r.error for r in checked.collect()} == {1: None, 2: "max_length too large", 3: "unknown model", 4: "max_length below 1", 5: "too many passages", 6: "no passages"}
    assert [r.passage_id for r in ranking.rerank(q, p).orderBy("rank").collect()] == ["y", "x", "z"]


def test_labels(spark):
    r = spark.createDataFrame([([" A", "A", "", "B "],), (["A", "A"],)], "labels array<string>")
    assert [(x.labels, x.error is None) for x in labels.label_rejects(r).collect()] == [(["A", "B"], True), (["A"], False)]
    s = spark.range(1).select(labels.score_labels(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0))).alias("s")).first().s
    assert abs(sum(s) - 1) < 1e-12
    t = spark.range(1).select(labels.top_k_labels(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.2)), 2).alias("t")).first().t
    assert [x.label for x in t] == ["b", "a"]


def test_inline_marks(spark):
    edges = spark.createDataFrame([("a", "b", "field"), ("b", "a", "extends"), ("a", "gone", "choice"), ("b", "c", "field"), ("c", "d", "field")], "src string, dst string, role string")
    known = spark.createDataFrame([(x,) for x in "abcd"], "entity_id string")
    got = {tuple(r.path): r.status for r in graph.inline_entities(edges, known, spark.createDataFrame([("a",)], "entity_id string"), 2).collect()}
    assert got == {("a",): "ok", ("a", "b"): "ok", ("a", "b", "a"): "cycle", ("a", "gone"): "missing", ("a", "b", "c"): "ok", ("a", "b", "c", "d"): "depth_cutoff"}


def test_field_packing_and_ids(spark):
    rows = [("b", "e", i, f"f{i}", "string", None, None, False, 0, 1) for i in range(1, 66)]
    f = spark.createDataFrame(rows, "bundle string, entity_id string, pos int, name string, type_prim string, type_ref string, description string, required boolean, card_min int, card_max int")
    parts = [r["count"] for r in docs.pack_fields(f).groupBy("part").count().orderBy("part").collect()]
    assert parts == [30, 30, 5]
    r = spark.createDataFrame([(" a b\tc??d/e ",)], "s string").select(ir.safe_id(F.col("s")).alias("x")).first()
    assert r.x == "a_b_c_d/e"


def test_results_do_not_depend_on_partitioning(spark):
    text = [(str(i), f"# H{i}\n" + "word " * (i * 40) + "\n## S\nx") for i in range(12)]
    df = spark.createDataFrame(text, "doc_id string, text string")
    a, b = (sorted(map(tuple, chunking.chunk_documents(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b

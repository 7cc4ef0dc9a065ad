"""Closures over schema files: edges, catalogues, files read only when they are found."""

from millrace.operators import closure
from millrace.operators.schemas import XSD


def xsd(*inside):
    return f'<xs:schema xmlns:xs="{XSD}">{"".join(inside)}</xs:schema>'


def include(where, how="include"):
    return f'<xs:{how} schemaLocation="{where}"/>'


FILES = {
    "main.xsd": xsd(include("sub/a.xsd"), include("http://e.org/x", "import"), include("gone.xsd"), include("http://e.org/unknown")),
    "sub/a.xsd": xsd(include("../main.xsd"), include("./b.xsd", "import"), f"<xs:element name='q'>{include('never.xsd')}</xs:element>"),
    "sub/b.xsd": xsd(include("b.xsd")), "never.xsd": xsd(), "x [1]{y}.xsd": xsd(include("j/one.json")), "bad.xsd": "<xs:schema",
    "j/one.json": '{"a":[{"$ref":"two.json#/p"},{"$ref":"#/a"},{"$ref":7}],"$ref":"../bad.json"}', "j/two.json": "{}", "bad.json": "{", "other.json": '{"$ref":"main.xsd"}',
}
NEEDED = {"main.xsd": 0, "sub/a.xsd": 1, "x [1]{y}.xsd": 1, "sub/b.xsd": 2, "j/one.json": 2, "j/two.json": 3, "bad.json": 3}
CATALOG = {"http://e.org/x": "x [1]{y}.xsd"}


def tables(spark):
    files = spark.createDataFrame([(b, p, t) for b in ("b1", "b2") for p, t in FILES.items()], "bundle string, path string, text string")
    return files, spark.createDataFrame([("b1", u, m) for u, m in CATALOG.items()], "bundle string, url string, mapped string")


def test_edges(spark):
    files, catalog = tables(spark)
    got = {(r.path, r.kind, r.target) for r in closure.schema_edges(files, catalog).filter("bundle = 'b1'").collect()}
    assert got == {
        ("main.xsd", "include", "sub/a.xsd"), ("main.xsd", "import", "x [1]{y}.xsd"), ("main.xsd", "include", "gone.xsd"), ("main.xsd", "include", None), ("sub/a.xsd", "include", "main.xsd"), ("sub/a.xsd", "import", "sub/b.xsd"),
        ("x [1]{y}.xsd", "include", "j/one.json"), ("j/one.json", "ref", "j/two.json"), ("j/one.json", "ref", "bad.json"), ("other.json", "ref", "main.xsd"),
    }


def test_closure_of_tables(spark):
    files, catalog = tables(spark)
    entries = spark.createDataFrame([("b1", "main.xsd"), ("b2", "main.xsd"), ("b2", "nowhere.xsd")], "bundle string, path string")
    got = {(r.bundle, r.path) for r in closure.schema_file_closure(files, entries, catalog).collect()}
    # the second bundle has no catalogue
    assert got == {("b1", p) for p in NEEDED} | {("b2", p) for p in ("main.xsd", "sub/a.xsd", "sub/b.xsd")}
    only = closure.schema_file_closure(files, entries, catalog, follow=("include",))
    assert {r.path for r in only.filter("bundle = 'b1'").collect()} == {"main.xsd", "sub/a.xsd"}


def test_files_are_read_when_they_are_found(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = closure.read_file_closure(spark, str(tmp_path), ["main.xsd"], CATALOG).collect()
    assert {r.path: r.round for r in got} == NEEDED and len(got) == len(NEEDED)
    assert all(r.text == FILES[r.path] for r in got)
    assert closure.read_file_closure(spark, str(tmp_path), ["nothing"]).collect() == []

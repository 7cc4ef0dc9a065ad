"""Files arriving as bytes: every status, and no scratch table left behind."""

from pathlib import Path

from millrace.functions import lineage
from millrace.operators import chunking
from millrace.streaming.convert import stream_raw_files

TEXTS = {
    "a.json": b'{"k":1.0,"k":2}', "b.md": b"# One\n\ntext\n\n## Two\n\nmore", "c.xml": b"<a><b></a>", "d.yaml": b"k: 'x", "e.xml": "<a>ä</a>".encode("utf-16"), "f.txt": b"", "sub/g.py": b"class A(BaseModel):\n    n: int\n", "h.bin": b"\xff\xfe\xfd",
    "i.xsd": b'<?xml version="1.0"?><s:schema xmlns:s="http://www.w3.org/2001/XMLSchema"><x>',
}


def test_raw_files(spark, tmp_path, monkeypatch):
    source, out, scratch = tmp_path / "in", tmp_path / "out", tmp_path / "scratch"
    for name, data in TEXTS.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(data)
    made = []
    real = lineage.shared
    monkeypatch.setattr(lineage, "shared", lambda s, n: made.append(real(s, n)) or made[-1])
    stream_raw_files(spark, str(source), str(out), max_header_level=2)
    short = lambda rows: {r[0].split("/in/")[1]: r[1] for r in rows}
    rejects = short(spark.read.parquet(str(out / "rejects")).select("doc_id", "status").collect())
    assert rejects == {"b.md": 415, "c.xml": 500, "d.yaml": 500, "h.bin": 415, "i.xsd": 500}
    kinds = short(spark.read.parquet(str(out / "kinds")).select("doc_id", "kind").collect())
    assert {k: v for k, v in kinds.items() if k not in rejects} == {"a.json": "json_instance", "sub/g.py": "pydantic_model", "e.xml": "xml_instance"}
    chunks = spark.read.parquet(str(out / "chunks")).collect()
    assert {r.doc_id.split("/in/")[1] for r in chunks} >= {"a.json", "b.md", "sub/g.py"} and all(r.source_file == r.doc_id for r in chunks)
    assert [r.header_path for r in sorted(chunks, key=lambda r: r.section) if r.doc_id.endswith("b.md")] == ["One", "One > Two"]
    assert made and not any(Path(p.removeprefix("file://").removeprefix("file:")).exists() for p in made)
    # another run finds nothing new
    stream_raw_files(spark, str(source), str(out), max_header_level=2)
    assert spark.read.parquet(str(out / "kinds")).count() == len(TEXTS) - 1  # Spark skips empty files


def test_chunks_carry_their_source(spark):
    text = "# A\n\n" + "long words " * 400 + "\n\n## B\n\nshort"
    docs = spark.createDataFrame([(1, text, "s", "a.md"), (2, "x", None, "b.md")], "doc_id int, text string, source_id string, source_file string")
    rows = chunking.number_chunks(chunking.chunk_documents(docs, max_header_level=2, max_chars=1000, piece=500, overlap=50)).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in rows if r.doc_id == "1"]
    assert {(r.source_id, r.source_file) for r in one} == {("s", "a.md")} and [r.chunk_index for r in one] == list(range(len(one)))
    assert [r.subchunk_index for r in one] == [*range(len(one) - 1), None] and [(r.source_id, r.source_file) for r in rows if r.doc_id == "2"] == [(None, "b.md")]

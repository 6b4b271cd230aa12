import io
import zipfile
import zlib

import pytest

from paperloom.functions.chunking import chunks
from paperloom.sources import files, sinks

BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>%s</w:body></w:document>'


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", BODY % "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs))
    return out.getvalue()


def pdf(*pages):
    parts = [b"%PDF-1.4"]
    for i, text in enumerate(pages):
        shown = zlib.compress(f"BT /F1 12 Tf ({text}) Tj ET".encode())
        parts.append(f"{10 + i} 0 obj << /Type /Page /Contents {50 + i} 0 R >> endobj".encode())
        parts.append(f"{50 + i} 0 obj << /Filter /FlateDecode /Length {len(shown)} >> stream\n".encode() + shown + b"\nendstream endobj")
    return b"\n".join(parts)


@pytest.fixture
def incoming(tmp_path):
    for name, data in {"a.txt": b"A\xffB", "sub/b.MD": "본문".encode(), "c.html": b"no", "d.docx": docx("one", " ", "two"), "e.pdf": pdf("hello", "", "world"), "f.pdf": b"junk", "g.doc": b"old text", "blank.txt": b" \n", "_hidden.txt": b"hid"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


WANT = {"a.txt": "A�B", "b.MD": "본문", "d.docx": "one\ntwo", "e.pdf": "[Page 1]\nhello\n\n[Page 3]\nworld", "f.pdf": "[PDF: f.pdf]", "g.doc": "old text", "blank.txt": " \n"}


def test_folder(spark, incoming):
    rows = files.extracted(files.folder(spark, incoming))
    assert {r.name: r.text for r in rows.collect()} == WANT | {"_hidden.txt": "hid"}
    assert {r.name for r in files.with_text(rows).collect()} == {*WANT, "_hidden.txt"} - {"blank.txt"}
    assert [r.name for r in files.listed_files(spark, incoming).collect()] == ["_hidden.txt", "a.txt", "blank.txt", "d.docx", "e.pdf", "f.pdf", "g.doc", "b.MD"]
    assert {r.name: r.text for r in files.extracted(files.visible_files(spark, incoming)).collect()} == WANT


def test_folders_are_partitions(tmp_path):
    """The driver finds folders until it has enough; what lies below the last level is listed with it. Every file is read once."""
    from paperloom.sources import folders

    for at in ("", "a", "a/b", "a/b/c", "d", "d/.e"):
        (tmp_path / at).mkdir(exist_ok=True)
        for name in ("2.txt", "_1.md", "x.html"):
            (tmp_path / at / name).write_text(at + name)
    for wanted in (1, 2, 3, 100):
        reader = folders.Reader({"path": str(tmp_path), "partitions": str(wanted), "suffixes": ".txt,.md"})
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(found) == 12 and len({r["path"] for r in found}) == 12
        assert all(r["content"].decode() == r["path"].removeprefix(str(tmp_path)).lstrip("/").replace("/" + r["name"], r["name"]) for r in found)
    assert [p.deep for p in folders.Reader({"path": str(tmp_path), "partitions": "100"}).partitions()] == [False] * 6
    own = [r["name"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert own == ["2.txt", "_1.md"]
    with pytest.raises(ValueError, match="path"):
        folders.Reader({})


def test_uploads_and_single_file(spark, incoming):
    rows = files.extracted(files.uploads(spark, [("x.pdf", pdf("p", "")), ("y.pdf", pdf(" ")), ("z.txt", b"t")]), mode="analyze")
    assert {r.name: r.text for r in rows.collect()} == {"x.pdf": "p\n", "y.pdf": " ", "z.txt": "t"}
    assert files.file_text(pdf(" "), "y.pdf", ".pdf") == "[PDF 텍스트 없음: y.pdf]"
    assert [r.name for r in files.single_file(spark, f"{incoming}/a.txt").collect()] == ["a.txt"]


def test_points_are_replaced_not_repeated(spark, incoming, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "points")
    texts = files.extracted(files.folder(spark, incoming)).withColumnsRenamed({"name": "source", "path": "filepath"})
    made = chunks(texts, key="filepath")
    extra = F.create_map(F.lit("source"), F.lit("over"), F.lit("version"), F.lit("2"))
    for _ in range(2):
        sinks.upsert_points(sinks.as_points(made, F.lit("c1"), extra), path)
    sinks.upsert_points(sinks.as_points(made.limit(1), F.lit("c2")), path)
    got = sinks.read_points(spark, path).collect()
    assert sorted(r.collection for r in got) == ["c1"] * 7 + ["c2"]
    assert {r.source for r in got if r.collection == "c1"} == {"over"} and got[0].extra is not None


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, name string")
    sinks.append_versions(make((1, "a"), (2, "b"), (3, "c")), path, 1)
    sinks.append_versions(make((1, "a2")), path, 2)
    sinks.append_versions(make((2, "b")), path, 3, deleted=True)
    assert sorted(map(tuple, sinks.current(spark.read.parquet(path)).collect())) == [(1, "a2"), (3, "c")]
    sinks.compact(spark, path, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2

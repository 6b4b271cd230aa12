import base64
import hashlib
import io
import random
import zipfile

import pytest

from paperloom.llm import registry
from paperloom.llm import warc_zip as W


@pytest.mark.parametrize("wide", [False, True])
def test_directory_and_the_standard_library_agree(wide):
    members = [("a.txt", [b"one", b"two"]), ("b/é.bin", [bytes(range(256)) * 50]), ("empty", [])]
    data = b"".join(W.zip_parts(members, force64=wide))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [z.read(n) for n in z.namelist()] == [b"".join(x) for _, x in members]
    read = lambda at, n: data[at : at + n]
    found = W.directory(read, len(data))
    assert {n: read(*W.stored(read, e)) for n, e in found.items()} == {n: b"".join(x) for n, x in members}


def test_reads_packages_of_others():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"a note PK\x05\x06 in it"
        with z.open("x", "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("y", b"packed" * 100, zipfile.ZIP_DEFLATED)
    data = buffer.getvalue()
    read = lambda at, n: data[at : at + n]
    found = W.directory(read, len(data))
    assert read(*W.stored(read, found["x"])) == b"stored"
    with pytest.raises(ValueError):
        W.stored(read, found["y"])
    with pytest.raises(ValueError):
        W.directory(lambda at, n: b"none"[at : at + n], 4)


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, u, h in rows:
        data, low = (h or "").encode(), first.get(h or "")
        revisit = low is not None and p != low
        out.append((p, "revisit" if revisit else "response", low if revisit else None, base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data)))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, f"http://x/{i} é\n", rng.choice(["", "<p>é</p>", "\r\n\r\n" * 3, "z" * 3000, f"own {i}"])) for i in range(90)]
    rows += [(95, None, None), (None, "u", "<p>é</p>"), (None, "u", "no id has it"), (None, "u", "no id has it"), (3, "again", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = W.write_packages(pages, package_bytes=900)
    got = W.read_records(spark, folder, payload=True).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got), key=str) == brute(rows)
    texts = {(p, (h or "").encode()) for p, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response") and all(r.payload is None for r in got if r.record_type == "revisit")
    large = W.read_records(spark, W.write_packages(pages, least_bytes=100)).where("record_type = 'revisit'").collect()
    assert large and all(r.payload_bytes >= 100 for r in large)


def test_large_payloads_and_clashing_columns(spark):
    """Above one block of 1 MiB; columns of the result's names in the input are not read."""
    rows = [(1, "u", "é" * 800_000), (2, "u", "é" * 800_000), (3, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 5, "z", "z") for r in rows], "page_id long, url string, html string, payload_bytes int, record_type string, path string")
    got = W.read_records(spark, W.write_packages(pages, package_bytes=1 << 20)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got), key=str) == brute(rows)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_records(spark, W.write_packages(pages)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = registry.op2_warc_zip(spark, d).orderBy("page_id").collect()
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{d}/pages.parquet'")
        want = c.sql(registry.ORACLE_SQL["op2_warc_zip"] + " ORDER BY page_id")
        names, rows = want.columns, want.fetchall()
    assert [tuple(r[n] for n in names) for r in got] == rows

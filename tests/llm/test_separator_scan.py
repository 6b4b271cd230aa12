import numpy as np
import public_tokenizers
import pytest

from paperloom.llm import registry
from paperloom.llm import separator_scan as S
from paperloom.llm._shared import new_folder, write_whole
from tests.llm.test_token_files import TEXTS, whole

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scan_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "GROUP_BLOCKS", 5)
    rng = np.random.default_rng(block)
    folder, files, want = new_folder(spark, "scan"), [], set()
    plans = [rng.choice([9, 1, 2, 3], n) for n in (0, 1, 6, 50, 300)] + [np.array([9]), np.array([9, 9, 9]), np.array([1, 2]), np.full(40, 3)]
    for k, ids in enumerate(plans):
        path = f"{folder}/{k}.tokens"
        write_whole(path, [ids.astype("<u4").tobytes()], 0)
        files.append((path, 4 * len(ids)))
        start = number = 0
        for i, x in enumerate([*ids.tolist(), None]):
            if x == 9 or x is None and start < len(ids):
                want.add((path, number, start, i - start, x == 9))
                start, number = i + 1, number + 1
    got = S.counts(spark, spark.createDataFrame(files, "path string, length long"), 9, "<u4", block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_documents(spark):
    rows = [(i if i != 4 else None, t, 5) for i, t in enumerate(TEXTS)] + [(2, "more")]
    docs = spark.createDataFrame([(*r[:2], 1) for r in rows], "doc_id long, text string, n_tokens int")
    folder = S.write_flat_files(docs, PATH, 50256, file_tokens=60)
    got = sorted(((r.doc_id, r.n_tokens) for r in S.document_counts(spark, folder, 50256, block_tokens=16).collect()), key=str)
    assert got == sorted(((r[0], len(ids) - 1) for r, ids in zip(rows, whole([r[1] for r in rows], True))), key=str)
    folder = S.write_flat_files(docs, PATH, 50256, ordered=True)
    found = S.document_counts(spark, folder, 50256).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == got
    with pytest.raises(Exception, match="does not fit"):
        S.write_flat_files(docs, PATH, 50256, dtype="<u1")


def test_long_texts(spark):
    """Above one block of 1 MiB, in files of fewer tokens than it has."""
    texts = ["many words of a long text, " * 50_000, "short", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = S.document_counts(spark, S.write_flat_files(docs, PATH, 50256, file_tokens=1000), 50256, block_tokens=4096).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(ids) - 1 for i, ids in enumerate(whole(texts, True))}


def test_counts_are_those_of_the_token_files(spark):
    """op8 counts what op1 writes, but for op1's end id, where no text has the string of a special token."""
    d = "/root/testdata/sf0.001"
    got, want = (sorted((r.doc_id, r.n_tokens) for r in registry.QUERIES[q](spark, d).collect()) for q in ("op8_separator_scan", "op1_token_files"))
    assert got == [(k, n - 1) for k, n in want]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.document_counts(spark, S.write_flat_files(docs, PATH, 50256), 50256).collect() == []

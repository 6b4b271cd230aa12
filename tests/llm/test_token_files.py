import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a  b\n\n c", " lead", "tab\t end ", "l'été ça  x", "　wide 　 x", "<|endoftext|> x", "don't  'S 12 3", "😀 😀😀", "한국어 텍스트 처리", "a" * 5000, "x\r\n y   z   q", "same", "same"]


#: Two words of which a polynomial modulo 2^64 has the same value, whatever its base.
TWINS = ["".join("ab"[i.bit_count() % 2 ^ k] for i in range(1024)) for k in (0, 1)]


def whole(texts, special=False):
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = special
    return [[*e.ids, 2] for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_units_encode_as_whole_texts():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice([*" \n\t 　abcé'1,.한😀", "<|endoftext|>", "<|endoftext"]) for _ in range(rng.randrange(40))) for _ in range(1500)] + TWINS
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = [T.with_end(ids, offs, 2) for _, ids, offs in T.tokenized(iter([batch.slice(0, 700), batch.slice(700)]), PATH)]
    got = [ids[a:b].tolist() for ids, offs in got for a, b in zip(offs, offs[1:])]
    assert got == whole(texts)
    plain = [ids for _, ids, _ in T.tokenized(iter([batch]), PATH, added=False)]
    assert np.concatenate(plain).tolist() == [x for ids in whole(texts, True) for x in ids[:-1]] and all(50256 not in x for x in plain)


def test_levels_give_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 500), rng.integers(0, 2**32, 500), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.int64)
    data = b"".join(T.packed(ids, [5, None], np.array([10, len(ids)])))
    file = T.TokenFile(lambda at, n: data[at : at + n])
    assert [file.token(i) for i in range(len(ids))] == ids.tolist() == file.all_tokens().tolist()
    assert file.documents()[0] == [5, None]
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_files_and_random_access(spark):
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "second of 3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = T.write_token_files(docs, PATH, 2, file_tokens=40)
    got = sorted(T.read_documents(spark, folder).collect(), key=lambda r: r.start)
    ids = dict(zip([(r[0], r[1]) for r in rows], whole([r[1] for r in rows])))
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(5, 15)]
    flat = []
    for r in got:
        match = [v for (d, _), v in ids.items() if d == r.doc_id and zlib.crc32(np.array(v, "<u4").tobytes()) == r.ids_crc32]
        assert match and r.n_tokens == len(match[0]) and r.start == len(flat)
        flat += match[0]
    asked = spark.createDataFrame([(i,) for i in [0, 7, len(flat) - 1, len(flat), 50, 50]], "position long")
    assert sorted(map(tuple, T.tokens_at(spark, folder, asked).collect())) == sorted((i, flat[i]) for i in [0, 7, len(flat) - 1, 50, 50])


def test_long_text(spark):
    text = " ".join(f"word{i} <|endoftext|>" for i in range(70_000))
    docs = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    got = T.read_documents(spark, T.write_token_files(docs, PATH, 2)).collect()
    want = whole([text])[0]
    assert {(r.doc_id, r.start, r.n_tokens) for r in got} == {(1, 0, len(want)), (2, len(want), 2)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_documents(spark, T.write_token_files(docs, PATH, 2)).collect() == []


def test_cache_is_trimmed():
    from paperloom.llm._bytes import UnitIds

    codec = UnitIds(lambda units: [list(u) for u in units], most=50)
    rng = random.Random(1)
    for _ in range(60):
        units = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(20)})
        places = codec.places(units)
        assert [codec.flat[codec.first[p] : codec.first[p] + codec.count[p]].tolist() for p in places] == [list(u) for u in units]
        assert len(codec.place) <= 70

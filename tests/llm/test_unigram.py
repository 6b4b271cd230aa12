import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from paperloom.llm import registry, unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def as_unigram():
    """The library's own unigram search over the same pieces: trainer_spec.model_type is set to 1."""
    with open(PATH, "rb") as f:
        data = f.read()

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in unigram._fields(data):
        assert isinstance(value, bytes)
        if field == 2:
            value += bytes([3 << 3, 1])
        out += varint(field << 3 | 2) + varint(len(value)) + value
    made = sentencepiece.SentencePieceProcessor(model_proto=out)
    return made.encode


def brute(text):
    """Viterbi over characters with a dictionary of pieces: the greatest sum and its path, longer last pieces first."""
    model = unigram.codec(PATH)[0]
    known = {model.pieces[i][0].decode(): i for i in model.ids.tolist()}
    text = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [(0.0, [])] + [(float("-inf"), [])] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            piece = text[start:end]
            if piece in known:
                score, ids = model.pieces[known[piece]][1], [known[piece]]
            elif end - start == 1:
                score, ids = model.unknown, [model.bytes[b] for b in piece.encode()]
            else:
                continue
            if best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, best[start][1] + ids)
    return best[-1][1]


def score(ids):
    model = unigram.codec(PATH)[0]
    return sum(model.pieces[i][1] for i in ids)


def ids_of(texts):
    ids, offs = unigram.encoded(pa.array(texts, pa.string()), PATH)
    return [ids[a:b].tolist() for a, b in zip(offs, offs[1:])]


def test_trie():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    trie = unigram.DoubleArray(keys)
    import numpy as np

    def find(key):
        node = np.array([0])
        for b in key:
            node = trie.step(node, np.array([b]))
            if node[0] < 0:
                return -1
        return int(trie.value[node[0]])

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all((find(k) >= 0) == (k in set(keys)) for k in (bytes(rng.choice(b"ab\xffq") for _ in range(rng.randrange(1, 8))) for _ in range(500)))


def test_ids_equal_brute_force_and_the_library():
    rng = random.Random(2)
    texts = ["", " ", "a", "Hello world", "  two  spaces   three ", "l'été où ça", "한국어 텍스트", "😀 x😀", "tab\tnew\nline\n", "▁ marker▁x", "naïve　wide", "ﬁ ﬃ ①", "x" * 300]
    texts += ["".join(rng.choice("abcdeé 한\n.😀tion") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    library = as_unigram()
    assert ids_of(texts) == [brute(t) for t in texts] == [library(t) for t in texts]


def test_round_trip(spark):
    rows = [(1, "Hello  wörld \n 한국"), (2, None), (3, ""), (4, " x"), (5, "▁y")]
    got = unigram.pieces(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int"), PATH, decode=True).collect()
    assert {r.row.doc_id: r.decoded for r in got} == {1: rows[0][1], 2: "", 3: "", 4: " x", 5: " y"}
    again = unigram.decoded(spark.createDataFrame([(r.row.doc_id, r.ids) for r in got] + [(9, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert {r.row.doc_id: r.decoded for r in again} == {1: rows[0][1], 2: "", 3: "", 4: " x", 5: " y", 9: ""}
    assert unigram.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in registry.table(spark, d, "documents").collect()}
    got = registry.op5_unigram(spark, d).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    library = as_unigram()
    for r in got[:60]:
        short = texts[r.doc_id].split("\n")[0][:1500]
        ids = ids_of([short])[0]
        assert ids == brute(short)
        assert score(ids) >= score(library(short))  # its search misses some sums by a little


def test_long_runs():
    """A run that nothing cuts is searched by itself: the same path, and a megabyte within seconds."""
    import time

    rng = random.Random(12)
    model = unigram.codec(PATH)[0]
    for alphabet in ("abcdefghij", "aaab", "aé日😀b", "\x01ab"):
        unit = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2100, 3000))).encode()
        assert model._best_of_long(unit) == model._best([unit])[0] == model.encode_units([unit, b"ab"])[0]
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1 << 20))
    start = time.time()
    ids, offs = unigram.encoded(pa.array([text, "short"]), PATH)
    assert time.time() - start < 12
    assert model.decode(ids[: offs[1]].tolist()) == text and model.decode(ids[offs[1] :].tolist()) == "short"

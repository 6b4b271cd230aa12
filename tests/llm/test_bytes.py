"""Spans that share a hash are told apart by their bytes."""

import random

import numpy as np
import pytest

from paperloom.llm import _bytes as B
from paperloom.llm import decision_lists, fm_index, unigram
from tests.llm.test_decision_lists import brute
from tests.llm.test_fm_index import brute as brute_hits
from tests.llm.test_token_files import TWINS
from tests.llm.test_unigram import PATH


def spans(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends


def colliding():
    """Two words of 16 bytes with one hash: the second half of the other takes back what its first half has changed."""
    first, other = b"wordword", b"elseelse"
    state = [int(B.span_hashes(*spans([w + b"\0" * 8]))[0]) for w in (first, other)]
    assert state[0] != state[1]
    size = np.array([16], np.uint64) * B.ODD
    a, b = (int(B.mixed(np.frombuffer(w, "<u8") + size)[0]) for w in (first, other))
    half = b"tailtail"
    return first + half, other + (int.from_bytes(half, "little") ^ a ^ b).to_bytes(8, "little")


def test_distinct_and_vocabulary():
    rng = random.Random(1)
    x, y = colliding()
    assert len(set(B.span_hashes(*spans([x, y])).tolist())) == 1
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 3, 8, 9, 17, 300]))) for _ in range(400)] + [x, y, x, y] + [t.encode() for t in TWINS] * 2
    rng.shuffle(words)
    index, inverse = B.distinct(*spans(words))
    assert len(index) == len(set(words)) and all(words[index[k]] == w for k, w in zip(inverse, words, strict=True))
    known = sorted(set(words) - {b"a"})
    for vocabulary in (B.Vocabulary(known), B.Vocabulary([w for w in known if w != y])):
        assert vocabulary.numbers(*spans(words)).tolist() == [vocabulary.words.index(w) if w in vocabulary.words else -1 for w in words]


def test_units_get_their_own_ids():
    x, y = colliding()
    ids, offs = B.UnitIds(lambda units: [list(u) for u in units]).ids(spans([x, y, x])[0], np.array([0, 48]), np.array([0, 16, 32]))
    assert bytes(ids.tolist()) == x + y + x and offs.tolist() == [0, 48]


@pytest.mark.parametrize("text", [f"{TWINS[0]} b c {TWINS[1]} b c", f"{TWINS[0]} b\n{TWINS[1]} b\n{TWINS[0]} b", "\n".join(TWINS * 40)])
def test_statistics_of_twins(text):
    data = text.encode()
    found = decision_lists.statistics_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert tuple(int(found[k][0]) for k in decision_lists.STATS[:5]) == brute(text)[:5]


def test_hits_of_twins(spark):
    docs, bench = [(1, f"x {TWINS[0]} y"), (2, f"x {TWINS[1]} y"), (3, "x y " * 400_000 + TWINS[1])], [(7, TWINS[1]), (8, f"{TWINS[0]} z")]
    got = fm_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).selectExpr("row.doc_id", "n_words", "n_hit", "items").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute_hits(docs, bench)


def test_pieces_of_twins(spark):
    docs = spark.createDataFrame([(1, f"{TWINS[0]} {TWINS[1]} {TWINS[0]}"), (2, "some text " * 120_000), (2, None)], "doc_id long, text string")
    for r in unigram.pieces(docs, PATH, decode=True).collect():
        assert r.decoded == (r.row.text or "")

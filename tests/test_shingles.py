import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.functions import shingles as S

WORD = re.compile(r"[^\W_]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab cÄß1_-.\n\t世é", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_runs_of_letters_and_digits(texts):
    joined, cps, starts, ends, offsets = S.word_spans(texts)
    got = [[joined[i:j] for i, j in zip(starts[a:b], ends[a:b])] for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [WORD.findall((t or "").lower()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_sets_equal_brute_force(texts, k):
    h, at = S.shingle_sets(texts, k)
    name = {}
    for t, i, j in zip(texts, at[:-1], at[1:]):
        w = WORD.findall((t or "").lower())
        want = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)}
        assert len(want) == j - i
        key = frozenset(want)
        assert name.setdefault(key, h[i:j].tobytes()) == h[i:j].tobytes()


def test_hash_does_not_depend_on_place():
    long = "x" * 200_000
    h, at = S.word_hashes([f"{long} wort", "wort", f"a {long}"])
    assert h[1] == h[2] and h[0] == h[4] and len(set(h.tolist())) == 3


def test_jaccard_and_minhash():
    h, at = S.shingle_sets(["a b c d e f g h", "a b c d e f g x", "", "q r s t u v w y"], 3)
    a, b, c, d = (h[i:j] for i, j in zip(at[:-1], at[1:]))
    assert S.jaccard(a, b) == 5 / 7 and S.jaccard(a, d) == 0 and S.jaccard(c, c) == 0
    sig = S.minhash(h, at, 512, 1)
    assert abs(np.mean(sig[0] == sig[1]) - 5 / 7) < 0.1 and not sig[2].any()
    k1, _ = S.set_keys(h, at)
    assert k1[2] == 0 and len(set(k1.tolist())) == 4


def test_packed_vectors_come_back():
    from veilspark.functions.vectors import pack, unpack

    rng = np.random.default_rng(0)
    for dtype in ("uint8", "uint32", "int64", "float32"):
        for n, some in ((1, 0), (1, 1), (100_000, 0), (100_000, 3), (100_000, 5_000), (1_000, 900), (70_000, 1)):
            v = np.zeros(n, dtype)
            v[rng.permutation(n)[:some]] = 7
            assert (unpack(pack(v), dtype) == v).all()


def test_totals_by_chunk(spark):
    from veilspark.functions.vectors import vector_total

    def add(vector, b):
        x = b["id"].to_numpy()
        np.add.at(vector, x % 5, 1)
        np.bitwise_or.at(vector, 8 + x % 3, (1 << (x % 7)).astype(np.uint32))

    got = vector_total(spark.range(0, 1000, 1, 300), 16, "uint32", add, lambda c: "sum" if c == 0 else "or", chunks=2)
    assert got[:5].tolist() == [200] * 5 and got[8:11].tolist() == [127] * 3 and not got[11:].any()

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillweave.llm import words
from tillweave.llm.words import ALNUM, NOT_SPACE, Words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0b-é ", max_size=40)), max_size=6)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spelled(w):
    return [[bytes(w.raw[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_and_windows_match_python(texts):
    for lower, inside, pattern in ((False, NOT_SPACE, r"[^\x20\x09-\x0D]+"), (True, ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts, pa.string()), lower, inside)
        want = [re.findall(pattern, (t or "").translate(LOW) if lower else (t or "")) for t in texts]
        got = spelled(w)
        assert [[x.translate(LOW) if lower else x for x in ws] for ws in got] == want
        flat = [x for ws in want for x in ws]
        same = {}
        for x, h in zip(flat, w.hash.tolist()):
            assert same.setdefault(x, h) == h
        assert len(set(same.values())) == len(same)
        at, h = w.windows(3)
        windows = [(tuple(ws[k : k + 3])) for ws in want for k in range(len(ws) - 2)]
        assert len(at) == len(windows) and len(set(h.tolist())) == len(set(windows))


def test_hash_does_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["alpha beta gamma " * 9, "x" * 1000 + " y"])
    whole = Words(texts, True, NOT_SPACE).hash
    monkeypatch.setattr(words, "PIECE_BYTES", 16)
    assert np.array_equal(whole, Words(texts, True, NOT_SPACE).hash)


def test_sliced_arrays_and_empty_batches():
    part = pa.array(["no", "a b", None, "c"]).slice(1, 2)
    assert spelled(Words(part, False, NOT_SPACE)) == [["a", "b"], []]
    assert len(Words(pa.array([], pa.string()), False, NOT_SPACE)) == 0

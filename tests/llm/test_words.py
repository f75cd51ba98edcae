import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caseweave.llm._words import IN_WORD, NOT_SPACE, grams, text_chunks

PATTERNS = ((IN_WORD, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), (NOT_SPACE, "[^\x20\x09-\x0d]+"))
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1 \n\t\x0b\x1f.é日\x7f\x80\xa0_"), max_size=30)), max_size=8)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, chunk):
    for inside, pattern in PATTERNS:
        got, hashes = [], {}
        for first, w in text_chunks(pa.array(texts, pa.string()), inside, chunk):
            assert first == len(got)
            h = w.hashes()
            for i in range(len(w.bounds) - 1):
                words = [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]
                for j, word in enumerate(words):
                    assert hashes.setdefault(word, h[w.first[i] + j]) == h[w.first[i] + j]
                got.append(words)
        assert got == [re.findall(pattern, lower(t)) for t in texts]
        assert len(set(map(int, hashes.values()))) == len(hashes)


def test_slices_and_empty_arrays():
    a = pa.array(["one two", None, "three", "", "four"]).slice(1, 3)
    got = [[w.word(j) for j in range(w.first[i], w.first[i + 1])] for _, w in text_chunks(a, IN_WORD) for i in range(len(w.bounds) - 1)]
    assert got == [[], [b"three"], []]
    assert list(text_chunks(pa.array([], pa.string()), IN_WORD)) == []


def test_grams():
    h = np.arange(10, dtype=np.uint64)
    assert len(grams(h, 3)) == 8 and len(grams(h, 11)) == 0
    assert grams(h, 3)[0] == grams(np.arange(3, dtype=np.uint64), 3)[0] and len(set(grams(h, 3).tolist())) == 8

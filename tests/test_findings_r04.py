"""Cases of the findings of round 4."""

import random
import tracemalloc

import numpy as np
import pytest

from textkb.operators import fuzzy
from textkb.operators.fuzzy import Index


def _changed(text):
    return "".join("#" if i % 12 == 11 else c for i, c in enumerate(text))


@pytest.mark.parametrize("text", ["Thhaen " * 2500, "ab. " * 2500, "".join(random.Random(1).choice("ab ") for _ in range(16_000))])
def test_a_long_quote_in_its_own_text_takes_bounded_memory(text):
    """key_11_located: the hits of a quote as long as its text were spread out at once, with all sentences around each."""
    index = Index([_changed(text)])
    code = fuzzy._code(text)
    row, starts = np.zeros(len(code), np.int64), np.append(0, np.flatnonzero(np.isin(code, fuzzy._ENDS))[:-1] + 2)
    tracemalloc.start()
    quotes, sentences = index.candidates(code, row, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and (0, 0) in zip(quotes.tolist(), sentences.tolist(), strict=True)


@pytest.mark.parametrize("at_once", [1, 50, 1 << 17])
def test_votes_are_those_of_a_plain_count(monkeypatch, at_once):
    monkeypatch.setattr(fuzzy, "HITS_AT_ONCE", at_once)
    r = random.Random(at_once)
    for _ in range(60):
        letters = r.choice(["ab", "ab. ", "abcd ."])
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 90))) * r.choice([1, 3]) for _ in range(r.randrange(1, 4))]
        held = [_changed(r.choice(texts)[: r.randrange(1, 70)]) for _ in range(3)]
        index = Index(held)
        code = np.concatenate([fuzzy._code(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.array(sorted(r.sample(range(len(code)), r.randrange(1, min(len(code), 12) + 1))))
        want = {(q, s) for q in index.open for s in range(len(starts))}
        for length, _, quote, place, _ in index.tables:
            for q in set(quote.tolist()):
                for s, start in enumerate(starts.tolist()):
                    votes = 0
                    for p in place[quote == q].tolist():
                        seed = index.code[q][p : p + length].tolist()
                        votes += any(
                            row[t] == row[t + length - 1] == row[start] and code[t : t + length].tolist() == seed
                            for t in range(max(0, start + p - index.edits[q]), min(len(code) - length, start + p + index.edits[q]) + 1)
                        )
                    if votes >= index.need[q]:
                        want.add((q, s))
        assert set(zip(*(x.tolist() for x in index.candidates(code, row, starts)), strict=True)) == want

"""Cases of the findings of round 3 about the training-data operators."""

import random

import numpy as np

from textkb.llm import decontamination as D


def _code(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _words(r, chars):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(chars))[:chars]


def test_a_passage_of_an_item_alone_is_turned_away_before_verification(monkeypatch):
    """op6_decontamination: most places went to the edit distance of the whole item, one by one."""
    r, calls, located = random.Random(8), [], D.located
    items = [(i, _code(_words(r, 300))) for i in range(10)]
    texts = [_words(r, 500) + "".join(map(chr, cp[100:220])) + _words(r, 500) for _, cp in items] + ["".join(map(chr, cp)) for _, cp in items]
    at = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(D, "located", lambda *a: calls.append(a) or located(*a))
    got = D.search(_code("".join(texts)), at, D._indexes(items), D.MAX_EDITS)
    assert [(row, i, e) for row, i, _, _, e, _ in got] == [(10 + i, i, 0) for i in range(10)]
    assert all(found is not None for found in (located(*a) for a in calls))  # no passage went there


def test_no_place_within_the_limit_is_turned_away():
    r = random.Random(9)
    items = [(i, _code(_words(r, n))) for i, n in enumerate([24, 30, 35, 40, 64, 81, 120, 233, 400])]
    for index in D._indexes(items):
        for k, (_, item) in enumerate(index.items):
            limit = int(D.MAX_EDITS * len(item))
            for _ in range(60):
                edited = item.tolist()
                for _ in range(r.randrange(2 * limit + 1)):  # some within the limit, some beyond
                    p = r.randrange(len(edited))
                    edited[p : p + r.randrange(2)] = [97 + r.randrange(26)] * r.randrange(2)
                text = np.concatenate([_code(_words(r, 60)), np.array(edited, np.uint32), _code(_words(r, 60))])
                ends = np.array([0]), np.array([len(text)])
                possible = index.possible(D.symbols(text), *ends, np.array([k]), np.array([limit]))[0]
                assert possible or D.best_substring(item, text, limit) is None
            far = _code(_words(r, len(item) + 120))
            assert not index.possible(D.symbols(far), np.array([0]), np.array([len(far)]), np.array([k]), np.array([limit]))[0]


def test_walks_read_a_text_in_place_as_they_read_a_window_alone():
    """Where they leave their window they stay and read 0, also at the end of the text."""
    r = np.random.default_rng(3)
    symbol, width, sampling = r.integers(1, 4, 4000).astype(np.uint8), 16, (18, 9)
    start = np.concatenate([np.arange(0, 4000 - width, 5), [4000 - width]])
    alone = [np.concatenate([symbol[s : s + width], np.full(99, 0, np.uint8)]) for s in start]
    for walk in range(D.WALKS):
        every = list(D.keys(symbol, start, width, walk, *sampling))
        padded = np.concatenate(alone)
        apart = list(D.keys(padded, np.arange(len(start)) * (width + 99), width, walk, *sampling))
        assert len(every) == D.TABLES // D.WALKS and all((a == b).all() for a, b in zip(every, apart, strict=True))

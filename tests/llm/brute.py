"""Plain re-statements of the operators' definitions, used to check them on small inputs."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, n=5):
    w = WORD.findall(lower_ascii(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows, n=5, percent=80):
    """{doc_id: (size, component)} by comparing every pair that shares an n-gram."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i in sorted(sets):
        for g in sets[i]:
            index.setdefault(g, []).append(i)
    seen = set()
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0

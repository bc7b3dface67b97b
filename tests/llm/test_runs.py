"""Periodic runs against a plain search, and Ukkonen's tree against sorted suffixes."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import periodic_runs as P


def plain_runs(words, least=P.LEAST, times=P.TIMES):
    """Every period, word by word."""
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            b = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            own = words[b : i + q]
            smaller = any(own[r:] == own[:-r] for r in range(1, q))
            if len(own) >= max(least, times * q) and not smaller:
                found.add((b, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


repeated = st.lists(
    st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5)), max_size=4
).map(lambda parts: [w for part, n, more in parts for w in (part * (n + 1))[: len(part) * n + more]])


@settings(max_examples=400, deadline=None)
@given(repeated, st.sampled_from([(6, 4), (2, 2), (6, 3), (10, 4)]))
def test_runs_are_those_of_a_plain_search(words, bounds):
    want = plain_runs(words, *bounds)
    if words:
        assert P.runs_in(words, *bounds) == want
    assert P.text_runs([b"w%d" % w for w in words], *bounds) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_ranks_and_extensions(words):
    n = len(words)
    tree = P.SuffixTree(words)
    rank, tour = tree.walk()
    suffixes = sorted(range(n + 1), key=lambda i: words[i:])
    assert [rank[i] for i in suffixes] == list(range(n + 1))
    falling = sorted(range(n + 1), key=lambda i: [-w for w in words[i:]])
    assert [tree.walk(falling=True)[0][i] for i in falling] == list(range(n + 1))
    extend = P.Extensions(rank, tour)
    import numpy as np

    a, b = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    a, b = a[a != b], b[a != b]
    common = lambda i, j: next((k for k in range(n + 1) if words[i + k : i + k + 1] != words[j + k : j + k + 1] or i + k >= n or j + k >= n), 0)
    assert extend(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist())]


def contract(doc_id, text):
    """The query's row, written down plainly."""
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = (None,) * 3
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_against_plain_rows(spark, small):
    got = P.op12_periodic_runs(spark, small)
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 9000]
    want = {r["doc_id"]: contract(r["doc_id"], r["text"]) for r in docs}
    rows = {r["doc_id"]: tuple(r[c] for c in P._DIGEST) for r in got.collect()}
    assert {k: rows[k] for k in want} == want and sum(w[1] for w in want.values()) > 5


def test_odd_texts(spark, frame):
    texts = [None, "", " \n", "a", "a " * 6, "a " * 5, "é日 " * 7, "x y " * 8 + "z " + "x y " * 8, "a " * 6]
    docs = frame([(None if i == 4 else i, t) for i, t in enumerate(texts)])
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in P.find_runs(docs).collect()}
    assert found == {(None, 0, 6, 1), (6, 0, 7, 1), (7, 0, 16, 2), (7, 17, 16, 2), (8, 0, 6, 1)}
    rows = {r["doc_id"]: r for r in P.run_digests(docs, periodic=True).collect()}
    for i, t in enumerate(texts):
        own = None if i == 4 else i
        assert tuple(rows[own][c] for c in P._DIGEST) == contract(own, t)
    assert P.find_runs(docs.limit(0)).count() == P.run_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("period", [1, 7, 30_000])
def test_a_very_long_stretch(period):
    words = [b"%d" % (i % period) for i in range(150_000)]
    assert P.text_runs(words) == [(0, 150_000, period)]

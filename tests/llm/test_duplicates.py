"""Near copies, repeats and benchmark passages against brute force."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as C
from sparkloom.llm import decontamination as B
from sparkloom.llm import near_dedup as N
from sparkloom.llm import repeat_removal as R

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def near_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.setdefault(i, set()).update([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def edited_copies(seed, n):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 160))] for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One TWO"), (5, "a b c d e"), (6, "x " * 3000)]
    for i in range(7, n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize("small", [16, 1])
def test_near_groups(frame, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rows = edited_copies(small, 150)
    got = N.near_duplicates(frame(rows)).collect()
    want = near_groups(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, *want[i]) for i, _ in rows)


def test_stage_keeps_one_of_each_group(spark, frame):
    rows = edited_copies(3, 60)[:-2]
    want = {i for i, (_, _, kept) in near_groups(rows).items() if kept}
    docs = frame(rows)
    out = N.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_stage_removes_rows_and_not_ids(spark, frame):
    copied, reused, other, alone = (" ".join(f"{w}{k}" for k in range(40)) for w in "abcd")
    rows = [(None, copied), (None, alone), (None, alone), (1, copied), (1, copied), (2, copied), (7, "")]
    rows += [(4, reused), (5, reused), (5, other), (6, other), (7, ""), (8, other + " "), (8, alone), (8, alone + " ")]
    want = [(None, copied), (None, alone), (None, alone), (1, copied), (7, ""), (4, reused), (5, other)]
    kept = [(r["doc_id"], r["text"]) for r in N.near_dedup_stage(spark, frame(rows), "").collect()]
    assert len(kept) == len(want) + 1 and sum(r in ((8, alone), (8, alone + " ")) for r in kept) == 1
    assert sorted(map(repr, (r for r in kept if r[0] != 8))) == sorted(map(repr, want))
    named = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(frame(rows)).collect()}
    assert named == {(None, None), (1, 1), (2, 1), (4, 4), (5, 4), (5, 5), (6, 5), (7, 7), (8, 5), (8, 8)}


def test_thresholds(spark, frame):
    base = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(base))]
    for i, edits in ((3, 2), (5, 20)):  # 90 of 110 and 0 of 200 shingles in common
        own = list(base)
        for e in range(edits):
            own[4 + e * 5] = f"e{i}_{e}"
        rows.append((i, " ".join(own)))
    found = {p: [r["component_id"] for r in N.near_duplicates(frame(rows), p).orderBy("doc_id").collect()] for p in (80, 85)}
    assert found == {80: [1, 1, 5], 85: [1, 3, 5]}
    stage = dict(C.STAGES)["near-duplicate removal"]
    assert {r["doc_id"] for r in stage(spark, frame(rows), "").collect()} == {1, 5}
    assert N.banding(85) == (36, 7) and N.banding(80) == (42, 6)


def test_empty_tables(spark, frame):
    empty = frame([(1, "x")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    assert R.remove_repeats(empty).count() == 0
    assert B.contamination(empty, bench).count() == 0
    assert B.contamination(frame([(1, "a b")]), bench).first()["contaminated"] is False


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (N.sketch(np.unique(a)) == N.sketch(np.unique(b))).sum()
    assert abs(float(N.estimate(np.array(same))) - 1800 / 2200) < 0.1


def chains(n):
    return [(i, i + 1) for i in range(n)] + [(1000 + i, 2000 + i) for i in range(3)]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame(chains(70), "a long, b long")
    labels = {r["rep"]: r["label"] for r in N.components(df).collect()}
    assert {labels[i] for i in range(71)} == {0} and labels[2001] == 1001


def removed(rows, length):
    seen, out, first = {}, {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        if i in first:
            continue
        first[i] = b
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                cover[s : s + length] = b"\1" * length
            seen.setdefault(k, i)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = len(re.findall(b"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd efgh") for _ in range(700)) for _ in range(4)]
    rows = [(1000, None), (1001, ""), (1002, "short"), (1003, "-" * 5000), (1004, "é" * 300)]
    for i in range(60):
        b, a = rng.choice(base), rng.randrange(500)
        x = b[a : a + rng.randrange(400)]
        if rng.random() < 0.4:
            x += "".join(rng.choice("xyzé") for _ in range(rng.randrange(60))) + b[a : a + rng.randrange(90, 200)]
        if rng.random() < 0.3 and len(x) > 50:
            p = rng.randrange(len(x))
            x = x[:p] + "#" + x[p + 1 :]
        rows.append((i, x))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize("seed, large, batch", [(1, 100_000, 20_000), (2, 3, 20_000), (3, 100_000, 5)])
def test_repeats_removed(spark, frame, monkeypatch, seed, large, batch):
    monkeypatch.setattr(R, "LARGE", large)
    monkeypatch.setattr(R, "BATCH", batch)
    rows = repeats(seed)
    got = R.remove_repeats(frame(rows).repartition(3)).collect()
    mine = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    want = removed(rows, R.LENGTH)
    assert mine == sorted((i, *want[i]) for i, _ in rows)


def test_prefix_intervals_are_all_there():
    lcp = [3, 5, 5, 2, 0, 4]
    found = set(R.prefix_intervals(lcp, 2))
    want = set()
    for a in range(len(lcp)):
        for b in range(a, len(lcp)):
            low = min(lcp[a : b + 1])
            left = lcp[a - 1] if a else -1
            right = lcp[b + 1] if b + 1 < len(lcp) else -1
            if low >= 2 and left < low and right < low:
                want.add((a, b + 1, low))
    assert found == want


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().translate(LOWER))


def contaminated(rows, bench):
    windows = {}
    for item, t in bench:
        w = words(t)
        for s in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                if k in windows:
                    hit.update(range(s, s + size))
                    items |= windows[k]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_benchmark_windows(spark, frame, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(B, "SEGMENT_BYTES", 400)
    rng = random.Random(block)
    vocabulary = [f"W{i}" for i in range(12)] + ["É", "naïve"]
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 10, 11, 25])))) for k in range(12)]
    bench += [(12, None), (3, bench[3][1]), (13, "W1 W2")]
    rows = [(0, None), (1, ""), (2, "..."), (3, "w1-w2")]
    for i in range(4, 60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15))), rng.choice(bench)[1] or "", rng.choice(bench)[1] or ""]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(parts).lower()))
    rows.append(rows[-1])
    found = B.contamination(frame(rows), spark.createDataFrame(bench, "item_id long, text string")).drop("text_key")
    assert sorted(map(tuple, found.collect())) == contaminated(rows, bench)


def near(rows, bench, slop):
    """Rows with a window of which each word is within ``slop`` of its place
    from some start that its rarest word in the corpus fixes."""
    counts = {}
    for _, t in rows:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    out = set()
    for i, t in rows:
        own = words(t)
        for _, b in bench:
            for s in range(max(len(words(b)) - 10, 0) + 1):
                window = words(b)[s : s + 10]
                local = sorted(range(len(window)), key=lambda k: (own.count(window[k]), k))
                for p in (p for p, w in enumerate(own) if w == window[local[0]]):
                    at = p - local[0]
                    if all(window[k] in own[max(0, at + k - slop) : max(0, at + k + slop + 1)] for k in local[1:]):
                        out.add(i)
    return out


@pytest.mark.parametrize("slop, candidates", [(0, 1 << 19), (1, 7), (3, 50)])
def test_proximity_against_brute_force(spark, frame, monkeypatch, slop, candidates):
    monkeypatch.setattr(B, "CANDIDATES", candidates)
    monkeypatch.setattr(B, "BLOCK_WINDOWS", 20)
    rng = random.Random(slop)
    digits = [" ".join(rng.choice("0123") for _ in range(rng.randrange(5, 30))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice("0123") for _ in range(rng.randrange(3, 40)))) for i in range(40)]
    rows += [(100 + i, "9 9 " + d + " 8") for i, d in enumerate(digits)]
    monkeypatch.setattr(B, "SEGMENT_BYTES", 1)  # one text in each segment, as the brute force counts
    bench = spark.createDataFrame(list(enumerate(digits)), "item_id long, text string")
    found = {r["doc_id"] for r in B.matches(frame(rows), bench, slop=slop).where("size(spans) > 0").collect()}
    assert found == near(rows, list(enumerate(digits)), slop)


def test_proximity(spark, frame):
    docs = frame([(1, "a b c d e"), (2, "a x b c d y e"), (3, "e d c b a")])
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    exact = {r["doc_id"] for r in B.matches(docs, bench).where("size(spans) > 0").collect()}
    loose = {r["doc_id"] for r in B.matches(docs, bench, slop=2).where("size(spans) > 0").collect()}
    assert (exact, loose) == ({1}, {1, 2})


def test_item_without_id_counts_under_an_empty_one(spark, frame):
    bench = spark.createDataFrame([(None, "w0 w1"), (4, "w1 w2")], "item_id long, text string")
    row = B.contamination(frame([(1, "w0 w1 w2")]), bench).first()
    assert (row["n_items"], row["items_sha256"]) == (2, hashlib.sha256(b",4").hexdigest())


def test_null_ids_do_not_escape(spark, frame):
    docs = frame([(None, "w0 w1 w2"), (1, "other")])
    bench = spark.createDataFrame([(1, "w0 w1 w2")], "item_id long, text string")
    hit = B.contamination(docs, bench).where("contaminated").collect()
    assert [r["doc_id"] for r in hit] == [None]


@pytest.mark.parametrize("block", [2_000_000, 1])
def test_stage_keeps_clean_rows_of_an_id(spark, frame, monkeypatch, tmp_path, block):
    monkeypatch.setattr(B, "BLOCK_WINDOWS", block)
    bench = [(1, "w0 w1 w2"), (2, "v0 v1 v2"), (3, "u0 u1")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, "nothing here"), (None, None), (5, "other"), (5, "other"), (6, "")]
    docs = frame([*clean, (None, "so w0 w1 w2"), (5, "V0 v1 v2"), (7, "u0 u1"), (7, "u0 u1")])
    out = B.decontamination_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, clean))

"""Packing and token output: exact round trips and bounds."""

import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import sequence_packing as S
from sparkloom.llm import token_output as O
from sparkloom.llm import tokens as T

TEXTS = [None, "", "a", "Hello <|endoftext|> wörld", "日本語 и русский", "word " * 3000, "x y z " * 700, "dup", "dup"]


@pytest.fixture(scope="module")
def docs(frame):
    return frame([(i if t != "dup" else 99, t) for i, t in enumerate(TEXTS)])


def reference_ids():
    tokenizer = T.tokenizer_of()
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [T.END] for t in TEXTS]


def test_cut_texts_have_the_ids_of_whole_ones():
    rng, tokenizer, encode = random.Random(1), T.tokenizer_of(), T.Encoder()
    parts = list("abZ09,.!?;:'\"-() \n\t\r\x0b\x1c\x1f\x85\xa0éß×÷ñÿŽжΩא中日\u2003\u3000\u200b\ufeff\u180e😀")
    parts += ["  ", "'s", "'t", " the", "<|endoftext|>", "\n ", " \xa0", "http://x.com", "¿Qué", " word"]
    for _ in range(400):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [T.END] for t in texts]
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == want
    whole = encode([(t or "").encode() for t in TEXTS])
    assert [x.tolist() for x in whole] == reference_ids()


def test_forgetful_encoder(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    encode = T.Encoder()
    for _ in range(3):
        assert [x.tolist() for x in encode([(t or "").encode() for t in TEXTS])] == reference_ids()


def test_known_chunks_are_looked_up_together(monkeypatch):
    learned, plain = [], T.Encoder._chunk_ids
    monkeypatch.setattr(T.Encoder, "_chunk_ids", lambda self, chunks: learned.append(len(chunks)) or plain(self, chunks))
    encode, texts = T.Encoder(), [b"one two, three", b"two three two", b"one"]
    first = [x.tolist() for x in encode(texts)]
    assert [x.tolist() for x in encode(texts)] == first
    assert learned == [5]  # "one", " two", ",", " three", "two"; nothing the second time


def test_chunk_memory_is_exact_and_forgets():
    rng, memory = random.Random(3), T.ChunkMemory()
    said = [bytes(rng.choices(b"\0a ", k=rng.randrange(1, T.LONGEST + 1))) for _ in range(9000)]
    said += [b"a" + bytes(k) for k in range(T.LONGEST)]  # told apart by their length alone
    for turn in range(12):
        chunks = list(dict.fromkeys(rng.sample(said, 2500)))
        size = np.array([len(c) for c in chunks])
        low, high = T.chunk_keys(b"".join(chunks) + bytes(16), np.cumsum(size) - size, size)
        memory.forget(4000 if turn % 6 else 0)
        number = memory.find(low, high)
        assert turn % 6 or (number < 0).all()
        at, count = memory.spans(number)
        new = number < 0
        flat = [x for c, n in zip(chunks, new) if n for x in c]
        at[new] = memory.add(low[new], high[new], size[new], np.array(flat, dtype="<u4"))
        count[new] = size[new]
        assert memory.gather(at, count).tolist() == list(b"".join(chunks))
        assert len(set(memory.find(low, high).tolist()) - {-1}) == len(chunks)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_whole_and_gapless(docs):
    rows = S.pack_documents(docs).collect()
    n = check_layout(rows, S.CAPACITY)
    want = sorted((i if t != "dup" else 99, p, s, k, zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes()))
                  for i, (t, ids) in enumerate(zip(TEXTS, reference_ids())) for p, (s, k) in enumerate(T.cut(len(ids), S.CAPACITY)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert n == -(-sum(w[3] for w in want) // S.CAPACITY)


def test_empty_table(docs):
    assert S.pack_documents(docs.limit(0)).count() == 0
    assert O.packed_sequences(docs.limit(0)).count() == 0


def test_search_beats_best_fit_and_keeps_items():
    rng = np.random.default_rng(4)
    for seed in range(5):
        sizes = rng.integers(1, 700, 400)
        start = S.best_fit(sizes, 1000)
        found = S.pack(sizes, 1000)
        assert sorted(i for b in found for i in b) == list(range(400))
        assert all(sizes[b].sum() <= 1000 for b in found)
        assert len(found) <= len(start)
        assert sum(sizes[b].sum() ** 2 for b in found) >= sum(sizes[b].sum() ** 2 for b in start)


def test_search_empties_a_bin():
    sizes = np.array([6, 4, 5, 5, 3, 7])
    bins = S.SwapSearch(sizes, [[0, 4], [1, 2], [3], [5]], 10).run()
    assert len(bins) == 3


def test_second_round(docs, monkeypatch):
    monkeypatch.setattr(S, "GROUP_PIECES", 2)
    rows = S.pack_documents(docs).collect()
    check_layout(rows, S.CAPACITY)
    assert len(rows) == sum(len(T.cut(len(ids), S.CAPACITY)) for ids in reference_ids())


def test_best_fit_decreasing_takes_the_tightest_room():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    rooms, want = [], 0
    for s in sizes:
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(100 - s)
            want += 1
    found = O.best_fit_decreasing(sizes, 100)
    assert len(found) == want and all(sum(sizes[i] for i in s) <= 100 for s in found)


def test_matrices_hold_every_document(docs):
    rows = O.packed_sequences(docs).collect()
    ids, positions = O.id_matrix([r["input_ids"] for r in rows]), O.id_matrix([r["position_ids"] for r in rows])
    parts = {}
    for k, r in enumerate(rows):
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= O.CAPACITY
        assert (ids[k, r["n_tokens"] :] == O.PAD).all()
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            assert positions[k, a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[k, a:b].tolist()))
    for i, (text, want) in enumerate(zip(TEXTS, reference_ids())):
        if text == "dup":
            assert parts[99] == [(0, want)] * 2
        else:
            assert [x for _, p in sorted(parts[i]) for x in p] == want

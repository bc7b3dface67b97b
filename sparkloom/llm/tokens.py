"""Token ids of whole texts with the public byte-level BPE vocabulary.

All ids come from the ``tokenizers`` library with its default settings. Texts
repeat their words, so a batch is cut where no token can reach across, and a
bounded memory of chunks and their ids is kept by the worker for all tasks of a
stage; chunks of a batch are looked up together. The cuts:

* before a single space or line feed between two characters that are not white
  space (a token holds white space only as its first character or throughout),
  and after such a line feed;
* between a letter or digit and one of ``,.!?;:``.

Only characters whose class is beyond doubt count as such neighbours; all else
stays inside its chunk. A text with a special token is encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from tokenizers import Tokenizer

from .common import forget_with
from .kernels import mix64

JSON_FILE = "byte_bpe_50k.json"
#: Fixed value: the id that ends every document.
END = 2
#: Chunks kept, about 60 bytes each: when there are more, those not met again since
#: the last time are forgotten.
REMEMBERED = 2_000_000
#: Bytes of the longest chunk kept. Two 64-bit words hold it and its length.
LONGEST = 15
#: Bytes of text encoded at a time; about 80 bytes of memory for each of them.
SLICE = 1 << 19


def tokenizer_of(name: str = JSON_FILE) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(public_tokenizers.path(name))


def _table(*parts: bytes | range) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    for part in parts:
        found[list(part)] = True
    return found


_PLAIN = _table(range(0x21, 0x7F))
#: First bytes of two-byte characters from U+00C0; none of these is white space.
_LEAD = _table(range(0xC3, 0xE0))
_LETTER = _table(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B))
_MARK = _table(b",.!?;:")


#: The same classes as bits of one byte.
_CLASS = (_PLAIN + 2 * _LEAD + 4 * _LETTER + 8 * _MARK).astype(np.uint8)


def chunk_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks start in texts laid end to end (``first``: their starts)."""
    n = len(data)
    here = np.zeros(n + 3, dtype=np.uint8)  # two bytes more before, one behind
    here[2:-1] = data
    kind = _CLASS[here]
    before, after = here[1:-2], kind[3:]
    lead = kind[:-3] & 2 != 0  # the byte before ends a character from U+00C0 to U+07FF
    plain = kind[1:-2] & 1 != 0
    solid = (plain | lead) & (after & 3 != 0)
    line = (data == 0x0A) & solid
    letter = (kind[1:-2] & 4 != 0) | (lead & (before != 0x97) & (before != 0xB7))
    letter[2:] &= plain[2:] | (data[:-2] == 0xC3)
    cut = line | ((data == 0x20) & solid) | ((kind[2:-1] & 8 != 0) & letter)
    cut[1:] |= line[:-1]
    cut[first[first < n]] = True
    return np.flatnonzero(cut)


#: The first k bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def chunk_keys(padded: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each chunk of at most LONGEST bytes: its bytes, and its length
    in the last of the 16. Equal words are equal chunks. ``padded`` ends with 16
    bytes more."""
    every = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,)).copy()
    low = every[start] & _FIRST_BYTES[np.minimum(size, 8)]
    high = every[start + 8] & _FIRST_BYTES[np.clip(size - 8, 0, 8)]
    return low, high | (size.astype(np.uint64) << np.uint64(56))


class ChunkMemory:
    """Ids of chunks by their keys, all looked up at once: a hash table of chunk
    numbers with linear probing, at most half full."""

    def __init__(self) -> None:
        self._low, self._high = (np.empty(1024, dtype=np.uint64) for _ in range(2))
        self._at, self._count = np.empty(1024, dtype=np.int32), np.empty(1024, dtype=np.uint8)
        self._met = np.empty(1024, dtype=bool)
        self._ids = np.empty(4096, dtype="<u4")
        self._set(0, 0)

    def _set(self, chunks: int, ids: int) -> None:
        """Number the first ``chunks`` of the arrays anew."""
        self._n, self._n_ids = 0, ids
        self._table = np.full(max(4096, 1 << (2 * chunks).bit_length()), -1, dtype=np.int32)
        self._enter(chunks)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ mix64(high)) & np.uint64(len(self._table) - 1)).astype(np.int64)

    def _enter(self, chunks: int) -> None:
        """Put the next ``chunks`` of the arrays, none of them known, into the table."""
        new = np.arange(self._n, self._n + chunks)
        slot = self._slots(self._low[new], self._high[new])
        self._n += chunks
        while len(new):
            free = self._table[slot] < 0
            self._table[slot[free]] = new[free]  # of several for one slot, one stays
            out = self._table[slot] != new
            new, slot = new[out], (slot[out] + 1) & (len(self._table) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each chunk, -1 for unknown ones."""
        out = np.full(len(low), -1, dtype=np.int64)
        place, slot = np.arange(len(low)), self._slots(low, high)
        while len(place):
            number = self._table[slot]
            held = number >= 0
            if not held.all():
                place, slot, number = place[held], slot[held], number[held]
            same = (self._low[number] == low[place]) & (self._high[number] == high[place])
            out[place[same]] = number[same]
            other = ~same
            place, slot = place[other], (slot[other] + 1) & (len(self._table) - 1)
        self._met[out[out >= 0]] = True
        return out

    def spans(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of chunks are, and how many; zeros for unknown ones."""
        at, count = np.zeros((2, len(number)), dtype=np.int64)
        known = np.flatnonzero(number >= 0)
        at[known], count[known] = self._at[number[known]], self._count[number[known]]
        return at, count

    def add(self, low: np.ndarray, high: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keep the first ``len(low)`` chunks, which are distinct and unknown; ``ids``
        may hold those of more chunks, which stay until the next call. Returns
        where the ids of each are."""
        n, at = self._n + len(low), self._n_ids + np.cumsum(count) - count
        self._reserve(n, self._n_ids + len(ids))
        self._ids[self._n_ids : self._n_ids + len(ids)] = ids
        for held, new in ((self._low, low), (self._high, high), (self._at, at[: len(low)]), (self._count, count[: len(low)])):
            held[self._n : n] = new
        self._met[self._n : n] = False
        self._n_ids += int(count[: len(low)].sum())
        if 2 * n > len(self._table):
            self._set(n, self._n_ids)
        else:
            self._enter(len(low))
        return at

    def _reserve(self, chunks: int, ids: int) -> None:
        if ids > len(self._ids):
            self._ids = np.concatenate((self._ids[: self._n_ids], np.empty(ids + ids // 4 - self._n_ids, dtype="<u4")))
        if chunks > len(self._low):
            for name in ("_low", "_high", "_at", "_count", "_met"):
                held = getattr(self, name)[: self._n]
                setattr(self, name, np.concatenate((held, np.empty(chunks + chunks // 4 - self._n, dtype=held.dtype))))

    def gather(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of these spans, one after the other."""
        ends = np.cumsum(count)
        return self._ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + count, count)]

    def forget(self, most: int) -> None:
        """With more than ``most`` chunks, keep those met again since the last time,
        and no more than half of ``most``."""
        if self._n <= most:
            return
        kept = np.flatnonzero(self._met[: self._n])[: most // 2]
        at, count = self.spans(kept)
        self._ids = self.gather(at, count)
        self._low, self._high, self._count = self._low[kept], self._high[kept], self._count[kept]
        self._at = (np.cumsum(count) - count).astype(self._at.dtype)
        self._met = np.zeros(len(kept), dtype=bool)
        self._set(len(kept), len(self._ids))


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, json_file: str = JSON_FILE) -> None:
        self._tokenizer = tokenizer_of(json_file)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._with_space = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self._tokenizer.get_vocab().items():
            self._with_space[k] = token.startswith("Ġ")
        self._memory = ChunkMemory()

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        plain = [t.decode("utf-8", "replace") for t in texts]
        return [e.ids for e in self._tokenizer.encode_batch_fast(plain, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks, four bytes each. Those that begin with their only
        space are encoded side by side: each of them has one token with a space."""
        joined = [c for c in chunks if c[0] == 0x20 and c.rfind(b" ") == 0]
        found = dict(zip(joined, self._side_by_side(joined))) if joined else {}
        rest = [c for c in chunks if c not in found]
        found.update((c, np.array(x, dtype="<u4").tobytes()) for c, x in zip(rest, self._ids(rest)))
        return [found[c] for c in chunks]

    def _side_by_side(self, chunks: list[bytes]) -> list[bytes]:
        ids = np.array(self._ids([b"".join(chunks)])[0], dtype="<u4")
        at = np.flatnonzero(self._with_space[ids])
        if len(at) != len(chunks):
            return [np.array(x, dtype="<u4").tobytes() for x in self._ids(chunks)]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip((4 * at).tolist(), [*(4 * at[1:]).tolist(), len(flat)])]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its uint32 ids, then the id that ends a document."""
        whole = {k: t for k, t in enumerate(texts) if any(s in t for s in self._special)}
        out = self._cut([b"" if k in whole else t for k, t in enumerate(texts)])
        for k, ids in zip(whole, self._ids(list(whole.values()))):
            out[k] = np.array([*ids, END], dtype="<u4")
        return out

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        padded = b"".join([*texts, bytes(16)])
        data = np.frombuffer(padded, dtype=np.uint8)[:-16]
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        start = chunk_starts(data, first[:-1])
        end = np.append(start[1:], len(data))[: len(start)]
        of_text = np.searchsorted(start, first)
        memory, size = self._memory, end - start
        memory.forget(REMEMBERED)
        low, high = chunk_keys(padded, start, size)
        number = np.full(len(start), -1, dtype=np.int64)
        short = size <= LONGEST
        number[short] = memory.find(low[short], high[short])
        at, n = memory.spans(number)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            at[miss], n[miss] = self._learn(padded, start[miss], end[miss], low[miss], high[miss])
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = memory.gather(at, n)
        bounds = ends[of_text].tolist()
        tail = np.array([END], dtype="<u4")
        return [np.concatenate((ids[a:b], tail)) for a, b in zip(bounds, bounds[1:])]

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode unknown chunks, each distinct one once, and keep the short ones;
        where the ids of each are, and how many."""
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())])
        one = np.unique(of, return_index=True)[1]
        long = end[one] - start[one] > LONGEST
        order = np.argsort(long, kind="stable")  # short ones first
        chunks = list(known)
        found = self._chunk_ids([chunks[k] for k in order.tolist()])
        count = np.array([len(x) for x in found], dtype=np.int64) // 4
        kept = one[order[: len(order) - int(long.sum())]]
        at = self._memory.add(low[kept], high[kept], count, np.frombuffer(b"".join(found), dtype="<u4"))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return at[place[of]], count[place[of]]


_shared: dict[int, Encoder] = {}


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def _forget() -> None:
    """Frees the encoder of a stage that is over."""
    if _shared and _stage() not in _shared:
        _shared.clear()


forget_with(_forget)


def shared_encoder() -> Encoder:
    """The worker's encoder for this stage, with what earlier tasks have met."""
    _forget()
    if not _shared:
        _shared[_stage()] = Encoder()
    return _shared[_stage()]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: one piece if it
    fits, else a first piece with what is left over and then full pieces."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return [(0, first)] * (first > 0) + [(s, most) for s in range(first, n, most)]

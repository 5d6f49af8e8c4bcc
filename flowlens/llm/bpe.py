"""Byte-level BPE with a two-tier lookup.

Tier one resolves whole pre-tokens that are vocabulary entries: a minimal perfect hash (hash and displace) gives each of
the n entries its own slot of n, and one comparison of bytes tells an entry from any other text. Tier two merges the bytes
of the remaining pre-tokens with a heap of adjacent pairs over a doubly linked list, O(n log n) for a pre-token of n bytes.

Both tiers see a distinct pre-token once per group of texts; results stay in a memo of two bounded generations, so that frequent
pre-tokens outlive the many that occur once. Documents are independent, so
the operators are narrow: no shuffle, no state but the vocabulary, lost tasks are simply run again. A very long text is cut
where the pattern splits anyway, so memory is bounded by the group size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import GROUP_CHARS, groups

#: Distinct pre-tokens in each of the two generations that a task remembers; about 250 bytes each.
MEMO = 200_000
#: Bytes of text of one batch of results; a longer text is a batch of its own.
SLICE = 1_000_000
_MASK = (1 << 64) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PerfectHash:
    """Minimal perfect hash over byte strings: ``slots(keys)`` is a bijection of the entries onto 0..n-1."""

    def __init__(self, keys: list[bytes]):
        self.n = self.buckets = len(keys)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, self.n)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two entries share a 64-bit hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        members: dict[int, list[int]] = {}
        for b, h in zip(bucket.tolist(), hashes.tolist()):
            members.setdefault(b, []).append(h)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, lone = bytearray(self.n), []
        for b, group in sorted(members.items(), key=lambda item: -len(item[1])):
            if len(group) == 1:
                lone.append(b)
                continue
            shift = 0
            while True:
                at = {self._slot(h, shift) for h in group}
                if len(at) == len(group) and not any(taken[slot] for slot in at):
                    break
                shift += 1
            for slot in at:
                taken[slot] = 1
            self.shift[b] = shift
        self.shift[lone] = -1 - np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)  # a lone entry names its slot

    def _slot(self, h: int, shift: int) -> int:
        x = h ^ (shift * 0x9E3779B97F4A7C15 & _MASK)
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
        return (x ^ (x >> 29)) % self.n

    def _place(self, hashes: np.ndarray, shift) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes ^ (shift * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0).astype(np.uint64)))


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.flat = np.frombuffer(b"".join(pieces.values()), np.uint8)
        self.size = np.zeros(max(pieces) + 1, np.int64)
        self.size[list(pieces)] = [len(piece) for piece in pieces.values()]
        self.place = np.zeros_like(self.size)
        self.place[list(pieces)] = np.cumsum([0, *map(len, pieces.values())])[:-1]
        self.pattern = regex.compile(pattern)
        entries = list(self.ranks)
        self.hash = PerfectHash(entries)
        self.slot_entry: list[bytes] = [b""] * len(entries)
        for slot, entry in zip(self.hash.slots(entries).tolist(), entries):
            self.slot_entry[slot] = entry
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost among equals."""
        get, push, pop, n = self.ranks.get, heapq.heappush, heapq.heappop, len(piece)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the part at i joined with the next one
        pair[-1] = -1
        heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & mask
            if pair[i] != top >> shift:
                continue  # a neighbour has merged since
            gone = end[i]
            end[i] = stop = end[gone]
            pair[gone] = -1
            if stop < n:
                before[stop] = i
                pair[i] = rank = get(piece[i : end[stop]], -1)
                if rank >= 0:
                    push(heap, rank << shift | i)
            else:
                pair[i] = -1
            if (p := before[i]) >= 0:
                pair[p] = rank = get(piece[p:stop], -1)
                if rank >= 0:
                    push(heap, rank << shift | p)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of all these pre-tokens into the memo; a full memo becomes the old one, from which they move on."""
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.old, self.memo, new = self.memo, {}, words
        for word in new & self.old.keys():
            self.memo[word] = self.old[word]
        new = [word for word in new if word not in self.memo]
        if not new:
            return
        keys = [w.encode() for w in new]
        for word, key, slot in zip(new, keys, self.hash.slots(keys).tolist()):
            ids = [self.ranks[key]] if self.slot_entry[slot] == key else self.merge(key)
            self.memo[word] = pack(f"<{len(ids)}I", *ids)

    def _known(self, texts: list[str]) -> Iterator[Iterator[Iterator[bytes]]]:
        """For each text its parts, for each part the ids of its pre-tokens."""
        for start, stop in groups(texts):
            if stop - start == 1:
                yield map(self._part, segments(texts[start]))
            else:
                split = [self.pattern.findall(text) for text in texts[start:stop]]
                self._learn(set(chain.from_iterable(split)))
                for words in split:
                    yield iter([map(self.memo.__getitem__, words)])

    def _part(self, segment: str) -> Iterator[bytes]:
        words = self.pattern.findall(segment)
        self._learn(set(words))
        return map(self.memo.__getitem__, words)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return (b"".join(map(b"".join, parts)) for parts in self._known(texts))

    def count_all(self, texts: list[str]) -> Iterator[int]:
        """The number of ids of each text."""
        return (sum(sum(map(len, part)) for part in parts) // 4 for parts in self._known(texts))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where each id's bytes end; an unknown id raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)) or not (size := self.size[ids]).all():
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(size)
        made = np.empty(int(ends[-1]) if len(ids) else 0, np.uint8)
        for i in range(0, len(ids), SLICE):  # a bounded part of a long text at a time
            part = slice(i, i + SLICE)
            first = int(ends[i] - size[i])
            stop = int(ends[part][-1])
            at = np.repeat(self.place[ids[part]] - (ends[part] - size[part]), size[part])
            made[first:stop] = self.flat[at + np.arange(first, stop)]
        return made, ends

    def decode_rows(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """One value of bytes per row, from the ids of all rows one after the other."""
        made, ends = self.decode(ids)
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(made)]
        return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def segments(text: str, limit: int = GROUP_CHARS) -> Iterator[str]:
    """Cuts before single spaces between other characters, where the pattern ends a match in any case."""
    start = 0
    while len(text) - start > limit and (cut := _CUT.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE`` bytes of text, so that results never gather for a whole batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > SLICE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def encode(df: DataFrame, column: str = "text", out: str | None = "ids", path: str | None = None,
           pattern: str | None = None, packed: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with ``out``, the token ids of ``column`` as an array of int; null text has no ids, special tokens are text.

    Without ``out`` there is no such column. ``packed`` names one more column for the ids as little-endian unsigned 32-bit integers, ``decoded`` one for the bytes
    that the ids decode to, made in the same pass. A column with one of these names is replaced. Rows are independent:
    repeated rows, ties and empty tables need no care.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    extra = [name for name in (packed, decoded) if name]
    arrays = [out] if out else []
    rest = [name for name in df.columns if name not in (*arrays, *extra)]

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in (part for whole in batches for part in _slices(whole, column)):
            texts = [text or "" for text in batch.column(column).to_pylist()]
            rows = list(vocab.encode_all(texts))
            sizes, ids, made = [len(p) // 4 for p in rows], np.frombuffer(b"".join(rows), "<i4"), []
            if out:
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + sizes).astype(np.int32)), pa.array(ids)))
            if packed:
                made.append(pa.array(rows, pa.binary()))
            if decoded:
                made.append(vocab.decode_rows(ids, np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + made, names=[*rest, *arrays, *extra])

    fields = [*df.select(*rest).schema.fields, *(T.StructField(name, T.ArrayType(T.IntegerType())) for name in arrays),
              *(T.StructField(name, T.BinaryType()) for name in extra)]
    return df.select(*dict.fromkeys([*rest, column])).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, column: str = "ids", out: str = "decoded", packed: str | None = None,
           path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``out``, the bytes that the ids stand for (no ids or null: no bytes).

    ``packed`` names one more column for the ids as little-endian unsigned 32-bit integers.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    more = [out] + ([packed] if packed else [])
    rest = [name for name in df.columns if name not in more]

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            ids = batch.column(column)
            values, ends = ids.flatten().to_numpy(zero_copy_only=False), np.zeros(len(ids) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False),
                      out=ends[1:])
            values = np.asarray(values, np.int64)
            texts = vocab.decode_rows(values, np.diff(ends))
            raw = [values[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())] if packed else []
            made = [texts] + ([pa.array(raw, pa.binary())] if packed else [])
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + made, names=rest + more)

    kept = df.select(*rest)
    fields = [*kept.schema.fields, *(T.StructField(name, T.BinaryType()) for name in more)]
    return df.mapInArrow(run, T.StructType(fields))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, n_tokens, and hashes of the packed ids and of the decoded bytes."""
    made = encode(docs.select("doc_id", "text"), "text", None, packed="packed", decoded="decoded")
    return made.select("doc_id", F.expr("octet_length(packed) div 4").alias("n_tokens"),
                       F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

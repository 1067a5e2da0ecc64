"""Operator 8, byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves, for a batch of distinct pre-tokens at once, those that
are a token as a whole. Tier two: a miss is merged with a heap of neighbouring pairs over doubly linked byte spans,
always the lowest rank, then the leftmost. What a pre-token (or a blank-separated run of them) encodes to is kept in
memos of bounded size, which change nothing but the time; long ones are not kept. Results equal those of the tiktoken library without special
tokens; decoding joins the tokens' bytes and gives the text's bytes back.

Defined cases: a null text counts as empty and has no ids. Any text encodes, as every byte is a token; very long texts,
also without blanks, are encoded whole. Rows that repeat are encoded each. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, read_table, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of each of a worker's memos, and characters of an entry; beyond the first they begin anew, beyond the second nothing is kept. So at most some 100 MB.
MEMO, MEMO_CHARS = 400_000, 48
#: White space by which a text can't be cut at single blanks.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(t), int(r)) for t, r in (line.split() for line in f if line.strip())]
    out = [b""] * (max(r for _, r in pairs) + 1)
    for t, r in pairs:
        out[r] = t
    return out


class PerfectHash:
    """A minimal perfect hash by bucket displacement: n keys to n slots, each the rank of the one key that can lie there."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[by_bucket], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)  # a displacement, or -1 - slot for a bucket of one key
        self.slots = np.full(n, -1, np.int64)
        size = np.diff(begin)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            rows, d, fits = by_bucket[begin[b] : begin[b + 1]], 0, None
            while fits is None or not len(fits):  # 32 displacements at a time
                at = self._place(h[rows], np.arange(d, d + 32)[:, None])
                ordered = np.sort(at, axis=1)
                fits = np.flatnonzero((self.slots[at] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                d += 32
            self.shift[b], self.slots[at[fits[0]]] = d - 32 + fits[0], rows
        free = np.flatnonzero(self.slots < 0)
        ones = np.flatnonzero(size == 1)
        self.shift[ones] = -1 - free[: len(ones)]
        self.slots[free[: len(ones)]] = by_bucket[begin[ones]]
        self.prints = h[self.slots]

    def _place(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def ranks(self, keys: list[bytes]) -> np.ndarray:
        """The rank that each key would have; the caller compares the token itself. -1: surely none."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._place(h, np.maximum(d, 0)))
        return np.where(self.prints[slot] == h, self.slots[slot], -1)


def merge(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The ids of a piece: merges of the lowest-ranked neighbours, by a heap over linked spans."""
    n = len(piece)
    get = rank_of.get
    end = list(range(1, n + 1))  # of the span that starts here
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        r, i, stop = heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != stop:  # one of the two has been merged meanwhile
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            prev[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes by a vocabulary and a pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str, perfect: PerfectHash | None = None):
        self.vocabulary = vocabulary
        self.rank_of = {t: r for r, t in enumerate(vocabulary)}
        self.hash = perfect or PerfectHash(vocabulary)
        self.findall = regex.compile(pattern).findall
        self.by_blanks = self._splits_at_blanks()
        self.one: dict[str, bytes] = {}  # by pre-token
        self.run: dict[str, bytes] = {}  # by what stands between single blanks

    def _splits_at_blanks(self) -> bool:
        """Whether the pattern cuts before each single blank, whatever stands beside it; tried on all pairs of kinds of characters."""
        kinds = ("a", "Z", "\u00e9", "\u4e2d", "7", "\u00b2", "!", "'s", "_", "\U0001f600", "\u0301", "a\n", "\n", "$", "<")
        return all(self.findall(f"{x} {y}") == self.findall(x) + self.findall(f" {y}") for x in kinds for y in kinds if not x.endswith("\n") and not y.startswith("\n"))

    def _codes(self, pieces: set[str]) -> dict[str, bytes]:
        """A table with the ids of all pieces: the memo, or where pieces are long or many one of their own."""
        new = [p for p in pieces if p not in self.one]
        if not new:
            return self.one
        raw = [p.encode() for p in new]
        vocabulary, rank_of, found = self.vocabulary, self.rank_of, {}
        for p, b, r in zip(new, raw, self.hash.ranks(raw).tolist()):
            if r >= 0 and vocabulary[r] == b:
                found[p] = r.to_bytes(4, "little")
            else:
                found[p] = np.array(merge(b, rank_of), "<u4").tobytes()
        if len(self.one) + len(new) > MEMO or max(map(len, new)) > MEMO_CHARS:
            table = {p: self.one[p] for p in pieces if p not in found} | found
            if len(self.one) + len(new) > MEMO:
                self.one.clear()
            self.one.update((p, c) for p, c in found.items() if len(p) <= MEMO_CHARS)
            return table
        self.one.update(found)
        return self.one

    def _whole(self, text: str) -> bytes:
        pieces = self.findall(text)
        return b"".join(map(self._codes(set(pieces)).__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_blanks or "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            return self._whole(text)
        # No pre-token goes on over a single blank, and what precedes it doesn't matter to what follows.
        first, *rest = text.split(" ")
        table = self.run
        new = set(rest).difference(table)
        if new:
            split = {c: self.findall(" " + c) for c in new}
            one = self._codes({p for ps in split.values() for p in ps})
            found = {c: one[ps[0]] if len(ps) == 1 else b"".join([one[p] for p in ps]) for c, ps in split.items()}
            if len(table) + len(new) > MEMO or max(map(len, new)) > MEMO_CHARS:
                table = {c: table[c] for c in set(rest) if c not in found} | found
                if len(self.run) + len(new) > MEMO:
                    self.run.clear()
                self.run.update((c, x) for c, x in found.items() if len(c) <= MEMO_CHARS)
            else:
                table.update(found)
        return self._whole(first) + b"".join(map(table.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(vocabulary: list[bytes], pattern: str, perfect: PerfectHash | None = None) -> Codec:
    """One codec a worker."""
    key = (xxhash.xxh3_64_intdigest(b"\0".join(vocabulary)), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern, perfect)
    return _codecs[key]


def encoded(docs: DataFrame, path: str, pattern: str, digests_only: bool = False) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_tokens, ids_sha256, decoded_sha256) and, unless only digests are wanted, ids array<int>.

    The vocabulary (a file of bounded size) and its perfect hash are made by the driver and broadcast.
    """
    ranks = read_ranks(path)
    vocabulary = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * (not digests_only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, perfect = vocabulary.value
        codec = codec_of(ranks, pattern, perfect)
        for batch in batches:
            for part in slices(batch):
                n, shas, backs, ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    code = codec.encode(text or "")
                    n.append(len(code) // 4)
                    shas.append(hashlib.sha256(code).hexdigest())
                    backs.append(hashlib.sha256(codec.decode(code)).hexdigest())
                    if not digests_only:
                        ids.append(np.frombuffer(code, "<i4"))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())] + [pa.array(ids, pa.list_(pa.int32()))] * (not digests_only)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * (not digests_only)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public multi-language vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), *default_vocabulary(), digests_only=True)


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}

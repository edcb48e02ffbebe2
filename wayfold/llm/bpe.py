"""Byte-level BPE encoding and decoding over a contiguous rank array.

A piece of the pre-tokenizer keeps flat arrays: part boundaries, their ids and
the merge rank of each part with its right neighbour. The encoder scans the ranks
for the minimum (leftmost on ties), deletes that boundary and refreshes the two
ranks beside it, until no rank is left. Pieces over LONG bytes, where scanning
would be quadratic, pick the same minima from a heap. Ids are cached by piece.

The vocabulary file is a parameter; the driver reads it and broadcasts its
fixed 1.5 MB, so executors need no such path. Null texts count as empty. Rows
are independent: repeated rows, null ids and extra columns need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 192
CACHE_PIECES = 1 << 17
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte, as vocabulary files write them."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankArrayBpe:
    """Encoder and decoder of one tokenizer file of kind byte-level BPE."""

    def __init__(self, spec: bytes):
        import regex

        data = json.loads(spec)
        back = byte_alphabet()
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.pair_rank[self.ids[left] << 32 | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_scan(self, piece: bytes) -> list[int]:
        """Ids of a short piece, by scanning the rank array."""
        rank, merged = self.pair_rank.get, self.merged
        edges = list(range(len(piece)))
        ids = [self.byte_ids[b] for b in piece]
        ranks = [rank(a << 32 | b, NONE) for a, b in pairwise(ids)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del edges[i + 1], ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NONE)
        return ids

    def merge_heap(self, piece: bytes) -> list[int]:
        """The same ids for a long piece, in n log n steps."""
        rank, n = self.pair_rank.get, len(piece)
        ids, left, right = [self.byte_ids[b] for b in piece], list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            if right[i] < n and (r := rank(ids[i] << 32 | ids[right[i]])) is not None:
                heapq.heappush(heap, (r, i, right[i]))

        for i in range(n - 1):
            push(i)
        while heap:
            low, i, j = heapq.heappop(heap)
            if ids[i] < 0 or right[i] != j or rank(ids[i] << 32 | ids[j]) != low:
                continue  # a part has changed since
            ids[i], right[i], ids[j] = self.merged[low], right[j], -1
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x in ids if x >= 0]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            data = piece.encode("utf-8")
            found = tuple(self.merge_scan(data) if len(data) <= LONG else self.merge_heap(data))
            if len(data) <= LONG:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, text: str) -> array:
        out = array("I")
        spans = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
        known = self.cache.get
        for span in spans:
            if (own := self.special.get(span)) is not None:
                out.append(own)
                continue
            for piece in self.find(span):
                out.extend(known(piece) or self.piece_ids(piece))
        return out

    def decode(self, ids: array) -> str:
        token = self.tokens
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text."""
    with open(tokenizer_file, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RankArrayBpe(spec.value)
        for batch in batches:
            n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                text = bpe.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(little_endian(ids)).hexdigest())
                text_hash.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(ids.tolist())
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)

"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves down to leaves of a few thousand characters.  Two
encoded neighbours are joined by re-encoding a window around their seam only.
The window grows (16, 32, ... characters to each side) until both its ends lie
on *safe cuts*: places between a non-blank character and an ASCII blank.  No
alternative of the split pattern can match across a safe cut, and a match never
depends on what lies before its start, so in the left part, in the right part
and in the joined text the same matches end and begin there.  Every token
outside the window is therefore provably the token of the joined text.  Where a
part holds no safe cut, the window grows to its end and the join re-encodes it.

Joining is associative with the empty text as identity, so any bracketing (one
worker's recursion or partial results of several) gives the same ids.

Decoding concatenates the bytes of the leaves up the same tree.

Results for odd input: a null text counts as empty; an empty text has no tokens
and the digests of zero bytes; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tagmill.llm.common import slices, table

LEAF_CHARS = 4096
BLANKS = " \t\n\r\x0b\x0c"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class TreeCodec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_file: str, pattern: str, leaf_chars: int = LEAF_CHARS, window: int = 16):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.token_text = [str(i) for i in range(len(self.token_bytes))]
        self.leaf_chars, self.window = leaf_chars, window

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        keep = self._tokens_of(len(text[a:mid].encode()), reversed(left))
        skip = self._tokens_of(len(text[mid:b].encode()), iter(right))
        del left[len(left) - keep :]
        left += self._leaf(text[a:b])
        left += right[skip:]
        return left

    def _cut_before(self, text: str, lo: int, mid: int) -> int:
        width = self.window
        while True:
            start = max(lo, mid - width)
            for i in range(mid - 1, start, -1):
                if text[i] in BLANKS and not text[i - 1].isspace():
                    return i
            if start == lo:
                return lo
            width *= 2

    def _cut_after(self, text: str, mid: int, hi: int) -> int:
        width = self.window
        while True:
            end = min(hi, mid + width)
            for i in range(mid + 1, end):
                if text[i] in BLANKS and not text[i - 1].isspace():
                    return i
            if end == hi:
                return hi
            width *= 2

    def _tokens_of(self, n_bytes: int, ids: Iterator[int]) -> int:
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.token_bytes[next(ids)])
            n += 1
        if n_bytes:
            raise AssertionError("a safe cut is not on a token boundary")
        return n

    def decode(self, ids: list[int], leaf_ids: int = 1 << 14) -> bytes:
        if len(ids) <= leaf_ids:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf_ids) + self.decode(ids[mid:], leaf_ids)


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> TreeCodec:
    """One codec for each worker process."""
    return TreeCodec(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text; keep_ids adds the ids themselves."""
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(rank_file, pattern)
        for part in slices(batches):
            out = {name: [] for name in schema.names}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = tree.encode(text or "")
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(tree.token_text.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(tree.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
            yield table(out, schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)

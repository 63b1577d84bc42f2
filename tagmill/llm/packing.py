"""Best-fit packing planned on the length histogram.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the
corpus) reaches the driver.  Best-fit decreasing runs over its counts: a group
of equally filled sequences takes a run of equal lengths at once, so the plan
has a few runs for each length and not a row for each document.  Documents take
the planned slots by their rank within their length.  The rank is dealt out
without bringing a length together: each task numbers its own pieces within a
length, and a table of (task, length) counts gives the tasks' first ranks.

Results for odd input: a null text counts as empty and packs as its end id
alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmill.llm.common import materialize, slices

CAPACITY = 4096
END_ID = 1
#: Chunks between ASCII blanks whose ids a worker keeps; it forgets all when full.
CACHE_CHUNKS = 250_000
#: Whole texts are put together in groups of so many bytes, so that work for each text is paid once a group.
GROUP_BYTES = 1 << 20


class ChunkTokenizer:
    """Ids of whole texts by a word-end BPE file of `tokenizers` whose pre-tokens never span blanks.

    A text's ids are those of its chunks between ASCII blanks, in order, so each distinct chunk is encoded once and
    texts are put together from an array.  The new chunks of many texts are encoded at once.  Latin ones take a direct
    path: the file's normalizer and split pattern, then the byte-pair merges of each pre-token, its end marked by a
    blank and a chunk's end by a line feed, neither of which a pre-token holds.  All other chunks (other scripts, names
    of special tokens) go through `tokenizers` itself; tests hold both against it.
    """

    END, CHUNK_END = b" ", "\n"
    LATIN = "\u0250"

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec["pre_tokenizer"]["pretokenizers"][0], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(f"{split['pattern']['Regex']}|{self.CHUNK_END}")
        suffix, ranks = spec["model"]["end_of_word_suffix"], {}
        for token, i in spec["model"]["vocab"].items():
            if token not in added:
                ends = token.endswith(suffix)
                ranks[bytes(map(self._byte, token.removesuffix(suffix) if ends else token)) + self.END * ends] = i
        self.words = tiktoken.Encoding("words", pat_str=rf"\S+ |{self.CHUNK_END}", mergeable_ranks=ranks, special_tokens=added)
        self.chunk_end = ranks[self.CHUNK_END.encode()]
        self.cache_chunks = cache_chunks
        self._forget()

    @staticmethod
    @cache
    def _byte(char: str) -> int:
        """Byte-level files write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return ord(char) if ord(char) < 0x100 else [b for b in range(0x100) if b not in set(shown)][ord(char) - 0x100]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.n_ids = 0

    def _latin(self, text: str) -> bool:
        return max(text) < self.LATIN and "<|" not in text

    def _direct(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that each have their end mark, and how many each chunk has."""
        words = " ".join(self.pattern.findall(unicodedata.normalize("NFC", text).lower()))
        ids = self.words.encode_to_numpy(words, disallowed_special=())
        at = np.flatnonzero(ids == self.chunk_end)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' ids, how many each chunk has, and the order in which the chunks are taken."""
        text = (b"\n".join(chunks) + b"\n").decode()
        if self._latin(text):
            return *self._direct(text), np.arange(len(chunks))
        texts = list(map(bytes.decode, chunks))
        latin = np.fromiter(map(self._latin, texts), bool, len(texts))
        ids, lengths = self._direct("".join(c + self.CHUNK_END for c in compress(texts, latin)))
        others = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in compress(texts, ~latin)]
        ids = np.append(ids, np.fromiter(chain.from_iterable(others), np.uint32))
        return ids, np.append(lengths, np.fromiter(map(len, others), np.int64)), np.argsort(~latin, kind="stable")

    def _learn(self, n: int) -> None:
        """Encodes what is known from the n-th chunk on."""
        new = list(islice(reversed(self.known), len(self.known) - n))[::-1]
        ids, lengths, order = self._encoded(new)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.known) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[n + order] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[n + order] = lengths
        self.n_ids += len(ids)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        split = list(map(bytes.split, texts))
        n_chunks = np.fromiter(map(len, split), np.int64, len(split))
        n = len(self.known)
        # A chunk that is looked up for the first time gets the next number.
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n_chunks.sum()))
        if len(self.known) > n:
            self._learn(n)
        n_ids = self.lengths[at]
        before = np.append(0, np.cumsum(n_ids))
        ids = self.ids[np.repeat(self.starts[at] - before[:-1], n_ids) + np.arange(before[-1])]
        if len(self.known) > self.cache_chunks:
            self._forget()
        ends = before[np.cumsum(n_chunks)]
        yield from map(ids.__getitem__, map(slice, chain([0], ends.tolist()), ends.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids; task and nth number the pieces of a length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for part in slices(batches):
            rows = []
            ids_of = tok.encode([(t or "").encode() for t in part.column("text").to_pylist()])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(cut), zlib.crc32(cut.tobytes()), task, seen[len(cut)]))
                    seen[len(cut)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: runs (length, first rank, first sequence, offset, how many to a sequence); number of sequences.

    A run ends where the next of its length begins.  Placing one of length n in the fullest sequence with room leaves
    that sequence the best fit for the next one, so each takes as many as fit.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> [(first sequence, how many)]
    runs, n_sequences = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if (i := bisect_left(rooms, length)) < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
                each = room // length
            else:
                room, first, each = capacity, n_sequences, capacity // length
                n = -(-left // each)
                n_sequences += n
            full, rest = divmod(min(left, n * each), each)
            runs.append((length, rank, first, capacity - room, each))
            leave(room - each * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return runs, n_sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in its place."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id))
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    # One row for each length, so at most `capacity` of them.
    runs, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    # `first` grows with the tasks, so it is never broadcast.
    ranked = cut.join(first.hint("merge"), ["task", "length"])
    shift = np.int64(1) << 44  # ranks stay below
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = table[:, 0] * shift + table[:, 1]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("first_rank").to_numpy() + b.column("nth").to_numpy()
            run = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth, each = rank - run[:, 1], run[:, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in schema.names[:5]), pa.array(run[:, 2] + nth // each), pa.array(run[:, 3] + nth % each * length)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Token counts attributed to sections of a document.

A document is encoded once, whole.  Each token's byte length gives its span of
characters (a token that begins or ends inside a character covers it).  Sections
are spans that cover the text without gaps: here its lines, each with the line
break that ends it.  Tokens and sections are joined as intervals by two binary
searches over their sorted starts and ends.

Rule for a token that crosses a boundary: it goes whole to the section that holds
most of its characters, the earlier of equal ones.  Section counts therefore add
up to the document's count.

Results for odd input: a null text counts as empty; an empty text has one empty
section without tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.llm.bpe_tree import codec
from tagmill.llm.common import slices, table


def line_starts(text: str) -> list[int]:
    """First characters of the lines; one for an empty text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return starts if len(starts) == 1 or starts[-1] < len(text) else starts[:-1]


def char_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, for tokens of these byte sizes."""
    ends = np.cumsum(sizes)
    if data.isascii():
        return ends - sizes, ends
    char_of = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return char_of[ends - sizes], char_of[ends - 1] + 1


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether the span crosses a section boundary."""
    stops = np.append(starts[1:], length)
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(stops, end, side="left")
    owner, crossing = first.copy(), last > first
    for i in np.nonzero(crossing)[0]:
        s = np.arange(first[i], last[i] + 1)
        overlap = np.minimum(stops[s], end[i]) - np.maximum(starts[s], begin[i])
        owner[i] = s[int(overlap.argmax())]
    return owner, crossing


def section_counts(docs: DataFrame, rank_file: str, pattern: str, sections: Callable[[str], list[int]] = line_starts) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, and for each section its first character, tokens and crossing tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("starts", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("crossing", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(rank_file, pattern)
        size_of = np.fromiter(map(len, tree.token_bytes), np.int32, len(tree.token_bytes))
        for part in slices(batches):
            out = {name: [] for name in schema.names}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = text or ""
                starts = np.array(sections(text), np.int64)
                ids = tree.encode(text)
                begin, end = char_spans(text.encode(), size_of[np.fromiter(ids, np.int64, len(ids))])
                owner, crossing = attribute(begin, end, starts, len(text))
                row = (doc_id, len(ids), len(starts), int(crossing.sum()), starts, np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts)))
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
            yield table(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, starts array<int>, tokens array<int>, crossing array<int>")

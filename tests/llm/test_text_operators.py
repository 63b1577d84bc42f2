"""Operators over documents: brute force on small tables, and odd input."""

import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmill.llm import avi, bpe_tree, lang_id, licenses, line_dedup, packing, simhash, token_counts

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
LONG = ("lorem ipsum dolor sit amet " * 20_000) + "\n" + "x" * 50_000
#: Null ids and texts, empty and long texts, ties, repeated rows; columns with clashing names.
ODD = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a b c d e f"), (None, None), (4, "a b c d e f"), (5, "漢字 \x1c é\n\n\r\n ok"), (6, "a b c d e f"), (7, "12 34 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s", 0, 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, print long, key int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- media -------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_media_round_trip(data):
    payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
    ((fps, frames),) = avi.read_media(avi.write_media([payload]))
    assert fps == avi.FPS and b"".join(f.tobytes() for f in frames) == payload


def test_media_index_and_damage():
    payload = bytes(range(192)) * 40
    (media,) = avi.write_media([payload])
    fps, frames = avi.parse(media)
    assert fps == 25 and len(frames) == 3
    assert avi.parse(media.replace(b"idx1", b"JUNK"))[1] == frames  # found by walking movi
    assert avi.parse(b"not a video") == (0.0, [])
    still = media.replace(avi.struct.pack("<II", 1, 25), avi.struct.pack("<II", 1, 0), 1)
    assert still != media and avi.parse(still)[0] == avi.FPS
    frame = bytes(frames[0])
    rows = list(np.frombuffer(payload, np.uint8).reshape(-1, 192)[:16])
    head = avi.read_head(frame)
    cut = frame[: frame.index(b"\xff\xd3") - 20] + frame[frame.index(b"\xff\xd3") :]  # row 3 lost its last bytes
    got = next(avi.decode_frames([cut]))
    assert got.shape == (16, 192) and all((got[k] == rows[k]).all() for k in range(16) if k != 3)
    good = int((got[3] == rows[3]).argmin())
    assert 0 < good < 192 and (got[3][good + 1 :] == got[3][-1]).all()
    short = next(avi.decode_frames([frame[: head.scan + 30]]))
    assert short.shape == (16, 192) and (short[5] == 128).all()
    r = random.Random(2)
    for _ in range(300):  # no damage stops a task
        hurt = bytearray(media)
        for _ in range(r.randrange(1, 12)):
            hurt[r.randrange(len(hurt))] = r.randrange(256)
        for rate, own in avi.read_media([bytes(hurt[: r.randrange(len(hurt))] if r.random() < 0.3 else hurt)]):
            assert rate >= 0 and all(f.dtype == np.uint8 for f in own)


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def number(self, value):
        n = abs(value).bit_length()
        self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def close(self):
        self.bits += "1" * (-len(self.bits) % 8)
        return int(self.bits or "0", 2).to_bytes(len(self.bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def codes_of(lengths, values):
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for v in values[at : at + count]:
            out[v] = (code, n)
            code += 1
        at, code = at + count, code << 1
    return out


def baseline(image, quantum, colour, restart, tables):
    """A baseline frame of a gray image, with two flat chroma components at half size if `colour`."""
    dct = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for x in range(8)] for u in range(8)])
    step = 16 if colour else 8
    h, w = image.shape
    full = np.pad(image, ((0, -h % step), (0, -w % step)), mode="edge").astype(float) - 128
    dc, ac = ([codes_of(bytes.fromhex(avi._STANDARD[k, n][0]), avi._STANDARD[k, n][1] + (bytes(r << 4 | b for r in range(16) for b in range(1, 11) if r << 4 | b not in avi._STANDARD[1, n][1]) if k else b"")) for n in (0, 1)] for k in (0, 1))
    out, last, stream, n = [], [0, 0, 0], Writer(), 0

    def block(k, square):
        table = min(k, 1)
        c = np.rint(dct @ square @ dct.T / quantum).astype(int).ravel()[avi._ZIGZAG].tolist()
        d, last[k] = c[0] - last[k], c[0]
        stream.put(*dc[table][abs(d).bit_length()])
        stream.number(d)
        run = 0
        for v in c[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                stream.put(*ac[table][0xF0])
                run -= 16
            stream.put(*ac[table][run << 4 | abs(v).bit_length()])
            stream.number(v)
            run = 0
        if run:
            stream.put(*ac[table][0])

    units = [(y, x) for y in range(0, full.shape[0], step) for x in range(0, full.shape[1], step)]
    for i, (y, x) in enumerate(units):
        for dy in range(0, step, 8):
            for dx in range(0, step, 8):
                block(0, full[y + dy : y + dy + 8, x + dx : x + dx + 8])
        for k in (1, 2) if colour else ():
            block(k, np.full((8, 8), 20.0 * k))
        if restart and (i + 1) % restart == 0 and i + 1 < len(units):
            out.append(stream.close() + bytes((0xFF, 0xD0 + n % 8)))
            stream, last, n = Writer(), [0, 0, 0], n + 1
    out.append(stream.close())
    seg = avi._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quantum]) * 64)
    parts = [(1, 0x22 if colour else 0x11, 0)] + ([(2, 0x11, 0), (3, 0x11, 0)] if colour else [])
    head += seg(0xC0, bytes((8, *h.to_bytes(2, "big"), *w.to_bytes(2, "big"), len(parts))) + b"".join(map(bytes, parts)))
    if tables:
        for k, number in ((0, 0), (1, 0), (0, 1), (1, 1)):
            lengths = bytes.fromhex(avi._STANDARD[k, number][0])
            values = sorted((dc, ac)[k][number], key=lambda v: (dc, ac)[k][number][v][::-1])
            head += seg(0xC4, bytes([k << 4 | number]) + lengths + bytes(values))
    head += seg(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return head + seg(0xDA, bytes([len(parts)]) + b"".join(bytes((p[0], 0x11 if p[0] > 1 else 0)) for p in parts) + b"\0\x3f\0") + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("colour", "restart", "tables"), [(False, 0, True), (True, 0, False), (True, 3, True), (False, 2, False)])
def test_baseline_frames_of_other_writers(colour, restart, tables):
    y, x = np.mgrid[:37, :53]
    image = (128 + 90 * np.sin(x / 7) * np.cos(y / 5)).astype(np.uint8)
    got = next(avi.decode_frames([baseline(image, 2, colour, restart, tables)]))
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 6


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames_of_other_writers(predictor):
    image = np.random.default_rng(predictor).integers(0, 256, (9, 21)).astype(int)
    lengths = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
    codes, stream = codes_of(lengths, range(12)), Writer()
    for i in range(9):
        for j in range(21):
            a, b, c = image[i, j - 1], image[i - 1, j], image[i - 1, j - 1]
            guess = (a if j else 128) if not i else b if not j else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            d = int(image[i, j] - guess)
            stream.put(*codes[abs(d).bit_length()])
            stream.number(d)
    seg = avi._segment
    frame = b"\xff\xd8" + seg(0xC4, b"\0" + lengths + bytes(range(12))) + seg(0xC3, bytes((8, 0, 9, 0, 21, 1, 1, 0x11, 0))) + seg(0xDA, bytes((1, 1, 0, predictor, 0, 0))) + stream.close() + b"\xff\xd9"
    assert (next(avi.decode_frames([frame])) == image).all()
    progressive = frame.replace(b"\xff\xc3", b"\xff\xc2")
    assert next(avi.decode_frames([progressive])).size == 0


def test_shots():
    dark, light, none = np.full((16, 192), 20, np.uint8), np.full((16, 192), 220, np.uint8), np.empty((0, 0), np.uint8)
    assert avi.clips(25.0, avi.histograms([dark] * 5 + [light] * 5)) == [(0, 5, 0.0, 200.0), (5, 5, 200.0, 400.0)]
    assert avi.clips(25.0, avi.histograms([dark] * 4)) == [(0, 4, 0.0, 160.0)]
    assert avi.clips(25.0, avi.histograms([dark, none, none, dark])) == [(0, 4, 0.0, 160.0)]
    rng = np.random.default_rng(3)
    for _ in range(40):
        frames = [np.clip(rng.normal(rng.choice([60, 70, 180]), 12, (16, 192)), 0, 255).astype(np.uint8) for _ in range(rng.integers(1, 30))]
        shares = [[sum((f.ravel() // 4 == k).tolist()) / f.size for k in range(64)] for f in frames]
        diff = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(shares[:-1], shares[1:], strict=True)]
        cuts = []
        for i, d in enumerate(diff):
            around = [diff[k] for k in range(max(0, i - 4), min(len(diff), i + 5)) if k != i]
            mean = sum(around) / len(around) if around else 0.0
            level = mean + 1.5 * (sum((a - mean) ** 2 for a in around) / len(around)) ** 0.5 if around else 0.0
            if d > 0.25 and d > level:
                cuts.append(i + 1)
        assert [c[0] for c in avi.clips(25.0, avi.histograms(frames))] == [0, *cuts]


def test_media_of_odd_documents(odd, empty):
    rows = avi.digest_documents(odd).collect()
    assert len(rows) == len(ODD)
    for r, (i, t) in zip(rows, ODD, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert avi.timed_clips(avi.to_media(odd)).filter("doc_id = 1").collect()[0].end_ms == 40.0
    assert avi.digest_documents(empty).count() == 0


# --- line dedup --------------------------------------------------------------------------------------------------


def deleted_lines(rows, least):
    """Every run of lines with enough words that occurs earlier, by looking at all runs."""
    first, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.encode().split()) for x in lines[a : b + 1]) >= least:
                    run = tuple(lines[a : b + 1])
                    if first.setdefault(run, (i, a)) < (i, a):
                        gone.update(range(a, b + 1))
        out[i] = sorted(gone)
    return out


def test_line_dedup_against_all_runs(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["a b", "c", "d e f", "", "g h"]) for _ in range(r.randrange(9))) for _ in range(200)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs_of(spark, texts), 5).collect()}
    want = deleted_lines(list(enumerate(texts)), 5)
    assert {i: x.deleted for i, x in got.items()} == want
    for i, x in got.items():
        assert x.text == "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in want[i])


def test_line_dedup_odd(odd, empty):
    rows = line_dedup.dedup_lines(odd, 5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert rows[0].__fields__ == [*odd.columns, "n_lines", "n_deleted", "deleted"]
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].n_lines == 1
    assert by_id[4].text == "" and by_id[6].n_deleted == 1  # the null id comes first and keeps its line
    assert [r.n_deleted for r in rows if r.doc_id == 3] == [0, 0]  # a repeated row is one document
    assert line_dedup.dedup_lines(empty).count() == 0


def test_very_many_blank_lines():
    import time

    words = b"w " * 30
    lines = [words, *[b""] * 200_000, words, *[b""] * 200_000, words]
    n_words = np.array([len(x.split()) for x in lines])
    began = time.perf_counter()
    found = line_dedup.line_windows(n_words, 50).tolist()
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    chosen, wholes = line_dedup.select_minima(hashes, found), line_dedup.run_hashes(hashes, found)
    assert len(found) == len(chosen) == len(wholes) > 200_000 and len(set(wholes)) > 100_000
    assert time.perf_counter() - began < 30


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(1, 9))
def test_minima_and_run_hashes(n_words, least):
    hashes = [17 * n % 5 for n in n_words]
    found = line_dedup.line_windows(np.array(n_words), least).tolist()
    every = [(a, b) for a in range(len(n_words)) for b in range(a, len(n_words)) if sum(n_words[a : b + 1]) >= least]
    shortest = {(a, min(b for x, b in every if x == a)) for a, _ in every} | {(max(a for a, x in every if x == b), b) for _, b in every}
    assert set(map(tuple, found)) == shortest
    for (a, b), p in zip(found, line_dedup.select_minima(hashes, found), strict=True):
        assert p == max(k for k in range(a, b + 1) if hashes[k] == min(hashes[a : b + 1]))
    wholes = line_dedup.run_hashes(hashes, found)
    for (a, b), x in zip(found, wholes, strict=True):
        for (c, d), y in zip(found, wholes, strict=True):
            assert (x == y) == (hashes[a : b + 1] == hashes[c : d + 1])


# --- token counts ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\n漢é😀.", max_size=60))
def test_attribution_by_counting_characters(text):
    tree = bpe_tree.codec(RANKS, P.PATTERN)
    ids, starts = tree.encode(text), token_counts.line_starts(text)
    begin, end = token_counts.char_spans(text.encode(), np.array([len(tree.token_bytes[i]) for i in ids], np.int64))
    owner, crossing = token_counts.attribute(begin, end, np.array(starts), len(text))
    section = [k for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)) for _ in range(b - a)]
    for a, b, o, c in zip(begin, end, owner, crossing, strict=True):
        held = Counter(section[a:b])
        assert o == min(k for k in held if held[k] == max(held.values())) and c == (len(held) > 1)
    assert starts[0] == 0 and len(owner) == len(ids)


def test_token_counts_odd(odd, empty):
    args = RANKS, P.PATTERN
    for r in token_counts.section_counts(odd, *args).collect():
        assert sum(r.tokens) == r.n_tokens and len(r.starts) == r.n_sections == len(r.crossing) >= 1
    assert token_counts.section_counts(empty, *args).count() == 0


# --- near-duplicates ---------------------------------------------------------------------------------------------


def slow_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_all_pairs(spark, odd, empty):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 60))) for _ in range(60)]
    texts = base + [b + " z" for b in base] + base[:10]
    got = {x.doc_id: x for x in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints, parent = [slow_print(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    assert {i: (x.fingerprint, x.component_id) for i, x in got.items()} == {i: (f"{prints[i]:016x}", find(parent, i)) for i in range(len(texts))}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {x.component_id for x in rows if x.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_buckets_keep_all_links(spark):
    rng = np.random.default_rng(2)
    prints = [rng.integers(0, 1 << 63, dtype=np.uint64)]
    for _ in range(700):
        x = prints[rng.integers(len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= np.uint64(1) << np.uint64(b)
        prints.append(x)
    p = np.unique(np.array(prints, np.uint64))
    from tagmill.operators.graph import components

    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    parent = list(range(len(p)))
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[:i] ^ p[i]) <= 2)[0]:
            a, b = sorted((find(parent, i), find(parent, int(j))))
            parent[b] = a
    signed = p.view(np.int64).tolist()
    got = {}
    for i, x in enumerate(signed):
        got.setdefault(root.get(x, x), set()).add(i)
    want = {}
    for i in range(len(p)):
        want.setdefault(find(parent, i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pivot_tables_discard_no_link():
    rng = np.random.default_rng(4)
    p = rng.integers(0, 1 << 63, 400, np.uint64)
    p[200:] = p[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    a, b, _ = simhash.linked_pairs(p)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if int(p[i] ^ p[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_similar_documents_against_all_pairs(spark, odd, empty, monkeypatch):
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(40, 120))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    want = {i: find(parent, i) for i in range(len(texts))}
    assert {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(spark, texts)).collect()} == want
    monkeypatch.setattr(simhash, "TILE", 2)  # blocks dealt out by pairs of tiles
    assert {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(spark, texts)).collect()} == want
    assert simhash.similar_documents(odd).count() == len(ODD) and simhash.similar_documents(empty).count() == 0


def test_similar_documents_with_repeated_phrases(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(300)]
        for times in (0, 20, 20, 60):
            texts.append(" ".join(base + [r.choice(words) for _ in range(8)] * times))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    want = {i: find(parent, i) for i in range(len(texts))}
    assert set(want.values()) == set(range(0, len(texts), 4))
    assert {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(spark, texts)).collect()} == want


# --- packing -----------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 8), max_size=15))
def test_plan_is_best_fit_decreasing(histogram):
    runs, n = packing.plan(histogram, 40)
    places, rooms = {}, []
    for length, count in histogram.items():
        own = sorted(x for x in runs if x[0] == length)
        for rank in range(count):
            _, first_rank, first, offset, each = [x for x in own if x[1] <= rank][-1]
            k = rank - first_rank
            places.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 40
    for length in sorted((k for k, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            best = min(fits, key=lambda k: rooms[k])
            rooms[best] -= length
        else:
            rooms.append(40 - length)
    assert len(places) == n == len(rooms)


def test_ids_are_those_of_the_tokenizer(spark):
    texts = [t for _, t in ODD if t and len(t) < 1000] + ["<|endoftext|> İstanbul don't  漢字 é x<|endoftext|>y ǅ ſ", "It's 3.14, naïve—“quoted” £5\t\x0b end of", "é ẞ ŉ"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    for cache in (600_000, 50):
        got = packing.ChunkTokenizer(WORDS, cache).encode([t.encode() for t in texts])
        assert [x.tolist() for x in got] == want


def test_ids_of_every_latin_letter_and_blank():
    """Each code point below U+0250 and each blank: alone, between letters, doubled, before a combining mark, after a blank."""
    points = [chr(k) for k in range(1, 0x250)] + list("\u1680\u2000\u2003\u200b\u2028\u2029\u202f\u205f\u3000\ufeff")
    texts = [form.format(c) for c in points for form in ("{0}", "a{0}b", "{0}{0}", "x {0} y", "{0}\u0301", "  {0}\n{0}1", "It's {0}'s")]
    want = [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    got = packing.ChunkTokenizer(WORDS, 600_000).encode([t.encode() for t in texts])
    wrong = [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b]
    assert not wrong


def test_ids_by_groups_of_texts(monkeypatch):
    """Chunks of both paths in turn, texts over and under a group's size, a full memory: each text gets its own ids, in order."""
    rng = random.Random(7)
    parts = ["The", "THE", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "漢字", "e\u0301", "J\u030c", "İ", "ΣΑΣ", "Привет", "x1.5", "don't", "...", "\x1c", "\x85", "\xa0", "!'s.", "\x00"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    for cache, group in ((300, 1 << 20), (300, 200), (100_000, 1000)):
        monkeypatch.setattr(packing, "GROUP_BYTES", group)
        assert [x.tolist() for x in packing.ChunkTokenizer(WORDS, cache).encode([t.encode() for t in texts])] == want


def test_new_chunks_cost_no_call_each():
    """Where every chunk is new, the operator's own functions are called for groups of texts, not for chunks or texts."""
    tok, calls = packing.ChunkTokenizer(WORDS), Counter()
    texts = [" ".join(f"{a}x{b}," for b in range(50)).encode() for a in range(200)]

    def note(frame, event, arg):
        if event == "call" and frame.f_code.co_filename == packing.__file__:
            calls[frame.f_code.co_name] += 1

    sys.setprofile(note)
    try:
        got = list(tok.encode(texts))
    finally:
        sys.setprofile(None)
    assert len(got) == 200 and sum(n for name, n in calls.items() if name not in ("encode", "_encode")) < 20


def test_packing_odd(odd, empty):
    rows = packing.pack(odd, WORDS).collect()
    ids = {t: [*Tokenizer.from_file(WORDS).encode(t or "", add_special_tokens=False).ids, 1] for _, t in ODD}
    want = Counter()
    for i, t in ODD:
        for k in range(0, len(ids[t]), 4096):
            cut = np.array(ids[t][k : k + 4096], "<u4")
            want[i, k // 4096, k, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert packing.pack(empty, WORDS).count() == 0


# --- language ----------------------------------------------------------------------------------------------------


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    net = lang_id.new_network(["a", "b", "c"], seed=3)
    for name in ("embed", "recur", "out"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    codes, labels = rng.integers(0, 256, (6, 4)), rng.integers(0, 3, 4)

    def loss():
        logits = np.zeros((6, 3, 4)) + net.bias[None]
        for way in (0, 1):
            h = np.zeros((8, 4))
            for t in range(6) if way == 0 else range(5, -1, -1):
                h = lang_id._step(net, way, codes[t], h)[0]
                logits[t] += net.out[way] @ h
        p = np.exp(logits - logits.max(1, keepdims=True))
        return -np.log((p / p.sum(1, keepdims=True))[:, labels, np.arange(4)]).mean()

    for p, g in zip(net.parameters(), lang_id.gradients(net, codes, labels), strict=True):
        for _ in range(3):
            i = (int(rng.integers(p.shape[0])), int(codes[2, 1]) if p.shape[1] == 256 else int(rng.integers(p.shape[1])))
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_windows_cover_a_text():
    owner, begin, length = lang_id.cut([0, 1, 128, 129, 1000])
    assert Counter(owner.tolist()) == {1: 1, 2: 1, 3: 2, 4: 8} and length.sum() == 1258 and length.max() <= 128
    assert (np.diff(begin) == length[:-1]).all()


def test_lanes_do_not_change_a_result():
    net = lang_id.new_network(["a", "b"])
    texts = [b"short", b"a rather longer text " * 30, b"x" * 300]
    together, _ = lang_id.position_sums(net, texts)
    alone = np.concatenate([lang_id.position_sums(net, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-3)


def test_language_accuracy_and_odd_input(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = lang_id.fit(docs)
    found = lang_id.predict(docs, net).withColumn("held", lang_id.held_out(F.col("doc_id"))).toPandas()
    held = found[found["held"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and found["score"].between(0, 1).all()
    rows = lang_id.predict(odd, net).collect()
    assert [r.lang_pred == "und" for r in rows] == [t is None or not any(c.isalpha() for c in t) for _, t in ODD]
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert lang_id.predict(empty, lang_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in lang_id.predict(odd, lang_id.fit(empty)).collect()} == {"und"}


def test_letters_are_category_l():
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        assert lang_id.has_letter(c) == (unicodedata.category(c)[0] == "L")
    assert not lang_id.has_letter("\u00bd \u00b2 \u2460 12 \u2163 !") and not lang_id.has_letter(None) and not lang_id.has_letter("")


# --- byte-level BPE ----------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab C'st  \n\t1é漢\x1c .!?́😀", max_size=60))
def test_tree_is_the_library(text):
    tree = bpe_tree.TreeCodec.__new__(bpe_tree.TreeCodec)
    tree.__dict__.update(bpe_tree.codec(RANKS, P.PATTERN).__dict__, leaf_chars=7, window=2)
    ids = tree.encode(text)
    assert ids == tree._leaf(text) and tree.decode(ids, 3) == text.encode()


def test_tree_odd(odd, empty):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}  # noqa: SIM115
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, (i, t) in zip(bpe_tree.encode_documents(odd, RANKS, P.PATTERN).collect(), ODD, strict=True):
        ids = whole.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_tree.encode_documents(empty, RANKS, P.PATTERN).count() == 0


# --- licenses ----------------------------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    mit, words = licenses.TEMPLATES["mit"], licenses.TEMPLATES["mit"].split()
    broken = " ".join(w if k % 40 else "oops" for k, w in enumerate(words))
    texts = ["x " * 300 + mit.upper() + " y" * 300, "some text " + broken, "Released under the MIT License.", " ".join(words[::2]), "no licence here at all", mit + "\n" + licenses.TEMPLATES["isc"]]
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert {(0, "mit"), (2, "mit-line"), (5, "mit"), (5, "isc")} <= set(got)
    assert got[0, "mit"].containment == 1.0 and not {i for i, _ in got} & {3, 4}
    assert (1, "mit") in got and 0.75 < got[1, "mit"].containment < 1
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_license_scan_is_native(spark):
    plan = licenses.scan(docs_of(spark, ["a"]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan.split("Scan ExistingRDD")[0] for x in ("Python", "Pandas", "ArrowEval"))

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of ``WINDOW`` bytes (a
text's windows have nearly equal lengths and cover all of it), forwards and
backwards, gives every byte position a distribution over the languages from
both states, and pools a document's distribution as the mean over all its
positions; the states begin anew in each window, so a position is labelled from
at most ``WINDOW`` bytes around it.  Weights are trained here, in numpy, by
backpropagation through time.

Training data: windows at hashed places of at most ``SAMPLE_DOCS`` labelled
documents for each of the ``MAX_LANGS`` most frequent languages, chosen by a hash
of the id and the text; equal rows beyond the bound are not gathered either.
These two bounds are the only ones; every text is read whole when languages are
predicted.

Results for odd input: a null text or one without a letter (Unicode category L;
number signs, marks and digits are none) is ``und`` with score 0; a document with
a null id is never learned from and counts as held out; no labelled document at
all gives ``und`` everywhere; repeated rows give equal results; columns of docs
named like a result column give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.llm.common import slices

WINDOW = 128
HIDDEN = 8
SAMPLE_DOCS = 300
MAX_LANGS = 64
WINDOWS_OF_DOC, TRAIN_BYTES = 8, 64
STEPS, BATCH, RATE = 400, 256, 0.02
LANES = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """Gate rows are ordered update, reset, candidate; [0] reads forwards, [1] backwards."""

    langs: list[str]
    embed: list[np.ndarray]  # 3 HIDDEN x 256: input weights, bias included, of each byte
    recur: list[np.ndarray]  # 3 HIDDEN x HIDDEN
    out: list[np.ndarray]  # languages x HIDDEN
    bias: np.ndarray  # languages x 1

    def parameters(self) -> list[np.ndarray]:
        return [*self.embed, *self.recur, *self.out, self.bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(langs, [draw(3 * hidden, 256, scale=0.3) for _ in range(2)], [draw(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)], [draw(len(langs), hidden, scale=hidden**-0.5) for _ in range(2)], np.zeros((len(langs), 1), np.float32))


def _step(net: Network, way: int, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step for all lanes: new state, gates (update above reset), candidate, recurrent part of the candidate."""
    k = h.shape[0]
    x = net.embed[way].take(codes, axis=1)
    a = net.recur[way] @ h
    gates = x[: 2 * k]
    gates += a[: 2 * k]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    c = gates[k:] * a[2 * k :]
    c += x[2 * k :]
    np.tanh(c, out=c)
    new = h - c
    new *= gates[:k]
    new += c
    return new, gates, c, a[2 * k :]


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = logits - logits.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 1) -> Network:
    """Adam on the mean cross-entropy over all positions of windows (rows of bytes) with labels (places in langs)."""
    net, rng = new_network(langs, seed=seed), np.random.default_rng(seed)
    if len(langs) < 2 or not len(windows):
        return net
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        grads = gradients(net, windows[pick].T, labels[pick])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, by backpropagation through time; codes: positions x lanes."""
    T, n = codes.shape
    k = net.recur[0].shape[1]
    traces = []
    logits = np.repeat(net.bias[None], T, 0) + np.zeros((1, 1, n), np.float32)
    for way in (0, 1):
        h, trace = np.zeros((k, n), np.float32), []
        for t in range(T) if way == 0 else range(T - 1, -1, -1):
            new, gates, c, a = _step(net, way, codes[t], h)
            trace.append((t, h, new, gates, c, a))
            logits[t] += net.out[way] @ new
            h = new
        traces.append(trace)
    e = np.exp(logits - logits.max(1, keepdims=True))
    d = e / e.sum(1, keepdims=True)
    d[:, labels, np.arange(n)] -= 1
    d /= T * n
    g_embed, g_recur, g_out = ([np.zeros_like(p) for p in ps] for ps in (net.embed, net.recur, net.out))
    for way in (0, 1):
        dh, inputs = np.zeros((k, n), np.float32), np.empty((3 * k, T, n), np.float32)
        for t, h, new, gates, c, a in reversed(traces[way]):
            g_out[way] += d[t] @ new.T
            dh = dh + net.out[way].T @ d[t]
            z, r = gates[:k], gates[k:]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * a * r * (1 - r)
            dx = np.concatenate([dz, dr, dc])
            da = np.concatenate([dz, dr, dc * r])
            inputs[:, t] = dx
            g_recur[way] += da @ h.T
            dh = dh * z + net.recur[way].T @ da
        g_embed[way] += np.stack([np.bincount(codes.ravel(), x.ravel(), 256) for x in inputs]).astype(np.float32)
    return [*g_embed, *g_recur, *g_out, d.sum((0, 2), dtype=np.float32)[:, None]]


def cut(sizes: list[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place in the joined bytes and length of every window."""
    sizes = np.asarray(sizes, np.int64)
    n = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size, of = sizes[owner], n[owner]
    begin, end = size * nth // np.maximum(of, 1), size * (nth + 1) // np.maximum(of, 1)
    return owner, np.repeat(np.cumsum(sizes) - sizes, n) + begin, end - begin


def position_sums(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text (rows): summed distributions, and positions labelled with each language."""
    owner, begin, length = cut([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    sums, votes = (np.zeros((len(texts), len(net.langs))) for _ in range(2))
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), LANES):
        lanes = order[i : i + LANES]
        n, T = length[lanes], int(length[lanes[-1]])
        codes = data[begin[lanes][None, :] + np.arange(T)[:, None]]
        h = np.zeros((net.recur[0].shape[1], len(lanes)), np.float32)
        ahead = np.empty((T, len(net.langs), len(lanes)), np.float32)
        for t in range(T):
            h = _step(net, 0, codes[t], h)[0]
            np.matmul(net.out[0], h, out=ahead[t])
        h = np.zeros_like(h)
        total, won = (np.zeros((len(net.langs), len(lanes)), np.float32) for _ in range(2))
        for t in range(T - 1, -1, -1):
            h = _step(net, 1, codes[t], h)[0]
            inside = n > t
            if not inside[0]:
                h *= inside  # a shorter window begins at its own end
            logits = ahead[t]
            logits += net.out[1] @ h
            logits += net.bias
            top = logits.max(0)
            best = logits == top
            logits -= top
            np.exp(logits, out=logits)
            logits *= inside / logits.sum(0)
            total += logits
            won += best & inside
        np.add.at(sums, owner[lanes], total.T)
        np.add.at(votes, owner[lanes], won.T)
    return sums, votes


def has_letter(text: str | None) -> bool:
    """str.isalpha() of a character is true for the categories Lu, Ll, Lt, Lm and Lo, and no others."""
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS) -> Network:
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # At most max_langs rows.
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return new_network([])
    # A share of each language by a hash of the id, slightly more than wanted; the sample is then cut to size exactly.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, (sample_docs + 5 * sample_docs**0.5) / r["count"]) * (1 << 31)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    picked = labelled.withColumn("draw", draw).filter(F.col("draw") <= share[F.col("lang")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for lang, text, at in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "draw")), strict=True):
                raw = text.encode()
                places = np.random.default_rng(at).integers(0, max(1, len(raw) - TRAIN_BYTES), WINDOWS_OF_DOC)
                rows.append((lang, at, zlib.crc32(raw), b"".join(raw[p : p + TRAIN_BYTES].ljust(TRAIN_BYTES) for p in places.tolist())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["lang", "draw", "crc", "bytes"])

    # About sample_docs rows of half a kilobyte for each of at most max_langs languages.
    drawn = picked.select("lang", "text", "draw").mapInArrow(windows, "lang string, draw long, crc long, bytes binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "crc", "bytes"))
    sample = sorted(map(tuple, drawn.withColumn("place", place).filter(F.col("place") <= sample_docs).drop("place").collect()))
    langs = sorted({r[0] for r in sample})
    data = np.frombuffer(b"".join(r[3] for r in sample), np.uint8).reshape(-1, TRAIN_BYTES)
    # Languages weigh alike: those with fewer documents repeat.
    labels = np.repeat([langs.index(r[0]) for r in sample], WINDOWS_OF_DOC)
    most = np.bincount(labels).max()
    rows = np.concatenate([np.resize(np.nonzero(labels == k)[0], most) for k in range(len(langs))])
    return train(data[rows], labels[rows], langs)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs with lang_pred, score (its pooled probability) and label_share (share of positions so labelled)."""
    docs = docs.drop("lang_pred", "score", "label_share")
    out = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("label_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)] if net.langs else []
            raw = [texts[i].encode() for i in known]
            pred, score, share = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            sums, votes = position_sums(net, raw) if known else ([], [])
            for i, r, s, v in zip(known, raw, sums, votes, strict=True):
                k = int(s.argmax())
                pred[i], score[i], share[i] = net.langs[k], min(1.0, float(s[k]) / len(r)), float(v[k]) / len(r)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], [*part.schema.names, "lang_pred", "score", "label_share"])

    return docs.mapInArrow(run, out)

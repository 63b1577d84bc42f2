"""Whitening, personal data and structure repair."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import pii, queries, structure, whitening

# --- op11


def whole(rows):
    return np.floor(np.array(rows, np.float64) * 64).astype(np.int64) + 1_000_000


def check_whitened(got, rows, components=16):
    """Against an eigendecomposition of the whole covariance; rows are (vec_id, vector) that take part."""
    x = whole([v for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1][:, :components]
    kept = int((values[:components] > 1e-12 * values[0]).sum())
    want = ((n * x - s) / n) @ vectors[:, :kept] / np.sqrt(values[:kept])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], tuple(x[i])))
    got = got.toPandas()
    assert len(got) == len(rows) * kept
    got["place"] = got.groupby(["vec_id", "component"]).cumcount()
    by_id = defaultdict(list)
    for r in got.sort_values(["vec_id", "place", "component"]).itertuples():
        by_id[r.vec_id].append(r)
    signs = None
    seen = sorted((k, r.deviation) for k, rs in by_id.items() for r in rs if r.component == 1)
    assert seen == sorted((rows[i][0], int(((n * x[i] - s) ** 2).sum())) for i in order)
    if len({k for k, _ in rows}) == len(rows):
        values_got = np.array([[r.whitened for r in sorted(by_id[rows[i][0]], key=lambda r: r.component)] for i in order])
        signs = np.sign((values_got * want[order]).sum(axis=0))
        assert np.abs(values_got * signs - want[order]).max() < 1e-8
    assert np.abs(got.explained - (values / values.sum())[got.component - 1]).max() < 1e-9
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_whitened(queries.op11_embedding_whitening(spark, sf_dir), [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("decay", [0.5, 0.97])
def test_range_finder_and_full_dimension(spark, decay):
    """A spectrum that falls fast converges in the range finder; a flat one is expanded."""
    g = np.random.default_rng(3)
    rows = [(i, [float(v) for v in g.standard_normal(40) * 100 * decay ** np.arange(40)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies count once
    check_whitened(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


def test_whitening_of_odd_rows(spark):
    g = np.random.default_rng(5)
    good = [(i, [float(v) for v in g.standard_normal(3)]) for i in range(20)] + [(3, [0.5, 0.5, 0.5]), (3, [0.25, 0.5, 0.75])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    check_whitened(whitening.whiten(spark.createDataFrame(good + odd, schema)), good)
    clash = spark.createDataFrame(good, schema).withColumns({"x": F.lit(1), "n": F.lit("b"), "a.b": F.lit(2)})
    check_whitened(whitening.whiten(clash), good)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(odd[:2], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance, no direction
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(line, schema)).count() == 5  # rank one
    far = [(i, [float(i) * 1e14, 1.0]) for i in range(6)]
    assert whitening.whiten(spark.createDataFrame(far, schema)).filter("deviation is null").count() > 0


# --- op12

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(number):
    total = 0
    for i, d in enumerate(map(int, reversed(number))):
        total += d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, (pattern, ok)) in enumerate(BASE.items()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def base_row(doc_id, text):
    spans = base_spans(text)
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (doc_id, *(sum(k == name for k, _, _ in spans) for name in BASE), hashlib.sha256(listed.encode()).hexdigest())


def digests(docs):
    return sorted((tuple(r)[:6] for r in pii.digest(docs).collect()), key=str)


def test_base_spans_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_pii(spark, sf_dir)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted((base_row(*r) for r in rows), key=str)


def test_base_spans_of_drawn_texts(spark):
    r = random.Random(2)
    parts = ["a", "b@", "@c.d", ".", "x.y@z.w_q@r.s", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "12", "255.1.2.3", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (555) 010-9999", "+", "é", "𝒳", " ", "-", "(", "00000000000000"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))) for i in range(2500)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((base_row(*x) for x in rows), key=str)


def test_long_and_odd_texts(spark):
    """Long runs against the plain patterns where those are short of quadratic; far longer ones by what they must hold."""
    at = lambda n: ["1" * n, "a" * n, "a." * n, "1 " * n, "a@b.c " * n, "1.2.3.4 " * n, "é" * n + "x@y.zz", "+1 " * n, "a@" * n, "@a.b" * n]
    rows = [(None, None), (1, ""), (1, "me@x.org"), (1, "me@x.org"), *((10 + i, t) for i, t in enumerate(at(1500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(docs.withColumns({"kinds": F.lit(1), "found": F.lit("x"), "a b": F.lit(0)})) == sorted((base_row(*x) for x in rows), key=str)
    assert digests(docs.limit(0)) == []
    n = 20_000
    far = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(at(n))), "doc_id long, text string")).collect()}
    counts = [(r.n_email, r.n_ip, r.n_card, r.n_phone) for _, r in sorted(far.items())]
    assert counts == [(0,) * 4, (0,) * 4, (0,) * 4, (0,) * 4, (n, 0, 0, 0), (0, n, 0, 0), (1, 0, 0, 0), (0,) * 4, (0,) * 4, (n // 2, 0, 0, 0)]
    assert far[4].spans.endswith(f"email:{6 * n - 6}:{6 * n - 1}")


def test_added_kinds_and_scores(spark):
    rows = [
        (0, "iban DE89 3704 0044 0532 0130 00"), (1, "DE89370400440532013000, and GB82WEST12345698765432."), (2, "DE89370400440532013001"), (3, "my ssn is 123-45-6789"),
        (4, "number 123-45-6789"), (5, "ssn 000-45-6789"), (6, "call me: +1 (555) 010-9999"), (7, "XDE89370400440532013000"),
    ]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ("iban:5:32", "100") and got[1] == ("iban:0:22,iban:28:50", "80,80")
    assert got[2] == got[4] == got[5] == got[7] == ("", "")
    assert got[3] == ("ssn:10:21", "60") and got[6] == ("phone:9:26", "90")


def test_running_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 3)
    rows = [(i, "é a@b.c " * i) for i in range(12)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((base_row(*x) for x in rows), key=str)


# --- op13


def damaged(rows):
    out, shown = defaultdict(list), lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        draw, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        out[conv] += []
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out[conv] += [(turn, "user" if draw == 4 else role, text)] * (1 + (draw == 3))
    return {c: sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, turns in out.items()}


def after(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def plain_structure(turns):
    """Whole histories carried forward: the cheapest, then ASCII-least edits of each state."""
    faults, seen, spaces = [], set(), " \t\n\x0b\x0c\r"
    for _, role, text in turns:
        bare = text.strip(spaces)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def least(ways, state, way):
        if state is not None and (state not in ways or way[:2] < ways[state][:2]):
            ways[state] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, done) in list(ways.items()):
                for role in ("user", "assistant"):
                    least(ways, after(state, role[0]), (cost + 5, audit + "I", (*done, f"{role}:")))
        return ways

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        new = {}
        for state, (cost, audit, done) in inserted(ways).items():
            least(new, state, (cost + 2, audit + "D", done))
            if fault not in ("blank", "duplicate"):
                paid = cost + 5 * (fault == "truncated")
                least(new, after(state, role[:1]), (paid, audit + "K", (*done, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    least(new, after(state, to[0]), (paid + 1, audit + "R", (*done, f"{to}:{text}")))
        ways = new
    cost, audit, done = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string"


def drawn_turns(seed, n):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "assistant", "tool", None, ""], ["a.", "b", "  ", "c!\n", "", None, "d?", "e. x", "é. "]
    rows = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, *range(n // 6)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{r.random()}.") for _ in range(n)]
    return rows + rows[: n // 10] + [(99, 5, "user", "only"), (-1, 1, "assistant", "x.")]


def check_structure(got, rows):
    assert {r[0]: tuple(r)[1:] for r in got} == {c: plain_structure(turns) for c, turns in damaged(rows).items()}


def test_structure_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check_structure(queries.op13_structure_repair(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("block", [1024, 5])
def test_structure_of_drawn_turns_for_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(structure, "ROWS", block)
    rows = drawn_turns(block, 900)
    table = spark.createDataFrame(rows, TURNS).withColumns({"code": F.lit(1), "part": F.lit("x"), "a b": F.lit(0)}).repartition(3)
    check_structure(structure.digest(table).collect(), rows)


def test_repaired_turns_are_those_of_the_digest(spark, monkeypatch):
    monkeypatch.setattr(structure, "ROWS", 4)
    rows = drawn_turns(3, 300)
    table = spark.createDataFrame(rows, TURNS)
    found = defaultdict(list)
    for r in structure.repaired_turns(structure.damage(table)).orderBy("conv_id", "part", "block", "place").collect():
        found[r.conv_id].append(f"{r.role}:{r.text}")
    for r in structure.digest(table).collect():
        assert hashlib.sha256("\n".join(found[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in found[r.conv_id]))


def test_structure_of_no_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert structure.digest(spark.createDataFrame([], TURNS)).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert [tuple(r) for r in structure.digest(spark.createDataFrame([(lost, 1, "user", "x.")], TURNS)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", empty)]
    assert structure.repaired_turns(spark.createDataFrame([], f"{TURNS}, copies long")).count() == 0


def test_one_row_repeated_very_often(spark):
    many = spark.range(200_000).select(F.lit(7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x.").alias("text"))
    row = structure.digest(many).first()
    assert (row.duplicate, row.illegal, row.cost) == (199_999, 199_999, 400_000)
    assert row.audit == "D" * 200_000

"""Chat repair, nearest neighbours and the pipeline."""

import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from tagmill.llm import additive, chat


def cheapest(roles):
    """Least cost of a legal repair, by trying all."""
    best = [chat.BIG]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.closing(state)[0])
            return
        for insert in ((), (2,), (3,), (2, 3), (3, 2)):
            at = state
            for s in insert:
                at = s if at >= 0 and s in chat.NEXT[at] else -1
            if at >= 0:
                for to in chat.NEXT[at]:
                    go(i + 1, to, cost + 3 * len(insert) + 2 * (to != roles[i]))
                if at:
                    go(i + 1, at, cost + 3 * len(insert) + 1 + 2 * (at != roles[i]))

    go(0, 0, 0)
    return best[0]


def turns_of(text):
    import re

    return re.findall(r"<\|(system|user|assistant)\|>", text)


def plain_repair(roles):
    """(cost, actions, states) of the repair chosen by the stated order, by keeping whole histories compared from the latest turn."""
    ways = {0: (0, (), ())}
    for role in roles:
        new = {}
        for state, (cost, keys, done) in ways.items():
            for c, pref, action, inserted, to in chat.MOVES[state, role]:
                way = (cost + c, ((pref, state), *keys), (*done, (action, inserted, to)))
                new[to] = min(new.get(to, way), way)
        ways = new
    end = min(ways, key=lambda s: (ways[s][0] + chat.closing(s)[0], ways[s][1], -s))
    return ways[end][0] + chat.closing(end)[0], list(ways[end][2])


def test_repair_is_cheapest_and_legal():
    r = random.Random(5)
    for _ in range(150):
        roles = [r.choice([0, 1, 2, 2, 3, 3]) for _ in range(r.randrange(6))]
        states, cost, n = chat.path([chat.summary(roles)])
        assert cost == cheapest(roles)
        text, _, begun = chat.render_turns(roles, [f"t{i}" for i in range(len(roles))], 0, states[-1], True)
        seen = turns_of(text)
        assert len(seen) == n == begun
        seen = seen[1:] if seen[:1] == ["system"] else seen
        assert seen == ["user", "assistant"] * (len(seen) // 2) and all(f"t{i}" in text for i in range(len(roles)))


def test_ties_are_settled_alike_for_every_cut():
    r = random.Random(8)
    for _ in range(2000):
        roles = [r.choice([0, 1, 2, 3]) for _ in range(r.randrange(1, 9))]
        cost, chosen = plain_repair(roles)
        assert chosen == chat.repair(roles, 0, chosen[-1][2])
        edges = sorted({0, len(roles), *(r.randrange(len(roles) + 1) for _ in range(3))})  # no block is empty
        cuts = [roles[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        states, least, _ = chat.path([chat.summary(c) for c in cuts])
        assert least == cost and [x for k, c in enumerate(cuts) for x in chat.repair(c, states[k], states[k + 1])] == chosen


def joined_parts(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: x.part):
        whole = out.setdefault(x.conv_id, [x.cost, x.n_turns, x.n_repaired, "", "", 0])
        assert whole[:3] == [x.cost, x.n_turns, x.n_repaired] and whole[5] == x.part
        whole[3], whole[4], whole[5] = whole[3] + x.actions, whole[4] + x.rendered, whole[5] + 1
        if whole[5] == x.n_parts:
            assert whole[4].endswith(chat.CLOSE)
    return {k: v[:5] for k, v in out.items()}


def test_blocks_make_the_same_conversation(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), f"m{t}") for c in range(20) for t in range(r.randrange(1, 30))]
    rows += [(None, 0, "user", "same")] * 300  # one conversation of equal rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for n in (1, 3, 7):
        assert chat.repair_conversations(df.repartition(n)).count() == 21  # no short conversation in parts, wherever edges fall
    whole = joined_parts(chat.repair_conversations(df))
    for block, size in ((4, 1 << 20), (1, 1 << 20), (1000, 7)):
        assert joined_parts(chat.repair_conversations(df, block, size)) == whole
    for c, (cost, n_turns, n, actions, text) in whole.items():
        roles = [chat._role(x[2]) for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        least, chosen = plain_repair(roles)
        assert (cost, n_turns) == (least, len(roles)) and len(turns_of(text)) == n
        assert actions.split(",")[: len(roles)] == ["+".join([*("insert " + chat.ROLES[s - 1] for s in ins), a]) for a, ins, _ in chosen]


def test_chat_odd(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, "user", "x"), (None, 1, None, ""), (2, 5, "bot", "z" * 200_000), (3, 0, "system", "s")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, part int, actions string")
    got = joined_parts(chat.repair_conversations(df))
    assert set(got) == {1, 2, 3, None} and sum(v[1] for v in got.values()) == len(rows)
    assert got[2][3] == "relabel,insert assistant" and turns_of(got[2][4]) == ["user", "assistant"]
    assert got[3][0] == 5 and turns_of(got[3][4]) == ["user", "assistant"]  # relabelling is cheaper than two insertions
    assert chat.repair_conversations(df.limit(0)).count() == 0


def test_neighbours_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in additive.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = n = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]].tolist()
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(abs(score[ids == r.vec_id][0] - r.score) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits, n = hits + len(set(best) & {r.vec_id for r in found}), n + 20
    assert hits / n >= 0.99


def plain_neighbours(rows, k=20, measure="ip"):
    """Every row against all others, one row that equals the query left out."""
    out = set()
    for q, v in sorted({(i, tuple(x)) for i, x in rows if i % 20 == 0}):
        rest = list(rows)
        rest.remove((q, list(v)))
        near = [sum(a * b for a, b in zip(x, v, strict=True)) if measure == "ip" else -sum((a - b) ** 2 for a, b in zip(x, v, strict=True)) for _, x in rest]
        best = sorted((-s, i) for s, (i, _) in zip(near, rest, strict=True))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def test_neighbours_of_repeated_rows(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(1, 120)]
    rows = [(i, x if any(x) else [1.0] * 4) for i, x in rows]
    rows += [rows[4]] * 3 + [rows[19]] * 2 + [(20, [2.0, 1.0, 0.0, 0.0])] + [(200 + i, rows[7][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for measure in ("ip", "l2"):
        for blocks in ({}, {"query_block": 2, "row_block": 16}):
            got = [tuple(x) for x in additive.nearest(df, F.col("vec_id") % 20 == 0, measure=measure, margin=9, **blocks).collect()]
            assert set(got) == plain_neighbours(rows, measure=measure)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (1, [None, 1.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    query = F.col("vec_id") % 20 == 0
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in additive.nearest(df, query).orderBy("rank").collect()] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0)]
    assert [r.vec_id for r in additive.nearest(df, query, measure="l2").orderBy("rank").collect()] == [2, 3]
    assert additive.nearest(df.limit(0), query).count() == 0
    many = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in additive.nearest(many, query).filter("query_id = 20").orderBy("rank").collect()] == [*range(20)]


def test_codes_by_beam_search_beat_greedy_ones():
    x = np.random.default_rng(0).standard_normal((500, 16)).astype(np.float32)
    books = additive.fit(x, codebooks=4, codewords=16)
    error = []
    for beam in (1, 8):
        codes, norms, remainders = additive.encode(x, books, beam)
        approx = sum(b[codes[:, m]] for m, b in enumerate(books))
        assert np.allclose(remainders, np.sqrt(((x - approx) ** 2).sum(1)), rtol=1e-4)
        assert np.allclose(norms, (approx**2).sum(1), rtol=1e-4)
        error.append(((x - approx) ** 2).sum())
    assert error[1] < error[0]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        if k < 3:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(ids) == before
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_pipeline_odd(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    long_line = " ".join(f"word{k}" for k in range(80))
    rows = [(1, None, None, "s", 0, 1), (2, "", "en", None, 0, 1), (3, long_line, "en", "s", 1, 1), (3, long_line, "en", "s", 1, 1), (None, "some words here", "en", "s", 1, 1), (5, "!!! 12", "en", "s", 1, 1), (6, long_line + "\nmore words", "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    train = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(0).cast("int")).withColumn("doc_id", F.col("doc_id") + 1000)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(train), sf_dir).filter("doc_id < 1000 or doc_id is null")
    assert {r.doc_id for r in kept.collect()} <= {3, 6, None}
    lines = corpus_pipeline.dedup_lines(spark, docs.filter("text is not null"), sf_dir).collect()
    assert {r.doc_id: r.text for r in lines if r.doc_id == 6} == {6: "more words"}
    groups = corpus_pipeline.dedup_documents(spark, docs, sf_dir)
    assert sorted((r.doc_id or -1) for r in groups.collect()) == [-1, 1, 3, 5]  # 2 is empty like 1; 6 shares over four fifths with 3
    assert corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0
    assert P.path("word_bpe_49k.json")


def test_one_document_of_a_group_stays(spark, sf_dir):
    words = [f"w{k}" for k in range(200)]
    one, near = " ".join(words), " ".join(words[:-1] + ["z"])
    far = " ".join(reversed(words))
    rows = [(1, one, "b"), (1, one, "a"), (1, near, "a"), (2, one, "a"), (1, far, "c"), (3, far, None), (4, None, "s"), (4, "", "s"), (None, one, "a"), (None, one, "a"), (None, one, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = {r.text: r.key for r in docs.select("text", corpus_pipeline.text_key(F.col("text")).alias("key")).collect()}
    stays = min(one, near, key=key.get)
    got = [(r.doc_id, r.text or "", r.source) for r in corpus_pipeline.dedup_documents(spark, docs, sf_dir).collect()]
    want = [(1, stays, "a"), (1, far, "c"), (4, "", "s")]
    assert sorted(got, key=str) == sorted(want, key=str)


CLASH = ["my col", "a-b", "a.b", "x`y", "score", "lang_pred", "label_share", "n_deleted", "deleted", "n_lines", "gone", "rest", "key", "salt", "json", "stays", "row", "print", "component_id", "runs", "windows"]


def test_stages_with_clashing_columns_and_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns
        plain = {tuple(r) for r in stage(spark, docs, sf_dir).collect()}
        rows = got.collect()
        assert {tuple(r)[: len(docs.columns)] for r in rows} == plain
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, wide, sf_dir).count() >= docs.count()


def test_stages_against_brute_force(spark, sf_dir):
    r = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for _ in range(10):
        base = [r.choice(words) for _ in range(r.randrange(60, 120))]
        for _ in range(5):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append("\n".join([" ".join(copy), *([passage] if r.random() < 0.4 else [])]))
    rows = [(i, t, "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    # Lines: a run of fifty words or more that occurs earlier goes; here runs are single lines, or two together.
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        want[i] = "\n".join(x for x in lines if x not in seen)
        seen |= set(lines)
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items() if t}
    # Near duplicates: all pairs at a similarity of 0.8, the least id of each group stays.
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    kept = corpus_pipeline.dedup_documents(spark, docs, sf_dir).collect()
    assert len(set(least)) < len(texts) and {tuple(x) for x in kept} == {rows[i] for i in set(least)}
    # Packing: every token of every document once, in places that fill sequences without gaps.
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {x.doc_id: x.length for x in packed} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    at = {}
    for x in sorted(packed, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == at.get(x.sequence_id, 0)
        at[x.sequence_id] = x.offset + x.length
    assert max(at.values()) <= 4096 and len(at) == -(-sum(x.length for x in packed) // 4096)

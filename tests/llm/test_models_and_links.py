"""Vectors, toxicity, chat formatting and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import chat, embedding_dedup, registry, toxicity


def brute(vectors, threshold=0.9):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    u = m / np.sqrt((m * m).sum(axis=1))[:, None]
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min([label[k], *label[np.flatnonzero(s[k])]]) for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(s[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
        label = new


def test_embedding_duplicates(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((40, 32))
    good = {i: (centres[i % 40] + (0.05 + 0.35 * (i % 5) / 4) * r.standard_normal(32)).tolist() for i in range(400)}
    good |= {1000 + i: good[7] for i in range(5)} | {2000: (2 * np.array(good[8])).tolist()}
    bad = {3000: None, 3001: [0.0] * 32, 3002: [float("nan")] + [1.0] * 31, 3003: [None] + [1.0] * 31, 3004: [float("inf")] * 32, 3005: [1.0] * 5, 3006: []}
    rows = [(i, v, "label", 3) for i, v in {**good, **bad}.items()] + [(7, good[7], "again", 1), (None, good[7], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string, n int").repartition(3)
    single = {i: np.array(v, dtype=np.float32).tolist() for i, v in good.items()}
    want, got = brute(single), embedding_dedup.embedding_duplicates(df).collect()
    assert len(got) == len(rows)
    found = links = 0
    for x in got:
        if x.vec_id in want:
            assert x.n_links <= want[x.vec_id][0]
            found, links = found + x.n_links, links + want[x.vec_id][0]
            assert x.kept == (x.vec_id == x.component_id)
        else:
            assert x.n_links == 0 and x.component_id == x.vec_id and x.kept
    assert links > 2000 and found >= 0.98 * links
    assert np.mean([x.component_id == want[x.vec_id][1] for x in got if x.vec_id in want]) > 0.98
    assert embedding_dedup.embedding_duplicates(df.where("vec_id >= 3000")).count() == 7
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_embedding_blocks_count_alike(spark, monkeypatch):
    r = np.random.default_rng(3)
    c = r.standard_normal(16)
    df = spark.createDataFrame([(i, (c + 0.15 * r.standard_normal(16)).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    whole = {tuple(x) for x in embedding_dedup.embedding_duplicates(df).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    assert {tuple(x) for x in embedding_dedup.embedding_duplicates(df).collect()} == whole


def test_index_grows_with_the_data():
    x = np.random.default_rng(1).standard_normal((500, 64))
    small, large = embedding_dedup.fit_index(x, 10_000, 0.9), embedding_dedup.fit_index(x, 10_000_000, 0.9)
    assert small.bits == 8 and large.bits == 16 and large.tables > small.tables
    assert small.codes(x).shape == (500, small.tables)


def planted(share, pairs, d=64):
    """Unit vectors u[i], v[i] with a cosine of 0.90 to 0.92 that have `share` of their squared length in one common direction."""
    r = np.random.default_rng(5)
    m = r.standard_normal(d)
    m /= np.linalg.norm(m)
    g, h = r.standard_normal((pairs, d)), r.standard_normal((pairs, d))
    g -= np.outer(g @ m, m)
    g /= np.linalg.norm(g, axis=1)[:, None]
    h -= np.outer(h @ m, m) + (h * g).sum(axis=1)[:, None] * g
    h /= np.linalg.norm(h, axis=1)[:, None]
    k = ((r.uniform(0.9, 0.92, pairs) - share) / (1 - share))[:, None]
    return np.sqrt(share) * m + np.sqrt(1 - share) * g, np.sqrt(share) * m + np.sqrt(1 - share) * (k * g + np.sqrt(1 - k * k) * h)


@pytest.mark.parametrize("rows", [3000, 10_000_000])  # 8 and 16 bits where no direction is shared
@pytest.mark.parametrize("share", [0.0, 0.5, 0.7, 0.8, 0.9])
def test_index_finds_links_about_a_large_mean(share, rows):
    u, v = planted(share, 1500)
    index = embedding_dedup.fit_index(np.concatenate([u, v]), rows, 0.9)
    assert (index.codes(u) == index.codes(v)).any(axis=1).mean() >= 0.99
    assert share or index.bits == (8 if rows == 3000 else 16)


@pytest.mark.parametrize("share", [0.7, 0.9])
def test_embedding_duplicates_about_a_large_mean(spark, share):
    rows = {i: x.tolist() for i, x in enumerate(np.concatenate(planted(share, 300)))}
    want = brute(rows)
    got = embedding_dedup.embedding_duplicates(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).collect()
    assert sum(x.n_links for x in got) >= 0.99 * sum(n for n, _ in want.values()) >= 500


def test_toxicity(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = [r.choice(vocab) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(("idiot", "scum"))
        if toxic and r.random() < 0.7 or r.random() < 0.05:
            words[0] = "women"  # identity terms go with toxic labels here; the penalty must undo that
        rows.append((i, " ".join(words), "en", "s", i))
        labels.append((i, None, int(toxic)))
    rows += [(5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (5002, "idiot " * 9000, "en", "s", 1), (None, "scum", "en", "s", 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    lab = spark.createDataFrame([*labels, (1, 0, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = {x.doc_id: x for x in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert got[5000].score == got[5001].score and got[5002].predicted == 1 and 0 <= got[5000].score <= 1
    score = toxicity._scorer(model)
    probes = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(50)]
    assert np.mean([abs(score(f"women {p}") - score(p)) for p in probes]) < 0.05 and np.mean([score(f"women {p}") < 0.5 for p in probes]) > 0.9
    strict, toxicity.FAIRNESS = toxicity.FAIRNESS, 0.0
    try:
        free = toxicity._scorer(toxicity.train(docs, lab))
    finally:
        toxicity.FAIRNESS = strict
    assert all(abs(score(f"women {p}") - score(f"men {p}")) <= abs(free(f"women {p}") - free(f"men {p}")) + 1e-6 for p in probes)
    assert np.mean([score(f"women {p}") for p in probes]) < np.mean([free(f"women {p}") for p in probes])
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    nothing = toxicity.train(docs, lab.limit(0))
    assert toxicity.toxicity_scores(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


SCHEMAS = {"weather": {"properties": {"city": {"type": "string"}, "days": {"type": "integer"}, "unit": {"type": "string", "enum": ["c", "f"]}}, "required": ["city"], "additionalProperties": False}}


def calls(*items):
    return '{"tool_calls":[' + ",".join(items) + "]}"


def call(i, args, name="weather"):
    import json

    return json.dumps({"id": i, "name": name, "arguments": args})


def test_chat(spark):
    rows = [
        (1, 0, "user", 'Say "hi"\n'), (1, 1, "assistant", calls(call("a", '{"days": 2, "city": "Bonn"}'), call("b", '{"city": 5}'))), (1, 2, "tool", '{"tool_call_id":"a","content":"rain"}'),
        (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (1, 4, "assistant", None), (1, 5, "assistant", '{"tool_calls": broken'),
        (2, 0, "tool", '{"tool_call_id":"late","content":"early answer"}'), (2, 1, "assistant", calls(call("late", '{"city":"X","unit":"f"}'))),
        (3, 0, "assistant", calls(call("p", '{"city":{"$ref":"q"}}'), call("q", '{"city":"Y"}'))), (3, 1, "tool", '{"tool_call_id":"q","content":"1"}'), (3, 2, "tool", '{"tool_call_id":"p","content":"2"}'),
        (4, 0, "assistant", calls(call("m", '{"city":{"$ref":"n"}}'), call("n", '{"city":{"$ref":"m"}}'))), (5, 0, "assistant", calls(call("d", "not json"), call("d", '{"city":"Z","more":1}'))),
        (None, 0, "user", "no conversation"), (6, None, "user", "no turn"), (1, 0, "user", 'Say "hi"\n'),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, item int")
    got = chat.format_chat(chat.events_from_messages(df), SCHEMAS).collect()
    assert len(got) == len(rows) + 4
    of = {(x.conv_id, x.call_id, x.kind): x for x in got if x.call_id}
    a, b = of[1, "a", "call"], of[1, "b", "call"]
    assert a.linked and a.valid and not b.linked and not b.valid
    assert a.json == '{"arguments":{"city":"Bonn","days":2},"id":"a","name":"weather","role":"call"}'
    assert of[1, "a", "result"].linked and not of[1, "zz", "result"].linked
    assert of[1, "a", "result"].json == '{"content":"rain","role":"result","tool_call_id":"a"}'
    assert next(x for x in got if x.conv_id == 1 and x.turn == 0).json == '{"content":"Say \\"hi\\"\\n","role":"user"}'
    assert next(x for x in got if x.conv_id == 1 and x.turn == 4).json == '{"content":null,"role":"assistant"}'
    late, early = of[2, "late", "call"], of[2, "late", "result"]
    assert late.valid and (early.order_turn, early.order_level) > (late.order_turn, late.order_level)
    order = lambda c, k: (of[3, c, k].order_turn, of[3, c, k].order_level)
    assert order("q", "call") < order("q", "result") < order("p", "call") < order("p", "result")
    assert of[4, "m", "call"].cyclic and of[4, "n", "call"].cyclic and not a.cyclic
    d = sorted((x for x in got if x.conv_id == 5), key=lambda x: x.item)
    assert [x.valid for x in d] == [False, False] and '"arguments":"not json"' in d[0].json
    assert chat.format_chat(chat.events_from_messages(df.limit(0)), SCHEMAS).count() == 0


def test_chat_is_native(spark):
    e = registry.turns_as_calls(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string"))
    plan = chat.format_chat(e, registry.REPLY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, tmp_path):
    """run() against its stages in plain Python over the smallest tables."""
    import public_tokenizers
    from tests.llm.test_text_operators import base_spans, lower, roots, shingles
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]
    score = toxicity._scorer(toxicity.train(docs, labels))
    rows = {r.doc_id: r.text for r in docs.collect() if score(r.text) < 0.5}
    best = {}
    for i, t in rows.items():
        best[lower(t)] = max(i, best.get(lower(t), i))
    ids = sorted(best.values())
    sets = [shingles(rows[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    ids = sorted({ids[r] for r in roots(len(ids), links)})
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {}
    for i in ids:
        text, out, at = rows[i], "", 0
        for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want[i] = len(t.encode(out + text[at:], add_special_tokens=False).ids) + 1
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and "0" not in df.columns



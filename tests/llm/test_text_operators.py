"""Operators on texts against brute force, over a table with nulls, empties, copies, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import bpe, exact_dedup, minhash_dedup, packing, pii, substring_dedup, token_count
from kinweave.llm.shingles import super_minhash

SCHEMA = "doc_id long, text string, kept boolean, component_id string, norm int, k string, seeds array<int>, base string, spans string, lo string, n long"


def corpus():
    r = random.Random(4)
    vocab = [a + b for a in "the of idea wonder Mix ünder straße".split() for b in ("", "s", "ly", "ing", "er")]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [sentence(n) for n in (9, 13, 14, 20, 60)]
    texts = [sentence(r.randint(1, 120)) for _ in range(60)]
    texts += [f"{sentence(r.randint(0, 30))} {r.choice(shared)} {sentence(r.randint(0, 30))}".strip() for _ in range(60)]
    base = sentence(150).split(" ")
    for _ in range(40):  # near copies at many distances
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [texts[5].upper(), texts[5].lower(), "", None, None, " \n\t ", "one", "one two", "one  two", "a b c d", "A b c D"]
    texts += ["word " * 4000 + "end", "<|endoftext|> mid <|endoftext|>", "x" * 3000, "tabs\tand\x0bvertical\x1cseparators here", "1234 5678 " * 30 + "é ﬁ 😀"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, texts[3]), (None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, True, "x", 1, "y", [1], "b", "s", "l", 5) for i, t in ROWS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, weak):
    key = (lambda c: F.char_length(c)) if weak else exact_dedup.md5_key  # a weak key makes collisions
    got = exact_dedup.exact_duplicates(docs, key=key).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in ROWS:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids) if not weak else None, i == keep, hashlib.sha256(lower(t)).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size if not weak else None, r.kept, r.text_sha256) for r in got if True) == want


def test_exact_duplicates_smallest_and_empty(docs, empty):
    small = {r.keep_id for r in exact_dedup.exact_duplicates(docs, keep="smallest").where("doc_id = 10").collect()}
    assert small == {min(i for i, t in ROWS if i is not None and lower(t) == lower(ROWS[3][1]))}
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 2


def shingles(t):
    w = lower(t).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, empty):
    ids = sorted({(i, t) for i, t in ROWS if i is not None})
    sets = [shingles(t) for _, t in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(len(ids), links)
    want = {i: (len(s), ids[r][0]) for (i, _), s, r in zip(ids, sets, root)}
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len(set(root)) < len(ids) - 20
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {ids[r][0] for r in root}


def test_near_duplicates_in_small_blocks(docs, monkeypatch):
    whole = {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 3)
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()} == whole


def test_super_minhash_estimates():
    import numpy as np

    r = np.random.default_rng(1)
    shared, a, b = (np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 60, 40))
    s = super_minhash([np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))], 240)
    assert abs((s[0] == s[1]).mean() - 300 / 400) < 0.1
    tiny = super_minhash([np.array([5], dtype=np.uint64)], 168)
    assert len(set(tiny[0].astype(int))) == 168  # one element visits every slot once


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, t


def test_packing(docs, empty, library):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = Counter()
    for i, t in ROWS:
        ids[(i, tuple([*library[0](t), 0]))] += 1
    rows = packing.pack(docs, ranks, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(t) * n for (_, t), n in ids.items())
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = Counter()
    for (i, t), n in ids.items():
        for at in range(0, len(t), 64):
            part = b"".join(x.to_bytes(4, "little") for x in t[at : at + 64])
            want[(i, at, min(64, len(t) - at), zlib.crc32(part), len(t))] += n
    assert pieces == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) * 64 < 1.05 * sum(r.length for r in rows) + 64
    assert packing.pack(empty, ranks).count() == 0


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({7: 3, 3: 4, 1: 2}, 10)
    used = Counter()
    for n, p in patterns:
        assert sum(x * k for x, k in p.items()) <= 10
        for x, k in p.items():
            used[x] += n * k
    assert used == {7: 3, 3: 4, 1: 2} and sum(n for n, _ in patterns) == 4


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 50) for i, x in ROWS)
    assert Counter(map(tuple, token_count.token_counts(docs, path, limit=50).collect())) == want
    assert token_count.token_counts(empty, path).count() == 0


def test_bpe_round_trip(docs, empty, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Counter()
    for i, x in ROWS:
        ids = library[0](x)
        back = library[1].decode(ids, skip_special_tokens=False)
        assert back == (x or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.encode_digests(docs, path).collect())) == want
    assert all(r.decoded == (dict(ROWS).get(r.doc_id) or "") for r in bpe.encode_texts(docs, path).where("doc_id is not null").collect())
    assert bpe.encode_digests(empty, path).count() == 0


def test_bpe_against_the_library(library):
    b = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\x1c", " ", "é", "é", "漢字", "😀", "'s", "'ll", "<|endoftext|>", "123", "½", "ʰ", "\x00", "A" * 60, "ab" * 100, "!!"]
    for _ in range(800):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert b.encode(t) == library[0](t), repr(t)


def test_remove_repeats(docs, empty):
    texts = {i: (t or "").encode().split() for i, t in ROWS if i is not None}
    seen, want = {}, {}
    for i in sorted(texts):
        w = texts[i]
        gone = set()
        windows = [tuple(w[a : a + 13]) for a in range(len(w) - 12)]
        for a, x in enumerate(windows):
            if x in seen:
                gone.update(range(a, a + 13))
        for x in windows:
            seen.setdefault(x, i)
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS) and sum(r.n_removed for r in got) > 1000
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
    digest = {(r.doc_id, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, digest=True).where("doc_id is not null").collect()}
    assert digest == {(i, hashlib.sha256(x[2].encode()).hexdigest()) for i, x in want.items()}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_remove_repeats_of_few_words(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        gone, mine = set(), [tuple(w[a : a + 13]) for a in range(len(w) - 12)]
        for a, x in enumerate(mine):
            if x in seen:
                gone.update(range(a, a + 13))
        seen.update(mine)
        want[i] = len(gone)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.n_removed for x in got.collect()} == want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(spark, docs, empty):
    r = random.Random(3)
    parts = ["a@b.c", "a@b.c.d@e.f", "@", "+1 ", "(", "555", ")", "-", "1.2.3.4", "256.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", "é", "😀", "1234567890123", "..", "  ", "--"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(600)]
    rows += [(1000, "1" * 30_000), (1001, "a@" + "b." * 9000 + "c"), (1002, "a@b.c " * 800), (1003, None)]
    for x in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = base_spans(dict(rows)[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == s[0] for s in spans) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(x.spans.split(",")) | {""}
    assert pii.pii_digest(empty).count() == 0 and pii.pii_digest(docs).count() == len(ROWS)


def test_pii_model(spark):
    rows = [(1, "Please call me at (212) 555-0199 today."), (2, "Write to jane (at) example (dot) org soon."), (3, "invoice 212-555-0199 was paid"), (4, "in the years 1990-1995 we"),
            (5, "Mail bob@x.example.com or +1 (212) 555-0199!"), (6, None), (7, "plain")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, base string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert spans[1] == "phone:18:32" and spans[2].startswith("email:9:") and spans[3] == "" and spans[4] == "" and spans[5] == "email:5:22,phone:26:43"
    clean = {r.doc_id: r for r in pii.redact_documents(df).collect()}
    assert clean[1].text == "Please call me at [PHONE] today." and clean[5].text == "Mail [EMAIL] or [PHONE]!" and clean[6].text is None and clean[7].text == "plain" and clean[7].base == "z"
    model = pii.fit(spark)
    held = [r for r in pii._feature_rows(spark) if r[0] % 6 >= 4]
    import numpy as np

    p = 1 / (1 + np.exp(-(model.slope * pii._margin(model.trees, np.array([r[2] for r in held])) + model.offset)))
    assert ((p >= 0.5) == np.array([r[1] for r in held], dtype=bool)).mean() > 0.95

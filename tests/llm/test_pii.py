"""Added spans against a plain Python version, long lists of matches, and the trees on held-out contexts."""

import math
import random
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from kinweave.llm import pii
from tests.llm.test_text_operators import base_spans


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def features(text, kind, s, e):
    m, before = text[s:e], text[max(0, s - pii.CONTEXT) : s].lower()
    d = regex.sub("[^0-9]", "", m)
    return [kind, len(d), len(m), len(regex.sub(r"[^ ./_:-]", "", m)), m.startswith("("), 13 <= len(d) <= 19 and luhn(d), bool(regex.search(pii._FOR[pii.KINDS[kind]], before, regex.I)),
            bool(regex.search(pii._AGAINST, before, regex.I)), len(set(d)) if d else 1, d.startswith("0"), bool(regex.search(r"[(\[{]", m)), bool(regex.search(r"[.\])}]\s?[A-Za-z]{2,6}$", m)),
            len(regex.split(r"[^0-9A-Za-z]+", m)), bool(regex.search(r"^\(?(?:19|20)[0-9]{2}\b", m))]


def added(text, model):
    """Candidates that overlap no base span and pass, the first and longest of overlapping ones."""
    base = [(a, b) for _, a, b in base_spans(text)]
    out = []
    for k, name in enumerate(pii.KINDS):
        for m in regex.finditer(pii.CANDIDATES[name], text, regex.V0):
            s, e = m.span()
            if all(e <= a or b <= s for a, b in base):
                f = np.array([features(text, k, s, e)], dtype=float)
                z = pii._margin(list(model.trees), f)[0]
                if 1 / (1 + math.exp(-(z * model.slope + model.offset))) >= model.thresholds[k]:
                    out.append((s, -e, k))
    kept, end = [], 0
    for s, e, k in sorted(out):
        if s >= end:
            kept.append((k, s, -e))
            end = -e
    return sorted(kept)


def texts():
    r = random.Random(5)
    lines = [t for _, t, _ in pii.sentences(400, seed=3)]
    out = [" ".join(r.sample(lines, 4)) for _ in range(60)]
    out += ["", None, "a (at) b (dot) com" * 3, "call 030 1234 567 or +49 30 1234567 now", "fe80::1 and 2001:db8::ff00:42 and ::1 and a::b", "x" * 5000 + " mail me: joe (at) example (dot) org", "é" * 4093 + " phone (030) 555-1234 é", "very.long." * 50 + "name (at) host.org",
            "phone 030-123-4567 " * 300]
    return out


def test_added_spans(spark, model):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, base string, more int"), model=model).collect()}
    many = 0
    for i, t, _, _ in rows:
        want = added(t or "", model)
        have = sorted((x.kind, x.s, x.e) for x in got[i].spans)
        for x in got[i].base:
            have.remove((x.kind, x.s, x.e))
        assert have == want, (i, t)
        assert all((t or "")[x.s : x.e] == x.m for x in got[i].spans)
        many += len(want)
    assert many > 300


def test_many_matches_in_one_text(spark, model):
    """Thirty-two thousand addresses in one text: found, redacted, and not in the square of their number."""
    def seconds(n):
        df = spark.createDataFrame([(1, "ab@cd.ef call 030-123-4567 " * (n // 2))], "doc_id long, text string")
        at = time.time()
        r = pii.redact_documents(df, model=model).select(F.regexp_count("text", F.lit(r"\[EMAIL\]")).alias("n"), F.char_length("text").alias("c")).first()
        assert r.n == n // 2
        return time.time() - at

    seconds(100)
    assert seconds(32_000) < 8 * max(seconds(8_000), 1.0)


def test_trees_on_contexts_never_fitted(spark, model):
    """Contexts of the test are not those of the fit; every kind keeps its precision, none is useless."""
    fit, test = pii._CONTEXTS, pii.sentences(1600, seed=29, test=True)
    assert all(not set(a) & set(b) for a, b in fit.values())
    for kind, (hit, wrong, missed) in pii.judged(spark, model, test).items():
        print(kind, "precision", round(hit / max(1, hit + wrong), 3), "recall", round(hit / max(1, hit + missed), 3))
        assert hit / max(1, hit + wrong) >= 0.9 and hit / max(1, hit + missed) >= 0.6, (kind, hit, wrong, missed)

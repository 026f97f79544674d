"""A toxicity classifier with a counterfactual penalty: swapping identity terms must not change the score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

#: Groups of identity terms; a counterfactual replaces a term by the others of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "nonbinary"), ("woman", "man"), ("girls", "boys"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros"),
)
_SWAP = {t.encode(): [o.encode() for o in g if o != t] for g in IDENTITY_GROUPS for t in g}
#: Bounds of the fit: labelled rows (the least by hash of id), features kept by score, passes.
TRAIN_ROWS, FEATURES, PASSES = 12_000, 4096, 300
#: Weights of the counterfactual and the quadratic penalty.
FAIRNESS, RIDGE = 20.0, 1e-4
_PUNCT = b".,;:!?%*&$#|\"'()[]{}<>-_~"
_PREFIXES = (4, 5, 6, 7)
CACHE, FEATURE_CACHE = 100_000, 30_000


def word_features(word: bytes) -> list[int]:
    """31-bit hashes of a word and of its prefixes of 4 to 7 letters, which carry stems."""
    out = [xxhash.xxh32_intdigest(b"w:" + word) >> 1]
    text = word.decode("utf-8", "replace")
    out += [xxhash.xxh32_intdigest(b"p:" + text[:k].encode("utf-8")) >> 1 for k in _PREFIXES if len(text) > k]
    return out


def words(text: str | None) -> set[bytes]:
    """Distinct words in lower case of every script, without punctuation at their ends."""
    return {w.strip(_PUNCT) for w in text.lower().encode("utf-8", "surrogatepass").split()} - {b""} if text else set()


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in features)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=FEATURE_CACHE)
    def features(w: bytes) -> tuple[int, ...]:
        return tuple(word_features(w))

    for batch in batches:
        for part in slices(batch):
            own, swapped = [], []
            for t in part.column("text").to_pylist():
                ws = words(t)
                own.append(sorted({f for w in ws for f in features(w)}))
                hit = [w for w in ws if w in _SWAP]
                # each counterfactual exchanges every identity term for the same place of its group; one for no group at all,
                # else equal weights on all terms of a group would cost nothing
                turns = [[o[i % len(o)] for o in (_SWAP[w] for w in hit)] for i in range(max((len(_SWAP[w]) for w in hit), default=0))] + [[]] * bool(hit)
                swapped.append([sorted({f for w in (ws - set(hit)) | set(new) for f in features(w)}) for new in turns])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(own, type=pa.list_(pa.int32())), pa.array(swapped, type=pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "own", "swapped"])


def _selected(names: np.ndarray):
    """Features as places in `names`, which is sorted; the others go."""
    def places(x: list[int]) -> list[int]:
        x = np.array(x, dtype=np.int64)
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return at[names[at] == x].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [places(x) for x in batch.column("own").to_pylist()]
            swapped = [[places(y) for y in x] for x in batch.column("swapped").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, type=pa.list_(pa.int32())), pa.array(swapped, type=pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "own", "swapped"])

    return run


def identity_features() -> set[int]:
    return {f for t in _SWAP for f in word_features(t)}


def minimised(judged: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 10) -> np.ndarray:
    """The minimum of a smooth convex function from its values and gradients: L-BFGS (Liu and Nocedal, 1989), steps halved
    until the value falls enough, up to PASSES steps or until it hardly falls."""
    value, grad = judged(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(PASSES):
        way, used = grad.copy(), []
        for s, y in reversed(past):
            used.append((s @ way) / (s @ y))
            way -= used[-1] * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        step, slope = (1.0 if past else min(1.0, 1 / max(1e-12, float(np.abs(grad).sum())))), float(grad @ way)
        for _ in range(30):
            trial = x - step * way
            now, g = judged(trial)
            if now <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = trial - x, g - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)] if len(past) >= memory else [*past, (s, y)]
        fell, x, value, grad = value - now, trial, now, g
        if fell < 1e-7 * max(1e-3, abs(value)):
            break
    return x


def fit(rows: list[tuple[int, list[int], list[list[int]]]], names: np.ndarray) -> Model:
    """Logistic regression over rows of (toxic, places of features in names, the same for each counterfactual),
    minimising log loss + RIDGE |w|^2 + FAIRNESS * mean over counterfactuals of (logit - its logit)^2.

    Without rows of both labels the score is the smoothed share of toxic rows."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        share = (pos + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model({}, float(np.log(share / (1 - share))) if len(y) else -30.0)

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.array([f for x in lists for f in x], dtype=np.int64)

    row, col = matrix([r[1] for r in rows])
    pairs = [(i, s) for i, r in enumerate(rows) for s in r[2]]
    crow, ccol = matrix([s for _, s in pairs])
    owner = np.array([i for i, _ in pairs], dtype=np.int64)
    n, m = len(rows), len(names)

    def judged(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective and its gradient at weights and bias."""
        w, z = x[:m], np.bincount(row, weights=x[col], minlength=n) + x[m]
        value = float((np.logaddexp(0, z) - y * z).mean() + RIDGE * (w @ w))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.bincount(col, weights=e[row], minlength=m)
        if len(pairs):
            gap = z[owner] - (np.bincount(crow, weights=w[ccol], minlength=len(pairs)) + x[m])
            value += FAIRNESS * float(gap @ gap) / len(pairs)
            pull = 2 * FAIRNESS * gap / len(pairs)
            grad = grad + np.bincount(col, weights=np.bincount(owner, weights=pull, minlength=n)[row], minlength=m) - np.bincount(ccol, weights=pull[crow], minlength=m)
        return value, np.append(grad + 2 * RIDGE * w, e.sum())

    x = minimised(judged, np.append(np.zeros(m), np.log((pos + 0.5) / (neg + 0.5))))
    w, bias = x[:m], x[m]
    return Model({int(k): float(v) for k, v in zip(names, w, strict=True) if abs(v) > 1e-6}, float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled rows: those whose crc32(id) mod 5 is not 0 with the least hash of id.

    Null labels and ids are left out; several labels of an id count as toxic if any is. Texts become feature hashes
    on the executors, where the FEATURES of largest likelihood ratio are found by an aggregate (the terms of
    IDENTITY_GROUPS are features in any case, so that the penalty has something to act on). The driver gets those
    features' places in at most `rows` texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    sample = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` narrow rows: a proven bound, so broadcasting spares a shuffle of all texts
    kind = "doc_id long, toxic int, own array<int>, swapped array<array<int>>"
    data = cut(texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_featurised, kind))
    total = {r.toxic: r.n for r in data.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    # binomial likelihood ratio with toxic rows weighted up to the others' number
    share_a, share_b = (F.col("a") + 0.5) / (pos + 1), (F.col("n") - F.col("a") + 0.5) / (neg + 1)
    gain = F.abs(F.log(share_a / share_b)) * F.abs(F.col("a") - (F.col("n") - F.col("a")) * pos / max(neg, 1))
    top = (
        data.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
        .where("n >= 3").orderBy(gain.desc(), "f").limit(FEATURES).select("f").collect())
    names = np.array(sorted({r.f for r in top} | identity_features()), dtype=np.int64)
    got = data.mapInArrow(_selected(names), kind).toArrow().sort_by("doc_id")
    return fit([(r["toxic"], r["own"], r["swapped"]) for r in got.to_pylist()], names)


def _scorer(model: Model):
    """score(texts) with a bounded cache of words' parts of the logit; a feature of several words counts once."""
    weights, cache = model.weights, {}

    def parts(w: bytes) -> tuple[tuple[int, float], ...]:
        return tuple((f, weights[f]) for f in word_features(w) if f in weights)

    def score(text: str | None) -> float:
        found: dict[int, float] = {}
        for w in words(text):
            hit = cache.get(w)
            if hit is None:
                hit = parts(w)
                if len(cache) < CACHE:
                    cache[w] = hit
            if hit:
                found.update(hit)
        z = model.bias + sum(found[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    return score


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Only the text enters the score. Null and empty texts get the score of no words. A null id is not held out.
    Repeated rows get equal scores. An empty table gives an empty result. One scan, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            for part in slices(batch):
                s = [score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, type=pa.float64())], names=["doc_id", "score"])

    base = texts(docs, id_col, text_col)
    return base.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns, in one scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([score(t) < 0.5 for t in part.column(text_col).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

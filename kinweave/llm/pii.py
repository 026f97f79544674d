"""Personal data: base patterns, high-recall candidate generators, boosted trees over format and context, thresholds.

Everything that touches documents is Spark SQL. Only the model is fitted outside, on a few thousand invented sentences.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
_ONE = "struct<kind:int,s:int,e:int,m:string>"
_SPAN = f"array<{_ONE}>"

#: The base patterns. Possessive loops and a look-behind at the start of a run leave their matches as they are but
#: keep them linear on very long texts; \G lets a match begin right where the last one ended. A card has 13 digits
#: at least, so shorter runs are not gathered.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates; they overlap each other and the base on purpose and have no upper limits.
CANDIDATES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\{at\}|\(arroba\))\s?[A-Za-z0-9-]++(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+|(?=[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4}){0,6}::)[0-9A-Fa-f:]++)(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20./-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4})?(?![0-9A-Za-z])",
}
#: Elements that a scan copies at a time, and code points of a block that texts are read by.
CHUNK, BLOCK = 128, 4096
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
_FOR = {
    "email": "mail|write to|contact|schreib|écri|escrib|correo|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": "card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"phone|\btel|call|mobile|fax|ruf|handy|appel|mobil|llam|móvil",
}
_AGAINST = r"order|invoice|isbn|version|part|ref|serial|build|ticket|rechnung|bestell|facture|commande|factura|pedido|no\.|nr\.|id\b|page|score|date|room|code"


def _scan(items: Column, state: Callable, emit: Callable, out: str) -> Column:
    """All that emit(state, item), an array of `out`, gives for each item in order; the state is an int, 0 at first and
    state(state, item) after an item. A fold copies what it has gathered at every step, so items are gathered in chunks of
    CHUNK and the chunks after that: for n items n * CHUNK / 2 + (n / CHUNK) ** 2 / 2 copies, not n * n / 2."""
    cell = f"struct<st:int,out:array<{out}>>"
    none = F.array().cast(f"array<{out}>")

    def inner(st: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(st.alias("st"), none.alias("out")).cast(cell), lambda acc, x: F.struct(
            state(acc["st"], x).alias("st"), F.concat(acc["out"], emit(acc["st"], x)).alias("out")).cast(cell))

    def whole(it: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(it) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(it, k * CHUNK + 1, CHUNK))
        first = F.array(F.struct(F.lit(0).alias("st"), none.alias("out")).cast(cell))
        rows = F.aggregate(chunks, first, lambda acc, c: F.concat(acc, F.array(inner(F.element_at(acc, -1)["st"], c))))
        return F.flatten(F.transform(rows, lambda r: r["out"]))

    return let(items, whole)


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a piece is cut without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b - 1 of a text in blocks."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")

    def part(k: Column) -> Column:
        begin = F.greatest(a - k * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), begin + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - begin)

    return F.when(b > a, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (kind, start, end, match) in code points. Matches and the gaps between them come from the same
    leftmost scan, so running lengths give positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = let(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(f)), f,
                                             lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n"), m.alias("m"))))
    one = lambda pos, x: F.array(F.struct(F.lit(kind).alias("kind"), (pos + x["g"]).alias("s"), (pos + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))
    return _scan(steps, lambda pos, x: pos + x["g"] + x["n"], one, _ONE)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP_PARTS),
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _valid(kind: str):
    return lambda x: _VALID[kind](x["m"])


def _is(kind: int):
    return lambda x: x["kind"] == kind


def _empty() -> Column:
    return F.array().cast(_SPAN)


def _base_spans(text: Column, digit: Column) -> Column:
    when = {
        "email": text.contains("@"),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": digit & text.contains("+"),
    }
    return F.concat(*(F.when(when[k], F.filter(_located(text, BASE[k], i), _valid(k))).otherwise(_empty()) for i, k in enumerate(KINDS)))


def _candidate_spans(text: Column, digit: Column) -> Column:
    when = {"email": text.rlike(r"(?:\(at\)|\[at\]|\{at\}|\(arroba\))"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]|::[0-9A-Fa-f]|[0-9A-Fa-f]::"), "card": digit & text.rlike(r"[0-9]{4}[._/][0-9]{4}"), "phone": digit}
    return F.concat(*(F.when(when[k], _located(text, CANDIDATES[k], i)).otherwise(_empty()) for i, k in enumerate(KINDS)))


#: Features of a candidate, in the order that trees refer to them.
FEATURES = ("kind", "digits", "length", "separators", "paren", "luhn", "wanted", "against", "distinct", "zero", "marked", "domain", "groups", "year")
#: Code points before a candidate that count as its context.
CONTEXT = 32


def _features(blocks: Column, x: Column) -> Column:
    before = F.lower(_piece(blocks, F.greatest(F.lit(0), x["s"] - CONTEXT), x["s"]))
    return let(before, lambda b: let(_digits(x["m"]), lambda d: _feature_values(x, b, d)))


def _feature_values(x: Column, before: Column, d: Column) -> Column:
    m, wanted = x["m"], F.lit(False)
    for i, k in enumerate(KINDS):
        wanted = wanted | ((x["kind"] == i) & before.rlike("(?iuU)" + _FOR[k]))
    values = (
        x["kind"], F.length(d), F.char_length(m), F.char_length(F.regexp_replace(m, r"[^\x20./_:-]", "")), m.startswith("("),
        F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False), wanted, before.rlike("(?iuU)" + _AGAINST),
        F.size(F.array_distinct(F.split(d, ""))), d.startswith("0"), m.rlike(r"[(\[{]"), m.rlike(r"[.\])}]\s?[A-Za-z]{2,6}$"),
        F.size(F.split(m, r"[^0-9A-Za-z]+")), m.rlike(r"^\(?(?:19|20)[0-9]{2}\b"))
    return F.array(*(v.cast("double") for v in values))


@dataclass(frozen=True)
class Trees:
    """Sum of depth-2 trees: (feature, cut, then (feature, cut, low, high) on either side), a slope and offset that
    calibrate its logit, and a threshold per kind."""

    trees: tuple
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def probability(self, f: Column) -> Column:
        """Of an array of features that costs nothing to read again."""
        z = F.lit(0.0)
        for i, cut, low, high in self.trees:
            leaf = [F.when(f[j] <= c, F.lit(a)).otherwise(F.lit(b)) for j, c, a, b in (low, high)]
            z = z + F.when(f[i] <= cut, leaf[0]).otherwise(leaf[1])
        return 1 / (1 + F.exp(-(z * self.slope + self.offset)))


#: Sentences the trees are fitted on and tested on; contexts and formats of the tests are never used for the fit.
SENTENCES = 3000
_LEAD = ("Yesterday", "Please note", "Bitte", "Por favor", "Merci", "As agreed", "For the record", "Nota", "Übrigens", "Also", "In short", "Hello", "Hola", "Bonjour")
#: (kind, label): contexts to fit on, contexts to test on. {} is the candidate.
_CONTEXTS = {
    ("phone", 1): (("call me at {}", "Tel. {}", "phone: {}", "mobile {}", "Handy {}", "appelez le {}", "llame al {}", "fax {}", "Rufnummer {}", "his phone number is {}", "Telefon: {}", "ring us, phone {} any time"),
                   ("you can phone {}", "téléphone {}", "reach my mobile: {}", "teléfono {}", "Anruf unter Tel {}")),
    ("email", 1): (("write to {}", "mail {}", "contact {}", "correo {}", "schreib an {}", "écrivez à {}", "her e-mail is {}", "{} for details", "ask {} about it", "sent by {}"),
                   ("questions go to {}", "Kontakt: {}", "{} will answer", "escríbame: {}")),
    ("ip", 1): (("server {}", "host {}", "my ip is {}", "Adresse {}", "logged in from {}", "dirección {}", "ping {}", "blocked address {}", "seen from {}"),
                ("the router answers on {}", "request from {} was denied", "hôte {}")),
    ("card", 1): (("card {}", "visa {}", "Karte {}", "carte {}", "tarjeta {}", "charged to {}", "credit card no {}", "paid with {}", "mastercard: {}"),
                  ("bill it to {}", "Kreditkarte {}", "the card number {} works")),
    ("phone", 0): (("order {}", "invoice {}", "Rechnung {}", "pedido {}", "ref {}", "part {}", "serial {}", "the years {} were good", "on {} it rained", "version {}", "score {}", "isbn {}", "room {}", "item code {}", "about {} people came", "facture {}", "Bestellung {}", "build {}", "page {}"),
                   ("ticket {}", "commande {}", "model {}", "roughly {} units", "dated {}", "bestellt unter Nr. {}")),
    ("email", 0): (("we met {} that day", "see {} below", "he arrived {} again"), ("they waited {} long",)),
    ("ip", 0): (("the call {} fails", "use {} in the code", "at {} it began", "namespace {}", "ratio {}"), ("a constant {} there", "write {} here")),
    ("card", 0): (("serial {}", "part {}", "dates {}", "batch {}", "document {}", "licence {}", "order {}"), ("parcel {}", "lot {}", "archive {}")),
}


def sentences(n: int = SENTENCES, seed: int = 11, test: bool = False) -> list[tuple[int, str, int]]:
    """Invented sentences with one candidate each: (number, text, 1 if it is personal data). Kinds and labels take turns;
    formats, contexts and languages are drawn."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(4, 9)))
    hexa = lambda: format(r.randint(0, 65535), "x")

    def card(good: bool) -> str:
        d = [int(c) for c in r.choice("3456") + num(14)]
        total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(d))
        check = -total % 10 if good else (-total + r.randint(1, 9)) % 10
        s = "".join(map(str, d)) + str(check)
        return r.choice("._/").join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(3)}{num(3)}", f"({num(4)}) {num(3)}{num(3)}", f"0{num(1)}.{num(3)}.{num(3)}", f"{num(3)}.{num(3)}.{num(4)}"))

    def email() -> str:
        at, dot = r.choice((" (at) ", "(at)", "[at]", " [at] ", "{at}", " (arroba) ")), r.choice((" (dot) ", "(dot)", "[dot]", ".", "."))
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}_{num(2)}", f"{word()}{num(3)}"))
        return f"{name}{at}{'-'.join(word() for _ in range(r.randint(1, 2)))}{dot}{r.choice(('com', 'org', 'de', 'net', 'fr', 'es', 'io', 'edu'))}"

    def ip() -> str:
        k = r.randint(1, 4)
        return r.choice((":".join(format(r.randint(4096, 65535), "x") for _ in range(8)), ":".join(hexa() for _ in range(8)), f"2001:db8::{hexa()}", f"fe80::{':'.join(hexa() for _ in range(k))}", f"{':'.join(format(r.randint(256, 65535), 'x') for _ in range(k))}::{format(r.randint(16, 65535), 'x')}"))

    year = lambda: str(r.randint(1900, 2030))
    make = {
        ("phone", 1): phone, ("email", 1): email, ("ip", 1): ip, ("card", 1): lambda: card(True),
        ("phone", 0): lambda: r.choice((f"{num(3)}-{num(3)}-{num(4)}", f"{num(2)} {num(3)} {num(2)}", f"{year()}-{year()}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)}-{num(4)}-{num(4)}", f"{num(2)} {num(3)} {num(3)}", f"{year()} {num(3)} {num(3)}", f"{num(5)}/{num(4)}", f"{num(2)}.{num(4)}.{num(3)}", f"{num(3)} {num(3)}")),
        ("email", 0): lambda: f"{word()} (at) {word()}.{num(r.randint(1, 4))}",
        ("ip", 0): lambda: r.choice((f"{r.choice('abcdef')}::{r.choice('abcdef')}", "::", f"{num(1)}::{num(1)}", f"{num(2)}:{num(2)}::", "add::face", "bad::f")),
        ("card", 0): lambda: r.choice((card(False), f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"{num(4)}/{num(4)}/{num(4)}/{num(2)}", f"{year()}/{year()}/{year()}/{num(4)}")),
    }
    keys = sorted(make)
    out = []
    for i in range(n):
        key = keys[i % len(keys)]
        line = r.choice(_CONTEXTS[key][test]).format(make[key]())
        out.append((i, f"{r.choice(_LEAD)} {word()} {line} {word()} {word()}.", key[1]))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> list[tuple]:
    """Gradient boosting of depth-2 trees on the log loss, exact splits, deterministic."""
    z, trees = np.zeros(len(y)), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        best = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            for c in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= c
                a, b = rows[left], rows[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, j, float(c))
        return best

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        _, i, cut = split(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, i] <= cut), np.flatnonzero(x[:, i] > cut)):
            _, j, c = split(rows, g, h)
            leaves = []
            for leaf in (rows[x[rows, j] <= c], rows[x[rows, j] > c]):
                v = float(rate * g[leaf].sum() / (h[leaf].sum() + 1))
                z[leaf] += v
                leaves.append(v)
            sides.append((j, c, *leaves))
        trees.append((i, cut, *sides))
    return trees


def _margin(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    z = np.zeros(len(x))
    for i, cut, low, high in trees:
        for side, rows in ((low, x[:, i] <= cut), (high, x[:, i] > cut)):
            j, c, a, b = side
            z += np.where(rows, np.where(x[:, j] <= c, a, b), 0)
    return z


def fit(spark: SparkSession, precision: float = 0.98) -> Trees:
    """Trees fitted on two thirds of the invented sentences; slope, offset and each kind's threshold (the least
    probability that keeps `precision`) come from the other third. Features are computed by the same expressions as
    on documents. The data is fixed, so its size is, too."""
    return _fitted(_feature_rows(spark), precision)


def _feature_rows(spark: SparkSession, rows: list[tuple[int, str, int]] | None = None) -> tuple:
    df = spark.createDataFrame(rows or sentences(), "n int, text string, y int").repartition(8)
    found = df.withColumn("c", _candidate_spans(F.col("text"), F.lit(True))).select(
        "n", "y", let(_blocks(F.col("text")), lambda b: F.transform("c", lambda c: _features(b, c))).alias("f"))
    return tuple((r.n, r.y, tuple(f)) for r in found.orderBy("n").collect() for f in r.f)  # bounded by SENTENCES


def judged(spark: SparkSession, model: Trees, rows: list[tuple[int, str, int]]) -> dict[str, tuple[int, int, int]]:
    """(true positives, false positives, false negatives) per kind over labelled sentences, candidates by candidates."""
    out = {k: [0, 0, 0] for k in KINDS}
    for _, y, f in _feature_rows(spark, rows):
        kind, p = int(f[0]), 1 / (1 + np.exp(-(_margin(list(model.trees), np.array([f]))[0] * model.slope + model.offset)))
        out[KINDS[kind]][(0 if y else 1) if p >= model.thresholds[kind] else 2] += 1 if y or p >= model.thresholds[kind] else 0
    return {k: tuple(v) for k, v in out.items()}


@lru_cache(maxsize=4)
def _fitted(rows: tuple, precision: float) -> Trees:
    n, y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    own = n % 6 < 4
    trees = boost(x[own], y[own])
    z, t = _margin(trees, x[~own]), y[~own]
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Platt's calibration by Newton steps, slightly damped
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        g, h = p - t, p * (1 - p) + 1e-6
        grad = np.array([(g * z).sum() + 0.01 * (slope - 1), g.sum() + 0.01 * offset])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        slope, offset = np.array([slope, offset]) - 0.5 * np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-(slope * z + offset)))
    limits = []
    for k in range(len(KINDS)):
        of = x[~own][:, 0] == k
        fits = [c for c in np.unique(np.append(p[of], 0.5)) if c >= 0.5 and (not (p[of] >= c).any() or t[of][p[of] >= c].mean() >= precision)]
        limits.append(float(min(fits, default=1.1)))
    return Trees(tuple(trees), float(slope), float(offset), tuple(limits))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, base and spans, both array<struct<kind int, s int, e int, m string>>.

    kind indexes KINDS; s and e are code points, e exclusive. base holds the base patterns' valid matches by kind, then
    start; spans holds them and the selected candidates in the same order. A candidate is selected where its
    calibrated probability reaches its kind's threshold and it overlaps no base span; of overlapping ones the
    one that starts first, then the longest, stays. Null texts count as empty. Null ids and repeated rows are
    kept as they come. Very long texts are searched whole by patterns without nested backtracking.

    One scan, no shuffle, no Python on executors. Texts without a digit, @ or at-marker skip all patterns.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spans_of(base, model or fit(docs.sparkSession)).select("doc_id", "text", "base", "spans")


def spans_of(docs: DataFrame, model: Trees) -> DataFrame:
    """docs, which hold a column text without nulls and none called base, spans, digit, more or added, with base and spans."""
    text = F.col("text")
    base = docs.withColumn("digit", text.rlike("[0-9]"))
    base = base.withColumn("base", _base_spans(text, F.col("digit"))).withColumn("more", _candidate_spans(text, F.col("digit")))
    added = F.when(F.size("more") > 0, _apart(_chosen(_blocks(text), _clear(F.col("more"), F.col("base")), model))).otherwise(_empty())
    return base.withColumn("added", added).withColumn(
        "spans", F.when(F.size("added") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))))


def _clear(more: Column, base: Column) -> Column:
    """Candidates that overlap no base span, in one sweep: of all base spans that begin before a candidate ends, none
    may end after it begins. Base spans come at their start, candidates at their end, before a base span that starts there."""
    event = "struct<at:int,base:int,edge:int,x:struct<kind:int,s:int,e:int,m:string>>"
    events = F.concat(F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("base"), b["e"].alias("edge"), b.alias("x")).cast(event)),
                      F.transform(more, lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("base"), c["s"].alias("edge"), c.alias("x")).cast(event)))
    return _scan(F.array_sort(events), lambda top, e: F.when(e["base"] == 1, F.greatest(top, e["edge"])).otherwise(top),
                 lambda top, e: F.when((e["base"] == 0) & (top <= e["edge"]), F.array(e["x"])).otherwise(F.array().cast(_SPAN)), _ONE)


def _chosen(blocks: Column, candidates: Column, model: Trees) -> Column:
    """Candidates whose calibrated probability reaches their kind's threshold."""
    limit = F.array(*(F.lit(float(x)) for x in model.thresholds))
    return let(blocks, lambda b: F.filter(candidates, lambda c: let(_features(b, c), model.probability) >= limit[c["kind"]]))


def _apart(spans: Column) -> Column:
    """Of overlapping spans the one that starts first, then the longest, stays."""
    turned = "struct<s:int,ne:int,kind:int,m:string>"
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("ne"), c["kind"].alias("kind"), c["m"].alias("m")).cast(turned)))
    back = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), (-c["ne"]).alias("e"), c["m"].alias("m"))
    return _scan(ordered, lambda end, c: F.when(end <= c["s"], -c["ne"]).otherwise(end),
                 lambda end, c: F.when(end <= c["s"], F.array(back(c))).otherwise(F.array().cast(_SPAN)), _ONE)


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans as kind:start:end joined by commas."""
    found = find_pii(docs, id_col, text_col, model)
    n = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    turned = "struct<s:int,ne:int,kind:int>"
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["kind"].alias("kind")).cast(turned)))
    last = F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0))

    def whole(b: Column) -> Column:
        parts = _scan(ordered, lambda pos, x: F.greatest(pos, -x["ne"]),
                      lambda pos, x: F.when(x["s"] >= pos, F.array(_piece(b, pos, x["s"]), tag[x["kind"]])).otherwise(F.array().cast("array<string>")), "string")
        return F.array_join(F.concat(parts, F.array(_piece(b, last, F.char_length(text)))), "")

    return let(_blocks(text), whole)


def redact_documents(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """docs with text_col redacted, in one scan; all other columns, their order and null texts stay."""
    spark = docs.sparkSession
    model = model or fit(spark)
    holder = docs.select(F.struct("*").alias("__row"))
    text = F.col(f"__row.`{text_col}`")
    found = spans_of(holder.withColumn("text", F.coalesce(text, F.lit(""))), model)
    clean = F.when(text.isNotNull(), F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return found.select(*((clean if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))

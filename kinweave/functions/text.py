"""Text functions as Columns. Patterns carry (?U) so that classes are Unicode ones, as in the data's languages."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Apostrophes that a slug drops rather than turns into hyphens.
APOSTROPHES = "'’ʼ`´"
#: Typographic characters and their plain forms in quotation matching.
PLAIN = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "ʼ": "'", "ʹ": "'", "′": "'", "´": "'", "`": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
}
#: Words an acronym skips, and its least number of letters.
GLUE, MIN_ACRONYM = ("of", "the", "and", "for", "at", "in", "on", "de"), 3
#: Least size of a quotation that counts as evidence.
MIN_QUOTE_CHARS, MIN_QUOTE_WORDS = 16, 3
MAX_TEXT, CLIP_SLACK = 20_000, 200


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From the Unicode rule: characters whose compatibility form without marks is one character, as two strings for
    translate(), and those with a longer form that holds an ASCII letter or digit."""
    one, more = {}, {}
    for cp in range(0xA0, 0x20000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF:  # Hangul syllables, surrogates and private use stay
            continue
        c = chr(cp)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c:
            one[c] = d
        elif len(d) > 1 and any(x.isascii() and x.isalnum() for x in d):
            more[c] = d
    return "".join(one), "".join(one.values()), more


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """From the Unicode rule: characters whose case folding is not their lower case, split as above."""
    odd = {chr(cp): chr(cp).casefold() for cp in range(0x80, 0x20000) if not 0xD800 <= cp <= 0xDFFF and chr(cp).casefold() != chr(cp).lower()}
    one = {c: d for c, d in odd.items() if len(d) == 1}
    return "".join(one), "".join(one.values()), {c: d for c, d in odd.items() if len(d) > 1}


def _rewritten(c: Column, table: tuple[str, str, dict[str, str]]) -> Column:
    """Characters of one counterpart go through one translate(); those of several, which are rare, only where a text has any."""
    one, to, more = table
    base = F.translate(c, one, to)
    by = F.from_json(F.lit(json.dumps(more)), "map<string,string>")
    wide = F.array_join(F.transform(F.split(base, ""), lambda x: F.coalesce(F.try_element_at(by, x), x)), "")
    # one look-up a character; a class of hundreds of characters in a pattern would be tried one by one
    return F.when(F.char_length(F.translate(base, "".join(more), "")) < F.char_length(base), wide).otherwise(base)


def unaccent(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _rewritten(F.regexp_replace(c, r"\p{M}", ""), _decompositions())


def slug(c: Column) -> Column:
    """Unaccented, apostrophes dropped, lower case, other runs to one hyphen, hyphens trimmed. Null stays null."""
    plain = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(unaccent(c))
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(plain, APOSTROPHES, "")), "[^a-z0-9]+", "-"), "^-|-$", "")


def normalize_ws(c: Column) -> Column:
    """White-space runs to one space, trimmed, case folded."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(plain)).otherwise(F.lower(_rewritten(plain, _foldings())))


def sentence(c: Column) -> Column:
    """White space normalised, case kept."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def doc_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def folded(c: Column) -> Column:
    """normalize_ws after plain forms of typographic quotes, dashes and ellipses."""
    return normalize_ws(F.replace(F.translate(c, "".join(PLAIN), "".join(PLAIN.values())), F.lit("…"), F.lit("...")))


def cites_document(evidence: Column, text: Column) -> Column:
    e = normalize_ws(evidence)
    return F.coalesce((e != "") & F.contains(normalize_ws(text), e), F.lit(False))


def is_evidence(quote: Column) -> Column:
    """Whether a folded quotation is long enough to count."""
    q = folded(quote)
    return (F.char_length(q) >= MIN_QUOTE_CHARS) & (F.size(F.split(q, " ")) >= MIN_QUOTE_WORDS)


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text with no letter or digit right before or after it; both folded here."""
    return holds_folded(folded(text), folded(phrase))


def holds_folded(t: Column, p: Column) -> Column:
    """holds_phrase() of a text and a phrase that are folded already."""
    escaped = F.regexp_replace(p, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    bounded = F.concat(F.lit(r"(?U)(?<![\p{L}\p{N}])"), escaped, F.lit(r"(?![\p{L}\p{N}])"))
    return F.coalesce((p != "") & F.contains(t, p) & F.regexp_like(t, bounded), F.lit(False))


def is_cited(quote: Column, text: Column) -> Column:
    """Whether a text holds the quotation as whole words and the quotation is long enough."""
    return F.coalesce(is_evidence(quote), F.lit(False)) & holds_phrase(text, quote)


def cited_span(quote: str | None, text: str | None) -> str | None:
    """The text's own characters for the first whole-word occurrence of a quotation, or None. Row form, for Arrow
    functions behind the native is_cited()."""
    if not quote or not text:
        return None
    t, at = _fold(text)
    q = _fold(quote)[0].strip()
    if len(q) < MIN_QUOTE_CHARS or len(q.split(" ")) < MIN_QUOTE_WORDS:
        return None
    for m in re.finditer(re.escape(q), t):
        a, b = m.span()
        if not (a and t[a - 1].isalnum()) and not (b < len(t) and t[b].isalnum()):
            return text[at[a] : at[b - 1] + 1]
    return None


def _fold(s: str) -> tuple[str, list[int]]:
    """Folded characters and, for each, its place in s."""
    out, at = [], []
    for i, c in enumerate(s):
        for x in " " if c.isspace() else "..." if c == "…" else PLAIN.get(c, c).casefold():
            if x == " " and out and out[-1] == " ":
                continue
            out.append(x)
            at.append(i)
    return "".join(out), at


def tokens(c: Column) -> Column:
    """Words of a-z and digits, two characters or more, in order."""
    return F.filter(F.split(normalize_ws(c), "[^0-9a-z]+"), lambda x: F.length(x) > 1)


def carries_name(want: Column, have: Column) -> Column:
    """Whether all name tokens are among the other's, in any order; a name without tokens never is."""
    return (F.size(tokens(want)) > 0) & (F.size(F.array_except(tokens(want), tokens(have))) == 0)


def mentions_name(want: Column, prose: Column) -> Column:
    """Whether the name's tokens stand side by side in the prose."""
    pad = lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" "))
    return (F.size(tokens(want)) > 0) & F.contains(pad(prose), pad(want))


def mentions_tokens(text: Column, parts: Column) -> Column:
    """Whether each token stands in the text as a whole word; no tokens are never mentioned."""
    t = normalize_ws(text)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.regexp_like(t, F.concat(F.lit(r"(?U)\b"), F.regexp_replace(p, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\b"))))


def clip(c: Column, limit: int = MAX_TEXT) -> Column:
    """At most limit characters; a word cut in its last CLIP_SLACK characters goes whole."""
    head = F.substring(c, 1, limit)
    tail = F.char_length(F.substring_index(head, " ", -1))
    at_word = F.contains(head, F.lit(" ")) & (tail < CLIP_SLACK)
    short = F.when(at_word, F.substring(head, F.lit(1), F.char_length(head) - tail - 1)).otherwise(head)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.rtrim(short))


def text_block(*parts: Column) -> Column:
    """Non-blank parts, trimmed, one a line."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def acronym_of(label: Column) -> Column:
    """Initials of three or more significant words in upper case, else null."""
    words = F.filter(F.split(label, "[^0-9A-Za-z]+"), lambda w: (w != "") & ~F.lower(w).isin(*GLUE))
    return F.when(F.size(words) >= MIN_ACRONYM, F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""))


def reads_as_acronym(label: Column) -> Column:
    return F.trim(label).rlike(f"^[A-Z]{{{MIN_ACRONYM},}}$")


def qids(text: Column) -> Column:
    """Distinct Wikidata identifiers in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])(Q[1-9][0-9]*)(?![A-Za-z0-9])"), F.lit(1)))


def cik(text: Column) -> Column:
    """The first 10-digit SEC filer number, zero-padded, or null."""
    n = F.regexp_extract(text, r"(?i)\bCIK[=:#\s]*0*([0-9]{1,10})\b", 1)
    return F.when(n != "", F.lpad(n, 10, "0"))


def field(text: Column, name: str) -> Column:
    """The value of a `Name: value` line, or null where it is missing or says it is unset."""
    v = F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{re.escape(name)}[ \t]*:[ \t]*(.*?)[ \t]*$", 1))
    return F.when((v != "") & ~F.lower(v).isin("none", "null", "n/a", "unknown", "unset", "-"), v)


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bhttps?://[^\s<>\"')\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def host(url: Column) -> Column:
    """Lower-case host without www., or null."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def unwrap_redirect(url: Column) -> Column:
    """The target of a search result's redirect link (/l/?uddg=...), or the link itself."""
    target = F.try_parse_url(url, F.lit("QUERY"), F.lit("uddg"))
    return F.coalesce(F.when(F.contains(url, F.lit("/l/?")), F.try_url_decode(target)), url)


def unfence(text: Column) -> Column:
    """The inside of a fenced block, or the trimmed text."""
    inside = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inside != "", F.trim(inside)).otherwise(F.trim(text))


def looks_binary(text: Column) -> Column:
    """NUL, over 10 % replacement characters or over 2 % control characters in the first 4096: a sniff by design."""
    head = F.substring(text, 1, 4096)
    n = F.char_length(head)
    bad = n - F.char_length(F.replace(head, F.lit("�"), F.lit("")))
    control = n - F.char_length(F.regexp_replace(head, r"[\x01-\x08\x0e-\x1f\x7f]", ""))
    return F.coalesce((n > 0) & (F.contains(head, F.lit("\x00")) | (bad > 0.1 * n) | (control > 0.02 * n)), F.lit(False))


def invert(words: Column) -> Column:
    """Inverted index {word: [positions]} of an array of words, as JSON. One sort of all words inside the row: runs of a word are its
    entries, so nothing is shuffled."""
    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.struct(x["w"].alias("w"), i.alias("at"), F.coalesce(F.get(s, i - 1)["w"] != x["w"], F.lit(True)).alias("k"))), lambda x: x["k"])
        place = lambda x, to: F.transform(F.slice(s, x["at"] + 1, to - x["at"]), lambda y: y["p"])
        return once(heads, lambda h: F.transform(h, lambda x, i: F.struct(x["w"].alias("w"), place(x, F.coalesce(F.get(h, i + 1)["at"], F.size(s))).alias("ps"))))

    return F.to_json(F.map_from_entries(once(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p")))), runs)))


#: Fixed value: the longest name of a field that Spark's JSON parser reads; it has no such limit on values.
MAX_NAME = 50_000


def _long_entries(index_json: Column) -> Column:
    """Entries of an inverted index with a word too long for a name: words become values. Escaped backslashes and quotes
    stand aside as raw control characters, which JSON has none of, so that a word ends at the next quote."""
    aside = F.replace(F.replace(index_json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    rows = F.regexp_replace(F.regexp_replace(aside, r'"([^"]*)"\s*:\s*(\[[^\]]*\])', '{"key":"$1","value":$2}'), r"(?s)^\s*\{(.*)\}\s*$", "[$1]")
    back = F.replace(F.replace(rows, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.from_json(back, "array<struct<key:string,value:array<int>>>", {"maxStringLen": str(2**31 - 1)})


def deinvert(index_json: Column) -> Column:
    """Text of an inverted index {word: [positions]}; of words at one position the last stays. One sort of all positions."""
    read = lambda j: F.coalesce(F.map_entries(F.from_json(j, "map<string,array<int>>")), F.when(F.char_length(j) > MAX_NAME, _long_entries(j)))
    entries = once(index_json, read)
    words = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    last = lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["w"].alias("w"), F.coalesce(F.get(s, i + 1)["p"] != x["p"], F.lit(True)).alias("k"))), lambda x: x["k"]), lambda x: x["w"])
    return F.array_join(once(F.sort_array(words), last), " ")


def looks_like(body: Column) -> Column:
    """json, html, xml or text, by how a body begins; null for a blank one."""
    b = F.lower(F.substring(F.ltrim(body), 1, 512))
    return F.when(b == "", None).when(b.rlike(r"^[\[{]"), "json").when(b.rlike(r"^<(?:!doctype html|html|head|body)\b"), "html").when(
        b.rlike(r"^<\?xml|^<(?:rss|feed|rdf:rdf)\b"), "xml").when(b.rlike(r"<(?:html|head|body|div|p)\b"), "html").otherwise("text")


#: Endings of media types that are text whatever their tree, and trees and types that are none.
TEXT_SUFFIXES = ("+json", "+xml", "+yaml", "+text")
BINARY_TREES = ("image/", "audio/", "video/", "font/")
BINARY_TYPES = ("application/pdf", "application/zip", "application/gzip", "application/octet-stream", "application/msword", "application/postscript")


def is_binary_type(content_type: Column) -> Column:
    """Whether a media type names no text; a missing one does not."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    suffix = F.lit(False)
    for s in TEXT_SUFFIXES:
        suffix = suffix | media.endswith(s)
    tree = F.lit(False)
    for t in BINARY_TREES:
        tree = tree | media.startswith(t)
    return ~suffix & (media.isin(*BINARY_TYPES) | tree | media.startswith("application/vnd."))


def spoken_label(label: Column, kind: Column) -> Column:
    """A sentence-cased common noun of several words starts small inside a sentence; names keep their capitals."""
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    head = F.get(words, F.lit(0))
    lower = (kind.isin("cause", "technology", "topic") & (F.size(words) >= 2) & head.rlike(r"^\p{Lu}[^\p{Lu}]*$")
             & ~F.exists(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{Lu}")))
    return F.when(lower, F.concat(F.lower(F.substring(F.ltrim(label), 1, 1)), F.substring(F.ltrim(label), F.lit(2), F.char_length(label)))).otherwise(label)


def sentence_list(items: Column) -> Column:
    """a / a and b / a, b and c."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


#: Words that open a slot for a noun, irregular verb forms, words before a score, punctuation that a word may carry.
SLOT_WORDS = (
    "a", "about", "after", "against", "an", "at", "before", "by", "during", "for", "from", "in", "into", "of", "on", "onto", "over",
    "the", "through", "to", "toward", "towards", "under", "with", "within", "without",
)
VERB_FORMS = (
    "am", "are", "became", "began", "bought", "broke", "brought", "built", "chose", "drew", "drove", "fell", "felt", "found", "gave", "got", "grew", "had",
    "has", "have", "held", "is", "kept", "knew", "left", "led", "lost", "made", "met", "paid", "put", "ran", "read", "said", "sat", "saw", "sent", "set",
    "sold", "spent", "spoke", "stood", "taught", "thought", "told", "took", "was", "went", "were", "won", "wore", "wrote",
)
SCORE_WORDS = (
    "score", "scored", "scores", "scoring", "rank", "ranked", "ranks", "ranking", "rated", "rating", "points", "weight", "weighted",
)
EDGE = ".,;:!?'\""
SPOKEN = 30
_LINK, _MARK, _BRACKETED = r"(?i)http", r"\[\s*[0-9]+\s*\]", r"\([^)]*\)"
#: A capitalised word after a slot word, with another word after it and no punctuation between, that reads as a verb: a
#: sentence set where a noun belongs. All capitals are an acronym.
_SPLICE = (rf"(?U)(?<!\S)(?i:{'|'.join(SLOT_WORDS)})\s+['\"]*(?=\p{{Lu}})(?![^\s\p{{Ll}}]+\s)"
           rf"(?:(?i:{'|'.join(VERB_FORMS)})|(?i:[^\s.,;:!?'\"-][^\s-]*[^\s-](?:s|ed|ing))|(?i:[^\s]+-[^\s]*(?:ed|ing)))(?=\s+\S)")
_BARE_EDGE = f"^[{EDGE}]+|[{EDGE}]+$"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def once(c: Column, then) -> Column:
    """then(c) with c computed once a row, however often it is named: names of a lambda are values, other columns are copied."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def _is_score(words: Column, w: Column, i: Column) -> Column:
    """Whether word i is a score: a share of a hundred, or a whole number up to 100 after a word of scoring."""
    bare = F.regexp_replace(w, _BARE_EDGE, "")
    before = F.lower(F.regexp_replace(F.get(words, i - 1), _BARE_EDGE, ""))
    small = bare.rlike("^[0-9]{1,3}$") & (bare.try_cast("int") <= 100)
    return bare.rlike(r"^[0-9]{1,3}(?:/100|%)$") | F.coalesce(small & (i > 0) & before.isin(*SCORE_WORDS), F.lit(False))


def is_speakable(c: Column, most: int = SPOKEN, nouns: Column | None = None) -> Column:
    """Whether a line can be read aloud as it is: not blank, no link, no reference mark, no parenthesis, at most `most` words, no
    score, and no sentence set where a noun belongs. `nouns` (an array) are phrases known to be names, which may look like verbs."""
    bare = lambda t: t if nouns is None else F.aggregate(F.coalesce(nouns, F.array().cast("array<string>")), t, lambda t, n: F.when(F.trim(n) == "", t).otherwise(
        F.regexp_replace(t, F.concat(F.lit(r"(?iU)(?<!\S)"), F.regexp_replace(F.trim(n), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"(?!\w)")), F.lit("x"))))

    def worded(t: Column, words: Column) -> Column:
        scored = F.exists(F.transform(words, lambda w, i: _is_score(words, w, i)), lambda x: x)
        return (F.trim(t) != "") & ~t.rlike(_LINK) & ~t.rlike(_MARK) & ~t.rlike("[()]") & (F.size(words) <= most) & ~scored & ~bare(t).rlike(_SPLICE)

    return F.coalesce(once(c, lambda t: once(_words(t), lambda words: worded(t, words))), F.lit(False))


def speakable(c: Column, most: int = SPOKEN) -> Column:
    """A line without what cannot be read aloud: reference marks, parentheses, links and scores go, at most `most` words
    stay, with a full stop if some were cut. A sentence set where a noun belongs cannot be mended."""
    clean = F.translate(F.regexp_replace(F.regexp_replace(c, _MARK, " "), _BRACKETED, " "), "()", "  ")
    unscored = lambda words: F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), _is_score(words, w, i).alias("s"))), lambda x: ~x["s"]), lambda x: x["w"])
    joined = lambda kept: F.regexp_replace(F.trim(F.array_join(F.slice(kept, 1, most), " ")), r"\s+([.,;:!?])", "$1")
    stopped = lambda kept: once(joined(kept), lambda line: F.when((F.size(kept) > most) & (line != "") & ~line.rlike("[.!?]$"), F.concat(line, F.lit("."))).otherwise(line))
    return once(F.filter(_words(clean), lambda w: ~w.rlike(_LINK)), lambda words: once(unscored(words), stopped))

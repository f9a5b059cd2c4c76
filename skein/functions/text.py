"""Text, set and JSON functions on columns, all on the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import plain

NOT_IN_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
APOSTROPHES = "[\u2019'`]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


# ---- scalar text

def collapse(x: Column | str) -> Column:
    """White space runs to one space, trimmed; null to empty (B1)."""
    return F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " "))


def signature(is_user: Column | str, text: Column | str) -> Column:
    """Of a message: its role and visible text, not its author's name (B2)."""
    return F.md5(F.concat(F.when(col(is_user), "u|").otherwise("a|"), collapse(text)))


def _decomposed(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition without accents is one character, and that character."""
    every = (chr(c) for c in range(0xA0, 0x30000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF)
    pairs = [(c, bare) for c in every if len(bare := _decomposed(c)) == 1 and bare != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def ligatures() -> str:
    """A pattern for the characters that decompose into several, as ranges of code points."""
    own = [c for c in range(0xA0, 0x30000) if not 0xD800 <= c <= 0xDFFF and len(_decomposed(chr(c))) > 1]
    first = [c for c, before in zip(own, [-9, *own]) if c != before + 1]
    last = [c for c, after in zip(own, [*own[1:], -9]) if c != after - 1]
    # ASCII is told apart first: every character that no range holds is held against all of them.
    return "[^\\x00-\\x7F&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last)) + "]]"


# fixed values: letters with a stroke, which have no decomposition though the JVM's library drops the stroke
STROKES = "\u0110\u0111\u0141\u0142\u0166\u0167\u0197\u0244\u0268\u0289\u1d7b\u1d7e"
KEPT_STROKES = "".join(chr(0xE000 + k) for k in range(len(STROKES)))


def decomposed(x: Column | str) -> Column:
    """The compatibility decomposition without accents; only texts with a ligature or the like leave generated code."""
    single = F.translate(text_of(x), *plain_letters())
    whole = F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), F.translate(single, STROKES, KEPT_STROKES))
    return F.regexp_replace(F.when(single.rlike(ligatures()), F.translate(whole, KEPT_STROKES, STROKES)).otherwise(single), "[\u0300-\u036f]", "")


def norm(x: Column | str) -> Column:
    """Lower case, no accents, no punctuation, single spaces (C2); the same as the rule in Python.

    A text of ASCII alone has nothing to decompose, and is spared the tables of all other characters.
    """
    text = text_of(x)
    spaced = lambda c, other: F.trim(F.regexp_replace(F.regexp_replace(c, APOSTROPHES, ""), other, " "))
    return F.when(text.rlike(r"[^\x00-\x7F]"), spaced(F.lower(decomposed(text)), r"(?U)[^\p{L}\p{N}]+")).otherwise(spaced(F.lower(text), "[^a-z0-9]+"))


def hash53(x: Column | str) -> Column:
    """The 53-bit hash of older ledgers in base 36, for their ids (C1): two 32-bit lanes over UTF-16 units, then mixed."""

    def times(v: Column, k: int) -> Column:
        """v * k modulo 2^32 without overflow: k in halves."""
        return ((v * (k >> 16)).bitwiseAND(0xFFFF) * 65_536 + v * (k & 0xFFFF)).bitwiseAND(0xFFFFFFFF)

    def lane(seed: int, k: int) -> Column:
        return F.aggregate(units, F.lit(seed).cast("long"), lambda v, c: times(v.bitwiseXOR(c), k))

    def stirred(a: Column, b: Column) -> Column:
        return times(a.bitwiseXOR(F.shiftright(a, 16)), 2246822507).bitwiseXOR(times(b.bitwiseXOR(F.shiftright(b, 13)), 3266489909))

    codes = F.transform(F.split(text_of(x), ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda c: F.when(c < 0x10000, F.array(c)).otherwise(F.array(F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
    units = F.flatten(F.transform(F.filter(codes, lambda c: c > 0), pair))
    # fixed values: seeds and multipliers of the older format
    one, two = lane(0xDEADBEEF, 2654435761), lane(0x41C6CE57, 1597334677)
    low = stirred(one, two)
    high = stirred(two, low)
    return F.lower(F.conv((high.bitwiseAND(2097151) * 4294967296 + low).cast("string"), 10, 36))


def words_of(normed: Column) -> Column:
    return F.filter(F.split(normed, " "), lambda t: t != "")


def tokens(x: Column | str) -> Column:
    return words_of(norm(x))


def without(array: Column, words: list[str]) -> Column:
    """The elements that are none of the words, repeats kept."""
    return F.filter(array, lambda t: ~t.isin(words))


def content_tokens(x: Column | str) -> Column:
    return without(tokens(x), L.STOP_WORDS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set that is in the larger."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda refers to by its expression is made anew for every element."""
    return F.transform(F.array(value), body)[0]


def bigrams(normed: Column | str) -> Column:
    """Character pairs of a normalised text with a space at either end, repeats kept."""
    padded = F.concat(F.lit(" "), col(normed), F.lit(" "))
    return let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2))))


def counted(array: Column) -> Column:
    """Elements made distinct by their occurrence number: multiset operations become set operations."""
    return let(F.array_sort(array), lambda ordered: F.transform(ordered, lambda x, i: F.struct(x.alias("v"), (i - F.array_position(ordered, x)).alias("k"))))


def dice(a: Column | str, b: Column | str) -> Column:
    """Sørensen–Dice similarity of bigram multisets."""
    return dice_of(norm(a), norm(b))


def dice_of(a: Column | str, b: Column | str) -> Column:
    """dice() of texts that are normalised already."""
    na, nb = col(a), col(b)
    ga, gb = bigrams(na), bigrams(nb)
    share = 2.0 * F.size(F.array_intersect(counted(ga), counted(gb))) / (F.size(ga) + F.size(gb))
    return F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).otherwise(share)


def similar(ta: Column, tb: Column, threshold: float = 0.75) -> Column:
    """Whether two content-token arrays say nearly the same."""
    return (jaccard(ta, tb) >= threshold) | ((F.least(F.size(ta), F.size(tb)) >= 3) & (containment(ta, tb) >= 0.95))


def slug(x: Column | str) -> Column:
    short = F.substring(F.replace(norm(x), F.lit(" "), F.lit("-")), 1, 48)
    return F.when(short == "", "x").otherwise(short)


def clamp(x: Column | str, low: float, high: float) -> Column:
    """A number within bounds; what is no finite number counts as the low one (C11)."""
    number = col(x).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high)))).otherwise(F.lit(float(low)))


def cut_at_word(text: Column, most: int) -> Column:
    """At most so many characters, without the word that was cut."""
    return F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+\S*$", "")).otherwise(text)


def sanitize(x: Column | str, most: int = 200) -> Column:
    """No control characters, tags or macro braces; single spaces; capped at a word."""
    bare = F.regexp_replace(F.regexp_replace(text_of(x), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""), "<[^>]*>", "")
    return cut_at_word(collapse(F.replace(F.replace(bare, F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }"))), most)


def is_generic(x: Column | str) -> Column:
    return norm(x).isin(L.GENERIC_WORDS)


def sanitize_key(x: Column | str) -> Column:
    """A plain, specific key, or null."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text_of(x), r"\{\{.*?\}\}", ""), r"[\r\n]+", " "))
    bare = F.regexp_replace(flat, "(?U)^[/\"'\u201c\u201d\u2018\u2019\\s]+|[/\"'\u201c\u201d\u2018\u2019\\s]+$", "")
    usable = F.length(bare).between(2, 40) & ~is_generic(bare) & ~bare.rlike("^[0-9[^A-Za-z0-9_]]+$")
    return F.when(usable, bare)


# ---- lexicons

def has_words(x: Column | str, words: list[str]) -> Column:
    """Whether any of the words stands in the text as a whole word, in any case."""
    return text_of(x).rlike("(?i)" + NOT_IN_WORD[0] + L.whole_words(words) + NOT_IN_WORD[1])


def protagonist_words(names: list[str] | tuple[str, ...]) -> list[str]:
    """Escaped names and the ways to speak of the protagonist."""
    own = list(dict.fromkeys(n.strip() for n in names if n and n.strip()))
    return [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", n) for n in [*own, "protagonist", "the player"]]


def is_protagonist(x: Column | str, names: list[str] | tuple[str, ...]) -> Column:
    return norm(x).isin(["user", "you", "player", *map(plain.norm, names)])


def violates_agency(x: Column | str, names: list[str] | tuple[str, ...]) -> Column:
    """Whether a text asserts something about the protagonist's mind."""
    return has_words(x, protagonist_words(names)) & has_words(x, L.MENTAL)


def guard_status(x: Column | str, status: Column | str) -> Column:
    """Only `confirmed` is demoted, by what the wording says."""
    wording = F.when(has_words(x, L.FUTURE), "plan").when(has_words(x, L.CLAIM), "claim").when(has_words(x, L.HEDGE), "unresolved").otherwise("confirmed")
    return F.when(col(status) == "confirmed", wording).otherwise(col(status))


def evidence_holds(evidence: Column | str, cited: Column | str) -> Column:
    """Whether a quote stands in the cited text, give or take small edits."""
    ev, hay = norm(evidence), norm(cited)
    said, there = content_tokens(evidence), words_of(hay)
    # The cited words go along as state: inside a lambda they would be made anew for every word of the quote.
    begin = F.struct(there.alias("there"), F.lit(0).alias("n"))
    hits = F.aggregate(said, begin, lambda a, t: F.struct(a["there"].alias("there"), (a["n"] + F.array_contains(a["there"], t).cast("int")).alias("n")), lambda a: a["n"])
    return (F.length(ev) >= 6) & (F.contains(hay, ev) | ((F.size(said) >= 3) & (hits / F.greatest(F.size(said), F.lit(1)) >= 0.8)))


def family_of(kind: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in L.FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(kind)), F.lit("other"))


def compatible(a: Column | str, b: Column | str) -> Column:
    return (col(a) == "other") | (col(b) == "other") | (family_of(a) == family_of(b))


def core_tokens(x: Column | str) -> Column:
    """Name tokens without articles and honorifics, unless nothing else is there."""
    every = tokens(x)
    core = without(every, L.HONORIFICS)
    return F.when(F.size(core) > 0, core).otherwise(every)


def fact_id(entity: Column | str, text: Column | str) -> Column:
    """Twelve digits of a hash: long enough not to collide within an entity's view."""
    return F.concat(F.lit("F"), F.substring(F.md5(F.concat(col(entity), F.lit("|"), norm(text))), 1, 12))


def entry_comment(entity: Column | str, name: Column | str, kind: Column | str) -> Column:
    return F.concat(F.lit("DL:"), col(entity), F.lit(" | "), col(name), F.lit(" ["), col(kind), F.lit("]"))


def managed_id(comment: Column | str) -> Column:
    found = F.regexp_extract(text_of(comment), r"^DL:([^\s|]+)", 1)
    return F.when(found != "", found)


def trim_end(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"[.;,\s]+$", "")


def op_key(kind: Column | str, entity: Column | str, content: Column | str, keys: Column | str) -> Column:
    """Identifies a proposal; content and keys are null where nothing would be written."""
    after = F.md5(F.concat(col(content), F.lit("|"), F.array_join(col(keys), "|")))
    return F.md5(F.concat(col(kind), F.lit("|"), col(entity), F.lit("|"), F.coalesce(after, F.lit("x"))))


def html_escape(x: Column | str) -> Column:
    out = text_of(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def nonce() -> Column:
    """Six random bytes in hexadecimal."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def scrub(x: Column | str, mark: Column, most: int = 5000) -> Column:
    """No delimiter of ours in the text, and no more than so many characters."""
    return F.substring(F.replace(text_of(x), mark, F.lit("")), 1, most)


# ---- JSON

def tolerant_json(x: Column | str) -> Column:
    """A model's answer as VARIANT: fences and prose around it, trailing commas and bare arrays are forgiven (C17)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text_of(x)), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    listed = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    attempt = lambda c: F.try_parse_json(F.when(c != "", c))
    return F.coalesce(attempt(bare), attempt(inner), attempt(F.regexp_replace(inner, r",\s*([}\]])", "$1")), attempt(F.when(listed != "", F.concat(F.lit('{"entities":'), listed, F.lit("}")))))


def stable_json(*columns: Column | str) -> Column:
    """JSON with its members in order of name."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))

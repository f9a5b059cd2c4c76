"""The text rules in Python, for the operators that must go through rows in order."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from skein.functions import lexicon as L

STOP, GENERIC, HONORIFIC, DESCRIPTOR, RELATIONAL = map(frozenset, (L.STOP_WORDS, L.GENERIC_WORDS, L.HONORIFICS, L.DESCRIPTORS, L.RELATIONAL))


@lru_cache(maxsize=100_000)
def norm(text: str | None) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not "\u0300" <= c <= "\u036f").lower()
    kept = (c if c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in bare if c not in "\u2019'`")
    return " ".join("".join(kept).split())


def tokens(text: str | None) -> list[str]:
    return norm(text).split()


def content(text: str | None) -> list[str]:
    return [t for t in tokens(text) if t not in STOP]


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def containment(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def similar(a: list[str], b: list[str], threshold: float = 0.75) -> bool:
    return jaccard(a, b) >= threshold or (min(len(a), len(b)) >= 3 and containment(a, b) >= 0.95)


@lru_cache(maxsize=100_000)
def pairs(normed: str) -> dict[str, int]:
    """How often each pair of letters stands in a normalised text."""
    padded, out = f" {normed} ", {}
    for i in range(len(padded) - 1):
        out[padded[i : i + 2]] = out.get(padded[i : i + 2], 0) + 1
    return out


def dice(a: str, b: str) -> float:
    """Of two normalised texts."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = pairs(a), pairs(b)
    return 2 * sum(min(n, y.get(g, 0)) for g, n in x.items()) / (sum(x.values()) + sum(y.values()))


def slug(text: str) -> str:
    return norm(text).replace(" ", "-")[:48] or "x"


def family(kind: str) -> str:
    return L.FAMILIES.get(kind, "other")


def compatible(a: str, b: str) -> bool:
    return "other" in (a, b) or family(a) == family(b)


def core(name: str) -> list[str]:
    every = tokens(name)
    return [t for t in every if t not in HONORIFIC] or every


def fact_id(entity: str, text: str) -> str:
    return "F" + hashlib.md5(f"{entity}|{norm(text)}".encode()).hexdigest()[:12]


def pair_key(old: str, new: str) -> str:
    return hashlib.md5(f"{old}|{new}".encode()).hexdigest()


def trim_end(text: str) -> str:
    return re.sub(r"[.;,\s]+$", "", text)


def sanitize_key(key: str | None) -> str | None:
    flat = re.sub(r"[\r\n]+", " ", re.sub(r"\{\{.*?\}\}", "", key or "")).strip()
    edge = "[/\"'\u201c\u201d\u2018\u2019\\s]+"
    bare = re.sub(f"^{edge}|{edge}$", "", flat)
    plain = 2 <= len(bare) <= 40 and norm(bare) not in GENERIC and not re.fullmatch(r"(?:[0-9]|[^A-Za-z0-9_])+", bare)
    return bare if plain else None

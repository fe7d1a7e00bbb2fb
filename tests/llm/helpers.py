"""Small tables with awkward rows, and brute-force counterparts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, count: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(count)]


def documents(spark, texts, ids=None, sources=None, extra=()):
    """Rows of ``documents``; ``extra`` names more string columns, holding 'e'."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [
        (i, t, "en", s, None if t is None else len(t), *["e"] * len(extra))
        for i, t, s in zip(ids, texts, sources)
    ]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{name}` string" for name in extra))


def components(nodes, links):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


AWKWARD = [
    None,
    "",
    " \t\n ",
    "one",
    "One two",
    "ünï çödé 日本語 🎉 text",
    "a.b `c` \x00 nul",
    "long " * 60_000,
    "same same text here for you and me and all of them too",
    "same same text here for you and me and all of them too",
]

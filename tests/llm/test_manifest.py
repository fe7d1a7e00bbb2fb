import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helpers import AWKWARD, documents
from tablog.llm.manifest import Appender, climbed, merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """The root, and each node's siblings on the way."""
    ways = [[] for _ in nodes]
    level = [(d, [i]) for i, d in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), fanout):
            run = level[k : k + fanout]
            for j, (_, members) in enumerate(run):
                for m in members:
                    ways[m] += [d for n, (d, _) in enumerate(run) if n != j]
            above.append((h(*[d for d, _ in run]), [m for _, members in run for m in members]))
        level = above
    return level[0][0], ways


def brute(rows, fanout=3):
    """rows: dicts of the fields; per row id, leaf, subroot, root and proof."""
    by_source = {}
    for r in rows:
        leaf = h(*[shown(r[f]) for f in ("doc_id", "source", "lang", "n_chars", "text")])
        by_source.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf, r["doc_id"]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        by_source[name].sort()
        built[name] = tree([leaf for _, leaf, _ in by_source[name]], fanout)
    root, above = tree([built[n][0] for n in names], fanout) if names else ("", [])
    out = []
    for name, upper in zip(names, above):
        for (_, leaf, own), way in zip(by_source[name], built[name][1]):
            out.append((own, leaf, built[name][0], root, "".join(way + upper)))
    return sorted(out, key=repr)


def check(spark, docs, **options):
    got = merkle_manifest(docs, **options).collect()
    assert all(r.verified and r.folded == r.root for r in got)
    told = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex()) for r in got]
    rows = [r.asDict() for r in docs.collect()]
    assert sorted(told, key=repr) == brute(rows, options.get("fanout", 3))


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_appended_witnesses(fanout):
    for n in [1, 2, 3, 4, 8, 9, 10, 27, 28, 50]:
        nodes = [h(str(i)) for i in range(n)]
        appender = Appender(fanout)
        for d in nodes:
            appender.append(bytes.fromhex(d))
        root, ways = tree(nodes, fanout)
        assert appender.seal().hex() == root
        assert [w.hex() for w in appender.witness] == ["".join(w) for w in ways]
        for i, d in enumerate(nodes):
            assert climbed(bytes.fromhex(d), i, n, bytes(appender.witness[i]), fanout).hex() == root


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_blocks_of_any_size_make_the_same_tree(spark, levels):
    rng = random.Random(levels)
    texts = [f"text {rng.random()}\n" for _ in range(140)]
    sources = ["hot" if rng.random() < 0.5 else rng.choice(["a", "b", "ä", "𝔸", "ｚ", None, ""]) for _ in texts]
    docs = documents(spark, texts, ids=rng.sample(range(-100, 900), len(texts)), sources=sources)
    check(spark, docs.repartition(5), levels=levels)
    check(spark, docs, levels=levels, fanout=2)


def test_a_changed_row_does_not_verify(spark):
    texts = [None, "", "a\nb", "ab", "a\n\nb"]
    docs = documents(spark, texts, sources=["x", "x", "y", "y", None])
    got = merkle_manifest(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}).collect()
    assert {r.doc_id: r.verified for r in got} == {0: True, 1: True, 2: False, 3: True, 4: False}
    leaf = h(*[shown(v) for v in (2, "y", "en", 3, "ab")])
    row = next(r for r in got if r.doc_id == 2)
    other = next(r.leaf.hex() for r in got if r.doc_id == 3)
    trees = {r.doc_id: r.subroot.hex() for r in got}
    assert row.folded.hex() == h(trees[4], trees[0], h(leaf, other))


def test_awkward_rows_and_empty_tables(spark):
    docs = documents(spark, AWKWARD * 2, ids=[None, *range(17), 3, None], extra=["leaf", "at", "tree", "key", "place"])
    check(spark, docs)
    check(spark, documents(spark, ["one"]))
    assert merkle_manifest(documents(spark, [])).count() == 0

import random

from helpers import AWKWARD, documents, prose, words
from tablog.llm.substring import drop_repeated


def brute(rows, window):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def check(spark, rows, **options):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], extra=["spans", "kept", "id"])
    got = drop_repeated(docs.repartition(5), **options).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, options.get("window", 13))
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_removed
        assert all(a.start + a.words < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_passages_against_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (12, 13, 14, 40, 80)]
    rows = []
    for i in rng.sample(range(1000), 120):
        w = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            w[at:at] = rng.choice([p, p[cut:], p[:cut]])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(i + 2000, t) for i, t in rows[:30]]  # exact copies
    check(spark, rows)
    check(spark, rows, window=3, blocks=3)


def test_common_windows_of_few_words(spark):
    rng = random.Random(6)
    check(spark, [(i, " ".join(prose(rng, 50, vocabulary=3))) for i in range(40)], window=5, blocks=1)


def test_awkward_rows(spark):
    rows = list(enumerate(AWKWARD))
    check(spark, rows)
    same = " ".join(f"x{i}" for i in range(20))
    docs = documents(spark, [same, same, same, same], ids=[7, 7, None, None])
    got = sorted((r.doc_id or -1, r.n_removed) for r in drop_repeated(docs).collect())
    # Rows of one id don't repeat each other, nor do rows without one.
    assert got == [(-1, 20), (-1, 20), (7, 0), (7, 0)]
    assert drop_repeated(documents(spark, [])).count() == 0

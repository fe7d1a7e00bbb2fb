import random

import pytest

from helpers import AWKWARD, documents, prose
from tablog.llm.decontamination import find_contamination, window_shingles
from test_resampling import item_words


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        w = item_words(text)
        size = min(len(w), window)
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = item_words(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((i, len(w), len(hit), sorted(map(str, found - {None}))))
    return sorted(out, key=repr)


def check(spark, rows, items, window=10, **options):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], extra=["words", "at", "own", "hash"])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_contamination(docs.repartition(5), bench, window=window, **options).collect()
    told = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr)
    assert told == brute(rows, items, window)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_hit
        assert all(a.start + a.words < b.start for a, b in zip(r.spans, r.spans[1:]))


def planted(rng, items, count):
    rows = []
    for i in rng.sample(range(5000), count):
        w = prose(rng, rng.randrange(0, 150), 60)
        for _ in range(rng.randrange(3)):
            run = item_words(rng.choice(items)[1])
            cut = rng.randrange(len(run) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice([run, run[cut:], run[:cut]])
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w).capitalize()))
    return rows


@pytest.mark.parametrize("window, shingle", [(10, 5), (7, 3), (4, 4), (1, 1)])
def test_planted_passages_against_brute_force(spark, window, shingle):
    rng = random.Random(window)
    items = [(i, " ".join(prose(rng, n, 60))) for i, n in enumerate([12, 10, 9, 30, 4, 25, 70])]
    items += [(20, items[0][1]), (21, items[3][1] + " more words here")]  # shared windows
    rows = planted(rng, items, 80)
    rows += [(i + 9000, t) for i, t in rows[:20]]
    check(spark, rows, items, window=window, shingle=shingle)


def test_few_words_make_every_shingle_common(spark):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng, 14, 2))) for i in range(4)]
    check(spark, [(i, " ".join(prose(rng, 200, 2))) for i in range(30)], items)


def test_a_passage_in_most_rows_and_lookups_beyond_the_broadcast(spark):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, 30, 500))) for i in range(5)]
    rows = [(i, "start " * (i % 70) + items[0][1] + " end") for i in range(150)] + planted(rng, items, 30)
    spark.conf.set("spark.tablog.broadcastBytes", "100")
    try:
        check(spark, rows, items)
    finally:
        spark.conf.unset("spark.tablog.broadcastBytes")


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, "one"), (2, None), (3, ""), (None, "same same text here"), (5, "long " * 12), (5, "日本語 🎉")]
    rows = list(enumerate(AWKWARD)) + [(None, AWKWARD[-1]), (None, AWKWARD[-1]), (3, "one"), (3, "two")]
    check(spark, rows, items)
    check(spark, rows, [])
    check(spark, [], items)


def test_a_shingle_is_no_longer_than_the_window(spark):
    docs = documents(spark, ["a"])
    with pytest.raises(ValueError):
        find_contamination(docs, docs, window=4, shingle=5, item_column="doc_id")


def test_shingles_of_a_window(spark):
    rows = spark.createDataFrame([("a b c d", 4), ("e f", 2)], "window string, size int")
    got = sorted(tuple(r) for r in window_shingles(rows, 3).collect())
    assert got == [("a b c d", 4, 3, 0, "a b c"), ("a b c d", 4, 3, 1, "b c d"), ("e f", 2, 2, 0, "e f")]

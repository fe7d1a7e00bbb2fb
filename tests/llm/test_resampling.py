import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from helpers import AWKWARD, documents, lower_ascii, prose
from tablog.llm.resampling import Runs, importance_scores, resample, running_crcs, shifted

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(lower_ascii(text or ""))


def features(text, longest):
    w = item_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest, buckets, percent, min_words, seed):
    def counts(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, longest))

    here, there = counts(t for _, t in rows), counts(target)
    all_here, all_there = here.total(), there.total()

    def gain(b):
        return math.floor(
            1000 * math.log(((there[b] + 1) * (all_there * 0 + all_here + buckets)) / ((here[b] + 1) * (all_there + buckets)))
        )

    out = []
    for i, t in rows:
        found = features(t, longest)
        weight = sum(gain(crc32(f.encode()) % buckets) for f in found)
        drawn = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        luck = math.floor(-1000 * math.log(-math.log((int(drawn[:8], 16) + 0.5) / 4294967296)))
        out.append([i, len(found), weight, weight + luck, None, len(item_words(t))])
    long = [r for r in out if r[5] >= min_words]
    long.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for place, r in enumerate(long[: len(long) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def check(spark, rows, target, longest=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], extra=["id", "hash", "weight", "rank"])
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance_scores(docs.repartition(3), wanted, longest, buckets, percent, min_words, seed).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, target, longest, buckets, percent, min_words, seed)


@pytest.mark.parametrize("length", [1, 2, 5])
def test_crcs_of_runs_come_from_two_prefixes(length):
    texts = ["", "One", "a-b c  d\x00e ünï x9 日本語 end", "w " * 300, "x" * 5000 + " y"]
    scans = [running_crcs(t.encode()) for t in texts]
    runs = Runs([c.tobytes() for c, _ in scans], [s.tobytes() for _, s in scans])
    expected = []
    for t in texts:
        w = item_words(t)
        expected += [crc32(" ".join(w[i : i + length]).encode()) % 99_991 for i in range(len(w) - length + 1)]
    assert runs.buckets(length, 99_991)[0].tolist() == expected


def test_shift_by_many_bytes():
    sizes = np.array([0, 1, 7, 255, 70_000])
    crcs = np.array([crc32(b"start")] * 5, np.uint32)
    for size, got in zip(sizes, shifted(crcs, sizes)):
        assert int(got) ^ crc32(b"\0" * int(size)) == crc32(b"start" + b"\0" * int(size))


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "percent": 60, "min_words": 5, "seed": 1}])
def test_scores_and_ranks_against_brute_force(spark, options):
    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, rng.randrange(0, 60), 80))) for i in rng.sample(range(900), 90)]
    rows += [(i + 1000, t) for i, t in rows[:20]]
    target = [" ".join(prose(rng, 30, 20)) for _ in range(10)] + [None, ""]
    check(spark, rows, target, **options)


def test_awkward_rows_and_empty_tables(spark):
    check(spark, list(enumerate(AWKWARD)), AWKWARD, min_words=1, percent=50)
    check(spark, list(enumerate(AWKWARD)), [], min_words=1, percent=100)
    check(spark, [], ["a b"])
    same = " ".join(f"x{i}" for i in range(30))
    check(spark, [(None, same), (None, same), (4, same), (4, same), (4, same + " y")], [same], percent=60)


def test_drawn_rows_keep_their_columns(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 25)) for _ in range(40)] + [None]
    docs = documents(spark, texts, extra=["rank", "a.b"])
    target = documents(spark, texts[:3])
    drawn = resample(docs, target, percent=25)
    assert drawn.columns == docs.columns
    best = {r.doc_id for r in importance_scores(docs, target, percent=25).where("rank is not null").collect()}
    assert len(best) == 10
    assert {r.doc_id for r in drawn.collect()} == best

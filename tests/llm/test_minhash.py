import random

import numpy as np
from helpers import AWKWARD, components, documents, lower_ascii, prose, words
from tablog.llm.links import components as spark_components
from tablog.llm.links import link_groups, shared_buckets
from tablog.llm.minhash import drop_near, near_groups, odd_sketches, sketches


def shingles(text):
    w = words(lower_ascii(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    group = components(ids, links)
    return sorted((i, len(sets[i]), group[i], group[i] == i) for i in ids)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def check(spark, rows):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], extra=["component_id", "n", "bands", "_gone"])
    got = near_groups(docs.repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert sorted(r.doc_id for r in drop_near(docs).collect()) == [i for i, _, g, k in brute(rows) if k]


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    rows, ids = [], rng.sample(range(10**6), 400)
    base = [prose(rng, n, 10**6) for n in (3, 5, 6, 9, 30, 60, 200)]
    for i in ids:
        w = rng.choice(base)
        w = edited(rng, w, rng.randrange(0, 1 + len(w) // 15))
        rows.append((i, rng.choice([str.upper, str])(" ".join(w))))
    check(spark, rows)


def test_chain_of_a_large_group(spark):
    """Neighbours in the chain are similar, its ends are not."""
    rng = random.Random(9)
    w, rows = prose(rng, 120, 10**6), []
    for i in range(150):
        rows.append((i * 7 % 151, " ".join(w)))
        w = edited(rng, w, 1)
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, list(enumerate(AWKWARD)))
    docs = documents(spark, ["a b c", "a b c", "a b c", "d"], ids=[None, 3, 2, None])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_groups(docs).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (3, 2, False)]
    assert near_groups(documents(spark, [])).count() == 0


def test_rows_of_one_id_go_by_their_texts(spark):
    docs = documents(spark, ["p q r", "x y z", "p q r", "x y z"], ids=[1, 5, 5, 9])
    got = sorted((r.doc_id, r.component_id) for r in near_groups(docs).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (9, 5)]


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 60, dtype=np.uint64)
    own = [rng.integers(0, 2**63, 20, dtype=np.uint64) for _ in range(2)]
    a, b = sketches([np.unique(np.concatenate([shared, o])) * np.uint64(2) for o in own], 128)
    assert abs((a == b).mean() - 0.6) < 0.15


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 500, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, size)) for size in (1, 5, 100, 300, 450)] + [np.empty(0, np.uint64)]
    odd = odd_sketches(sets, 256)
    for a, s in zip(odd, sets):
        for b, t in zip(odd, sets):
            differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b)
            assert differ <= len(np.setxor1d(s, t)) and (differ - len(np.setxor1d(s, t))) % 2 == 0


def test_components_of_long_paths(spark):
    rng = random.Random(10)
    order = rng.sample(range(300), 300)
    links = [(a, b) for a, b in zip(order[:150], order[1:150])] + [(order[200], order[k]) for k in range(201, 260)]
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in spark_components(edges).collect()}
    want = components({n for link in links for n in link}, links)
    assert got == want


def test_links_that_stars_alone_would_miss(spark):
    """In one bucket, items link when they differ by 10: no star finds the other classes."""
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(55, 90, 5)]
    members = shared_buckets(spark.createDataFrame(rows, "bucket bigint, item bigint"))
    traits = members.select("item").distinct()
    found = link_groups(members, traits, lambda x, y: x("item") != y("item"), lambda p: p.where("abs(a - b) = 10"))
    got = {r.node: r.component for r in found.collect()}
    pairs = [(a, b) for x in (1, 2) for k, a in rows if k == x for l, b in rows if l == x and b - a == 10]
    want = components({n for p in pairs for n in p}, pairs)
    assert {n: c for n, c in got.items() if n in want} == want


def test_pairs_that_share_many_buckets_are_made_once(spark):
    rng = random.Random(5)
    kinds = [[rng.random() < 0.7 for _ in range(6)] for _ in range(40)]
    rows = [(k, i) for i, own in enumerate(kinds) for k, has in enumerate(own) if has]
    members = shared_buckets(spark.createDataFrame(rows, "bucket bigint, item bigint")).cache()
    traits = spark.range(40).withColumnRenamed("id", "item")
    linked = {(a, a + 20) for a in range(0, 20, 3)}
    made = []

    def confirm(pairs):
        made.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("b = a + 20 and a % 3 = 0")

    found = link_groups(members, traits, lambda x, y: x("item") != y("item"), confirm)
    got = {r.node: r.component for r in found.collect() if r.node != r.component}
    meet = {(a, b) for a in range(40) for b in range(a + 1, 40) if any(x and y for x, y in zip(kinds[a], kinds[b]))}
    assert len(made) == len(set(made))
    assert linked & meet <= set(made) <= meet
    assert got == {b: a for a, b in linked & meet}
    members.unpersist()


def tasks_of(spark, group, run):
    """The tasks of all stages of what ``run`` does."""
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {i for job in jobs for i in job.stageIds}
    return out, sum(info.numCompletedTasks for i in stages if (info := tracker.getStageInfo(i)))


def test_links_of_small_tables_take_fewer_tasks_than_their_shuffles_would(spark):
    rows = [(bucket, item) for item in range(300) for bucket in {item // 3, 100 + item % 7, 200 + item // 20}]
    members = shared_buckets(spark.createDataFrame(rows, "bucket bigint, item bigint")).coalesce(1).localCheckpoint()
    traits = spark.range(300).withColumnRenamed("id", "item").coalesce(1).localCheckpoint()

    def groups():
        pairs = link_groups(members, traits, lambda x, y: x("item") != y("item"), lambda p: p.where("a div 3 = b div 3"))
        return {r.node: r.component for r in pairs.collect()}

    found, tasks = tasks_of(spark, "links", groups)
    assert found == {i: i // 3 * 3 for i in range(300)}
    assert tasks < 3000, tasks

import random

import pytest
from helpers import AWKWARD, documents, prose, words
from tablog.llm.mixing import mix, mixed_rows


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Excess over the limits is shared again by weight until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in rest}
        done |= {s: most * sizes[s] for s in over}


def test_targets_epochs_and_cut(spark):
    rng = random.Random(3)
    texts = [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(600)]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "ä", "Z", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    rows = mix(docs).collect()
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {}
    for text, source in zip(texts, sources):
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 30


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, "x y"], ids=[*range(9), 8, None], extra=["size", "_source", "key", "_row", "_given"])
    rows = mix(docs).collect()
    assert len(rows) == 11
    assert {r.doc_id: r.size for r in rows}[0] == 0
    copies = mixed_rows(docs)
    assert copies.columns == docs.columns


def test_no_words_and_empty_table(spark):
    assert [r.taken for r in mix(documents(spark, ["", None])).collect()] == [0, 0]
    assert mix(documents(spark, [])).count() == 0

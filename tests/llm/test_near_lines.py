import random

from helpers import AWKWARD, components, documents
from pyspark.sql import functions as F
from tablog.llm.near_lines import (
    BLOCK_BITS,
    BLOCKS,
    HASHES,
    ITEM_BYTES,
    block_keys,
    drop_near_lines,
    least_edits,
    letter_counts,
    line_keys,
    wanted_texts,
    with_slots,
)
from tablog.plans.durable import broadcast_limit, row_bytes
from test_lines import distance, norm

LETTERS = "etaoinshrdlu"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 10)))


def sentence(rng, count):
    return " ".join(word(rng) for _ in range(count))


def changed(rng, text, edits):
    """The text after so many changes of one letter each."""
    for _ in range(edits):
        at, new = rng.randrange(len(text) + 1), rng.choice(LETTERS)
        text = text[:at] + rng.choice([new + text[at:], new + text[at + 1 :], text[at + 1 :]])
    return text


def similar(a, b):
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) * 10 <= longest and distance(a, b) * 10 <= longest


def whole(line):
    """What a line is compared by, or None if it always stays."""
    return norm(line) or line.strip() or None


def linked(a, b):
    """Lines without letters are compared as they are, and only for being equal."""
    return bool(norm(a) and norm(b)) and similar(a, b)


def keys_of(spark, texts):
    """The buckets of each text, by its place in the list."""
    table = spark.createDataFrame(list(enumerate(texts)), "item bigint, norm string")
    found = {i: set() for i in range(len(texts))}
    for r in line_keys(table).collect():
        found[r.item] |= set(r["keys"])
    return [found[i] for i in range(len(texts))]


def brute(spark, rows):
    """Rows are (id, text) with unique ids; all pairs that share a bucket and are similar are linked."""
    lines = [(i, at, whole(line)) for i, text in rows for at, line in enumerate((text or "").split("\n"))]
    texts = sorted({n for _, _, n in lines if n is not None})
    keys = dict(zip(texts, keys_of(spark, texts)))
    links = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if keys[a] & keys[b] and linked(a, b)]
    group = components(texts, links)
    seen, gone = set(), {}
    for i, at, n in sorted(lines, key=lambda x: x[:2]):
        if n is not None:
            if group[n] in seen:
                gone.setdefault(i, set()).add(at)
            seen.add(group[n])
    return sorted(
        (i, "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone.get(i, ())), len(gone.get(i, ())))
        for i, t in rows
    )


def check(spark, rows):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], extra=["n_lines", "_id", "_row", "item", "at"])
    got = drop_near_lines(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.kept_text, r.n_removed) for r in got) == brute(spark, rows)


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(41)
    base = [sentence(rng, n) for n in (3, 3, 4, 4, 5, 6, 9, 14, 22, 35, 60)]

    def line():
        text = rng.choice(base) if rng.random() < 0.6 else sentence(rng, rng.randrange(0, 25))
        return rng.choice([str.upper, str])(changed(rng, text, rng.choice([0, 1, 1, 2, len(text) // 20])))

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in rng.sample(range(999), 60)]
    check(spark, rows)


def test_lines_of_few_words_without_spaces_or_letters(spark):
    chinese = "他们在河边的小镇上住了许多年，从来没有想过要离开那里去别的地方生活"
    texts = ["Ietzte.\n\n--- 42 ---\nOne", " ietzte\n\n--- 43 ---\nTwo", f"--- 42 --- \n{chinese}\n \t", f"\n{chinese}吗\none"]
    check(spark, list(enumerate(texts)))
    got = sorted((r.doc_id, r.n_removed) for r in drop_near_lines(documents(spark, texts)).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_awkward_rows(spark):
    check(spark, [x for x in enumerate(AWKWARD) if len(x[1] or "") < 1000])
    docs = documents(spark, ["one two three"] * 4, ids=[3, 3, None, 9])
    got = sorted((r.doc_id or -1, r.n_removed) for r in drop_near_lines(docs).collect())
    assert got == [(-1, 1), (3, 0), (3, 0), (9, 1)]
    assert drop_near_lines(documents(spark, ["long " * 60_000])).first().n_removed == 0
    assert drop_near_lines(documents(spark, [])).count() == 0


def met(spark, pairs):
    keys = keys_of(spark, [text for pair in pairs for text in pair])
    return sum(bool(a & b) for a, b in zip(keys[::2], keys[1::2]))


def test_short_similar_lines_always_meet(spark):
    rng, pairs = random.Random(42), []
    while len(pairs) < 3000:
        a = " ".join(sentence(rng, 6)[: rng.randrange(9, 30)].split())
        b = " ".join(changed(rng, a, rng.randrange(1, 3)).split())
        if max(len(a), len(b)) < 30 and similar(a, b):
            pairs.append((a, b))
    assert met(spark, pairs) == len(pairs)


def test_one_changed_word_or_letter_does_not_part_lines(spark):
    rng, pairs = random.Random(43), []
    for count in [5, 8, 15, 27, 60, 150, 400] * 40:
        words = sentence(rng, count).split()
        at = rng.randrange(count)
        for new in (words[at] + "a", word(rng)):
            other = [*words[:at], new, *words[at + 1 :]]
            if similar(" ".join(words), " ".join(other)) if count < 60 else True:
                pairs.append((" ".join(words), " ".join(other)))
    assert met(spark, pairs) == len(pairs)


# Of lines of so many words, the share that meets one with so many letters changed
# anywhere in it, in a hundred, at least.
MET = {
    (8, 1): 90, (8, 2): 40, (16, 2): 80, (27, 2): 95, (55, 2): 95, (120, 2): 95,
    (16, 4): 55, (27, 4): 70, (55, 4): 70, (120, 4): 70,
}


def test_share_of_similar_lines_that_meet(spark):
    rng, pairs = random.Random(45), {}
    for count, edits in MET:
        pairs[count, edits] = []
        while len(pairs[count, edits]) < 100:
            a = sentence(rng, count)
            b = " ".join(changed(rng, a, edits).split())
            if similar(a, b):
                pairs[count, edits].append((a, b))
    shares = {k: met(spark, p) for k, p in pairs.items()}
    assert all(shares[k] >= least for k, least in MET.items()), shares


def test_a_shared_block_where_fewer_bits_differ_than_there_are_blocks(spark):
    rng, rows = random.Random(46), []
    for _ in range(200):
        a = [rng.getrandbits(64) for _ in range(HASHES)]
        b = list(a)
        for bit in rng.sample(range(BLOCKS * BLOCK_BITS), BLOCKS - 1):
            b[bit // 64] ^= 1 << bit % 64
        rows.append(tuple(x - 2**63 for x in (*a, *b)))
    names = [f"{side}{i} bigint" for side in "ab" for i in range(HASHES)]
    table = spark.createDataFrame(rows, ", ".join(names))
    keys = [block_keys([F.col(f"{side}{i}") for i in range(HASHES)]) for side in "ab"]
    assert table.where(F.arrays_overlap(*keys)).count() == 200


def test_all_words_of_a_long_line_count(spark):
    letters = [chr(97 + i) for i in range(26)]
    words = [a + b + c + d for a in "xy" for b in letters for c in letters for d in letters][:20_000]
    counts = [63, 64, 16_383, 16_384, 20_000]
    keys = keys_of(spark, [" ".join(words[:n] + words[:9]) for n in counts])
    hashes = F.array(*[F.xxhash64(F.lit(i), F.col("w")) for i in range(HASHES)])
    hashed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("w")).select(hashes).collect()
    rows = []
    for n in counts:
        bits = [sum(1 << k for k in range(64) if sum(r[0][i] >> k & 1 for r in hashed[:n]) > n // 2) for i in range(HASHES)]
        rows.append((n, *[x - (x >> 63 << 64) for x in bits]))
    table = spark.createDataFrame(rows, ["n"] + [f"b{i}" for i in range(HASHES)]).coalesce(1)
    blocks = table.select("n", block_keys([F.col(f"b{i}") for i in range(HASHES)]).alias("keys")).collect()
    assert [n for (n, own), met in zip(sorted(blocks), keys) if not set(own) <= met] == []


def test_no_broadcast_beyond_the_limit_and_the_same_lines_go(spark):
    rng = random.Random(49)
    base = [sentence(rng, 9) for _ in range(30)]
    texts = ["\n".join(changed(rng, rng.choice(base), k % 2) for _ in range(3)) for k in range(30)]
    docs = documents(spark, texts)

    def rows():
        return sorted((r.doc_id, r.kept_text, r.n_removed) for r in drop_near_lines(docs).collect())

    all_at_once = rows()
    spark.conf.set("spark.tablog.broadcastBytes", str(10 * ITEM_BYTES))
    try:
        assert rows() == all_at_once and sum(r[2] for r in all_at_once) > 30
        items = [(i, f"t{i}") for i in range(200)]
        lines = with_slots(spark.createDataFrame(items, "item bigint, norm string"))
        parts = wanted_texts(lines, lines.where("item % 4 < 3").select("item"), 150)
        assert len(parts) == 4
        assert sorted(r.item for p in parts for r in p.collect()) == [i for i in range(200) if i % 4 < 3]
    finally:
        spark.conf.unset("spark.tablog.broadcastBytes")


def test_a_broadcast_is_measured_by_the_drivers_heap(spark):
    heap = spark._jvm.Runtime.getRuntime().maxMemory()
    assert broadcast_limit(spark) == min(256 << 20, heap // 32)
    lead = spark.range(1000).select("id", F.struct("id", F.lit(1).alias("a"), F.lit(2).alias("b")).alias("lead"))
    assert lead.agg(F.sum(row_bytes(lead))).first()[0] >= 1000 * (16 + 8 + 3 * 8)


def test_very_long_lines(spark):
    rng = random.Random(47)
    long = " ".join(word(rng) + str(i) for i in range(20)) + " " + " ".join(word(rng) for _ in range(20_000))
    texts = [long, long[:70_000] + "zz" + long[70_002:], " ".join(word(rng) for _ in range(20_000)), "other"]
    got = sorted((r.doc_id, r.n_removed) for r in drop_near_lines(documents(spark, texts)).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_letter_counts_rule_out_no_similar_lines(spark):
    rng, rows = random.Random(44), []
    for _ in range(300):
        a = sentence(rng, rng.randrange(1, 12))
        b = changed(rng, a, rng.randrange(8)) if rng.random() < 0.7 else sentence(rng, rng.randrange(1, 12))
        rows.append((a, b, distance(a, b)))
    table = spark.createDataFrame(rows, "a string, b string, d int")
    table = table.select("a", "b", "d", F.struct(*letter_counts(F.col("a"))).alias("x"), F.struct(*letter_counts(F.col("b"))).alias("y"))
    least = least_edits(lambda n: F.col(f"x.{n}"), lambda n: F.col(f"y.{n}"))
    got = table.select("d", least.alias("least")).collect()
    assert all(r.least <= r.d for r in got)
    assert sum(r.least * 10 > 8 * r.d for r in got) > 100

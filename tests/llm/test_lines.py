import random
import re

from pyspark.sql import functions as F
from tablog.llm.lines import LANE, MOST_WORDS, PIECE, aligned_edits, edit_similar, lane_counts, majority, normal_line


def normal(line):
    return re.sub(r"[^\W\d_]+|.", lambda m: m.group() if m.group()[0].isalpha() else " ", line.lower(), flags=re.S)


def norm(line):
    return " ".join(normal(line).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_majority_of_the_bits(spark):
    rng = random.Random(13)
    rows = [(k, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for k, n in enumerate([1, 2, 3, 7, 300, MOST_WORDS])]
    table = spark.createDataFrame(rows, "k int, h array<bigint>").select("k", F.size("h").alias("n"), F.explode("h").alias("h"))
    sums = [F.sum(c).alias(f"c{i}") for i, c in enumerate(lane_counts(F.col("h"), LANE))]
    bits = majority([F.col(f"c{i}") for i in range(LANE)], F.col("n")).alias("bits")
    for r in table.groupBy("k", "n").agg(*sums).select("k", bits).collect():
        hashes = dict(rows)[r.k]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
        assert r.bits & (2**64 - 1) == want


def test_edit_similarity_by_length_class(spark):
    pairs = [("a" * n + "b" * k, "a" * n + "c" * k) for n, k in ((9, 1), (8, 2), (90, 10), (89, 11), (900, 100), (899, 101))]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in table.select(edit_similar(F.col("a"), F.col("b"), 0.9)).collect()]
    assert got == [True, False, True, False, True, False]


def test_long_lines_are_compared_in_pieces(spark):
    rng = random.Random(15)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * PIECE + 100))
    few, many = list(long), list(long)
    for at in rng.sample(range(len(long)), len(long) // 12):
        few[at] = "x"
    for at in rng.sample(range(len(long)), len(long) // 8):
        many[at] = "x"
    pairs = [(long, "".join(few)), (long, "".join(many)), (long, long[5:]), (long, long + "y" * 300), (long, long * 2)]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in table.select(edit_similar(F.col("a"), F.col("b"), 0.9)).collect()]
    # Letters that come in only count where they are, up to the end of their piece.
    assert got == [True, False, True, True, False]


def test_long_lines_are_as_similar_as_when_compared_whole(spark):
    rng = random.Random(16)
    pairs = []
    for size in (300, PIECE - 1, PIECE, PIECE + 1, 2 * PIECE):
        long = "".join(rng.choice("abcdefgh ") for _ in range(size))
        tenth = size // 10
        pairs += [(long, "y" * tenth + long), (long, long + "y" * (tenth + tenth // 20))]
        pairs += [(long, long[:99] + "y" * tenth + long[99:]), (long, long[tenth // 2 :] + "y" * (tenth // 2))]
        pairs += [(long, long[tenth:] + long[:tenth]), (long, long[::-1])]
        # Words of three letters come in all over the line, a few more or fewer than a tenth.
        for count in (tenth // 3 - 9, tenth // 3 + 9):
            cuts = sorted(rng.sample(range(size), count))
            parts = [long[a:b] for a, b in zip([0, *cuts], [*cuts, size])]
            pairs.append((long[: -3 * count], "xyz".join(parts)[: size - 3 * count]))
    table = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "a string, b string").repartition(4)
    longest = F.greatest(F.length("a"), F.length("b"))
    apart, way = F.levenshtein("a", "b"), aligned_edits(F.col("a"), F.col("b"), longest)
    got = table.select(edit_similar(F.col("a"), F.col("b"), 0.9).alias("similar"), apart.alias("apart"), way.alias("way"), longest.alias("n")).collect()
    assert all(r.similar == (r.apart * 10 <= r.n) for r in got)
    assert all(r.way >= r.apart for r in got)
    assert {r.similar for r in got if r.n > PIECE} == {True, False}


def test_normal_line(spark):
    table = spark.createDataFrame([("  Hello, WORLD 42 -- Ünï\t",)], "a string")
    assert table.select(normal_line(F.col("a"))).first()[0] == "hello world ünï"

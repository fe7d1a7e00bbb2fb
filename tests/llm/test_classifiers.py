import math
import random
import re
import string
import zlib

import pytest
from helpers import AWKWARD, documents, prose
from pyspark.sql import functions as F
from tablog.llm import words as words_module
from tablog.llm.columns import held_out
from tablog.llm.quality import RuleModel, fit_rules, measured, score_quality
from tablog.llm.toxicity import STEMS, fit_sentences, score_toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_rows(spark):
    got = {r.id: r.out for r in spark.range(500).select("id", held_out(F.col("id")).alias("out")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(20)
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randrange(5, 120), 2000)
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = rng.choice([[x.upper() + "!!" for x in w], [x + "%%%" for x in w], w[:1] * len(w)])
        elif toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "stumpfig", "Vile,"])
        texts.append(". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) + ".")
        labels.append((i, 0 if bad else 1, int(toxic and not bad)))
    docs = documents(spark, texts).cache()
    return docs, spark.createDataFrame(labels, LABELS).cache(), labels


def accuracy(scored, labels, at):
    want = {row[0]: row[at] for row in labels}
    rows = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(r.predicted == want[r.doc_id] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark, labelled):
    docs, table, labels = labelled
    model = fit_rules(docs, table)
    assert 0 < len(model.rules) < 200
    assert accuracy(score_quality(docs, model), labels, 1) > 0.95


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, table, _ = labelled
    flipped = table.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit_rules(docs, table) == fit_rules(docs, flipped)


def test_rules_as_columns(spark):
    model = RuleModel(((("n_words", ">", 2.0), ("upper_share", "<=", 0.5)),), (2.0,), -1.0)
    docs = documents(spark, ["one two three", "one", "ONE TWO THREE"])
    rows = docs.withColumn("s", measured("text")).select("doc_id", model.score("s").alias("score")).collect()
    assert [round(r.score, 3) for r in sorted(rows)] == [0.731, 0.269, 0.269]


def test_quality_of_awkward_rows(spark, labelled):
    _, table, _ = labelled
    docs = documents(spark, AWKWARD, ids=[*range(8), 7, None], extra=["score", "predicted", "n_words", "_of", "_label"])
    model = fit_rules(docs, table)
    rows = score_quality(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    none = fit_rules(docs, table.limit(0))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(documents(spark, []), model).count() == 0


def test_toxicity_on_held_out_rows_and_sentences(spark, labelled):
    docs, table, labels = labelled
    scored = score_toxicity(docs, fit_sentences(docs, table)).cache()
    assert accuracy(scored, labels, 2) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [(r.doc_id, s) for r in scored.collect() for s in r.sentences]
    assert found
    for i, s in found:
        part = texts[i][s.start : s.end].lower()
        assert ("vile" in part or "stumpfig" in part) and ". " not in part


def test_toxicity_of_awkward_rows(spark, labelled):
    docs, table, _ = labelled
    model = fit_sentences(docs, table)
    awkward = documents(spark, [*AWKWARD, "ünï 🎉. Vile vile!"], ids=[*range(9), 8, None], extra=["label", "sentences"])
    rows = {r.doc_id: r for r in score_toxicity(awkward, model).collect()}
    assert len(rows) == 10 and rows[0].score == rows[1].score == rows[2].score == 0
    (s,) = rows[None].sentences
    assert (s.start, s.end) == (7, 16) and rows[None].predicted == 1
    nothing = fit_sentences(docs, table.limit(0))
    assert max(r.score for r in score_toxicity(awkward, nothing).collect()) < 0.001
    nulls = table.select("doc_id", "quality", F.lit(None).cast("int").alias("toxic"))
    assert len(fit_sentences(docs, nulls).features) == 0
    assert score_toxicity(documents(spark, []), model).count() == 0


def plain_statistics(text):
    """The statistics of a text, letter by letter."""
    words = re.split(r"[\x20\x09-\x0D]+", text)

    def share(letters):
        return sum(c in letters for c in text) / len(text) if text else 0.0

    return {
        "n_words": float(len(words)),
        "word_length": len(text) / len(words),
        "distinct_share": len(set(words)) / len(words),
        "upper_share": share(string.ascii_uppercase),
        "digit_share": share(string.digits),
        "stop_share": share(".,;:?"),
        "shout_share": share("!"),
        "symbol_share": share("#$%&*|~^<>{}[]\\_=+@/"),
        "line_share": share("\n"),
    }


def mixed_texts():
    rng = random.Random(21)
    texts = [t for t in AWKWARD if t is not None]
    for _ in range(60):
        letters = rng.choice(["abcXYZ 12.,!", "aA \n\t#[]{}\\_/", "üñ日🎉 a"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(200))))
    return texts


def test_scores_are_the_sum_of_the_rules_that_hold(spark, labelled):
    docs, table, _ = labelled
    model = fit_rules(docs, table)
    texts = mixed_texts() + [r.text for r in docs.limit(80).collect()]
    rows = documents(spark, texts).withColumn("s", measured("text"))
    scored = {r.doc_id: r.score for r in score_quality(documents(spark, texts), model).collect()}
    for r in rows.collect():
        stats = plain_statistics(texts[r.doc_id])
        assert r.s.asDict() == pytest.approx(stats, abs=1e-12)
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            if all(stats[n] <= t if relation == "<=" else stats[n] > t for n, relation, t in rule):
                total += weight
        assert scored[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def plain_hash(word):
    """The hash of a word's bytes: a polynomial, then mixed."""
    h = sum((b + 1) * pow(words_module._BASE, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    for odd in (words_module._ODD, words_module._ODD2):
        h = (h ^ h >> 33) * int(odd) % (1 << 64)
    return h ^ h >> 33


def test_scores_are_the_noisy_or_of_sentences(spark, labelled):
    docs, table, _ = labelled
    model = fit_sentences(docs, table)
    weight = {int(f): w for f, w in zip(model.features, model.weights)}
    texts = mixed_texts() + [r.text for r in docs.limit(80).collect()] + ["Vile! vile thing? Vileness.\nfine"]
    scored = {r.doc_id: r for r in score_toxicity(documents(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        clean, offending = 1.0, 0
        for sentence in re.split(rb"[.!?\n]", text.encode()):
            found = re.findall(rb"[A-Za-z\x80-\xff]+", sentence)
            if not found:
                continue
            # bytes.lower changes A to Z only
            features = {plain_hash(w.lower()[:k]) for w in found for k in (*STEMS, None)}
            p = 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in features)))
            clean *= 1 - p
            offending += p >= 0.5
        assert scored[i].score == pytest.approx(1 - clean, abs=1e-9)
        assert len(scored[i].sentences) == offending

"""Toxicity by multiple-instance learning: sentences scored, documents labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.llm.labels import training_rows
from tablog.llm.words import LOWER, Words, text_chunks
from tablog.plans.durable import durable

# Word beginnings of so many bytes are features beside whole words.
STEMS = [4, 5, 6, 7, 8]
# Features learned about, and documents of the sample one must be in.
VOCABULARY = 2000
LEAST_DOCS = 4
STEPS = 300
SAMPLE = 10_000

# A word is a run of ASCII letters and of bytes from 0x80 on; a sentence ends at . ! ? or a line end.
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


@dataclass(frozen=True)
class SentenceModel:
    """Weights of features, by ascending hash, and the log-odds of a sentence without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(texts: list[bytes]) -> tuple[Words, np.ndarray, list[np.ndarray]]:
    """Words, the sentence (numbered over all texts) of each, and their features' hashes."""
    words = Words(texts, _NOT_WORD)
    stops = np.flatnonzero(_STOP[words.data])
    # The end of a text ends its last sentence.
    stops = np.union1d(stops, words.text_start[1:] - 1)
    return words, np.searchsorted(stops, words.start), words.prefix_hashes([*STEMS, None], LOWER)


def _hits(
    known: np.ndarray, sentence: np.ndarray, hashes: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Sentences and places of known features, each once in a sentence."""
    found = []
    for hashed in hashes:
        place = np.minimum(np.searchsorted(known, hashed), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[place] == hashed) if len(known) else np.empty(0, np.int64)
        found.append(sentence[hit].astype(np.int64) * len(known) + place[hit])
    once = np.unique(np.concatenate(found))
    return once // max(len(known), 1), once % max(len(known), 1)


def fit_sentences(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
    vocabulary: int = VOCABULARY,
) -> SentenceModel:
    """Learn sentence scores from document labels.

    At most ``sample`` labelled documents that aren't held out are used.  The
    features (words and their beginnings) that tell the labels apart best by
    document counts, at most ``vocabulary``, are found by a Spark aggregation;
    then the likelihood of the labels under noisy-or of the sentences' logistic
    scores is climbed by gradient steps over those features alone.  Without
    labels of both kinds there are no features and scores are near 0.
    """
    rows = training_rows(docs.select(named(id_column), named(text_column)), labels, label, id_column, sample)
    rows = durable(rows.select("_label", whole_text(text_column).alias("_text")).coalesce(8))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                words, _, hashes = _sentences(texts)
                all_of = np.stack(hashes, 1).view(np.int64)
                lists = [np.unique(all_of[x:y]) for x, y in zip(words.first[:-1], words.first[1:])]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                values = pa.array(np.concatenate(lists))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends), values)],
                    ["label", "features"],
                )

    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    count, ones = totals[0], totals[1]
    nothing = SentenceModel(np.empty(0, np.uint64), np.empty(0), -20.0)
    if ones in (0, count):
        return nothing
    share, zeros = F.col("n") / count, count - ones
    spread = F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros)) + 1e-9
    apart = F.abs(F.col("n1") / ones - (F.col("n") - F.col("n1")) / zeros) / spread
    best = (
        rows.mapInArrow(features, "label double, features array<bigint>")
        .select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"))
        .where(F.col("n") >= LEAST_DOCS)
        .orderBy(apart.desc(), "feature")
        .limit(vocabulary)
    )
    known = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                words, sentence, hashes = _sentences(texts)
                at, place = _hits(known, sentence, hashes)
                filled = np.unique(sentence)
                text = np.searchsorted(words.text_start, words.start[np.searchsorted(sentence, filled)], "right") - 1
                n_sentences = np.bincount(text, minlength=b - a)
                edges = np.searchsorted(text[np.searchsorted(filled, at)], np.arange(b - a + 1))
                lists = [np.stack([at[x:y], place[x:y]], 1).tobytes() for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n_sentences), pa.array(lists, pa.binary())],
                    ["label", "sentences", "pairs"],
                )

    found = rows.mapInArrow(instances, "label double, sentences bigint, pairs binary").toArrow()
    pairs = [np.frombuffer(p, np.int64).reshape(-1, 2) for p in found.column("pairs").to_pylist()]
    y, n_sentences = found.column("label").to_numpy(), found.column("sentences").to_numpy()
    return climb(known, y, n_sentences, pairs)


def climb(
    known: np.ndarray, y: np.ndarray, n_sentences: np.ndarray, pairs: list[np.ndarray]
) -> SentenceModel:
    """Fit the weights; ``pairs`` has (sentence, feature) of each document."""
    doc = np.repeat(np.arange(len(y)), [len(p) for p in pairs])
    flat = np.concatenate([*pairs, np.empty((0, 2), np.int64)])
    bags, bag = np.unique(np.stack([doc, flat[:, 0]], 1), axis=0, return_inverse=True)
    bag, of, feature = bag.ravel(), bags[:, 0], flat[:, 1]
    plain = n_sentences - np.bincount(of, minlength=len(y))
    weights, bias = np.zeros(len(known)), -4.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(bag, weights[feature], len(bags))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-p0)
        clean = np.exp(none)
        slope = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        dz = slope[of] * p
        gradient = np.append(
            np.bincount(feature, dz[bag], len(known)) / len(y) + 1e-4 * weights,
            (dz.sum() + (slope * plain).sum() * p0) / len(y),
        )
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return SentenceModel(known, weights, bias)


def score_toxicity(
    docs: DataFrame,
    model: SentenceModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """The id, ``score``, ``predicted`` and the offending ``sentences``.

    The score is the noisy-or of the sentences' scores; sentences are given
    where their own score reaches ``threshold``, with ``start`` and ``end`` in
    code points (first to last word).  A text without words scores 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                words, sentence, hashes = _sentences(texts)
                at, place = _hits(model.features, sentence, hashes)
                n_sentences = int(sentence[-1]) + 1 if len(sentence) else 0
                z = model.bias + np.bincount(at, model.weights[place], n_sentences)
                filled = np.unique(sentence)
                score = 1 / (1 + np.exp(-z[filled]))
                first = np.searchsorted(sentence, filled)
                last = np.searchsorted(sentence, filled, "right") - 1
                text = np.searchsorted(words.text_start, words.start[first], "right") - 1
                none = np.bincount(text, np.log1p(-np.minimum(score, 1 - 1e-15)), b - a)
                bad = np.flatnonzero(score >= threshold)
                letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                origin = letters[words.text_start[text[bad]]]
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(letters[words.start[first[bad]]] - origin, pa.int64()),
                        pa.array(letters[words.end[last[bad]]] - origin, pa.int64()),
                        pa.array(score[bad], pa.float64()),
                    ],
                    ["start", "end", "score"],
                )
                ends = np.searchsorted(text[bad], np.arange(b - a + 1)).astype(np.int32)
                total = -np.expm1(none) + 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(total),
                        pa.array((total >= threshold).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), spans),
                    ],
                    [id_column, "score", "predicted", "sentences"],
                )

    rows = docs.select(named(id_column), whole_text(text_column).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    spans = "array<struct<start: bigint, end: bigint, score: double>>"
    return rows.mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int, sentences {spans}")

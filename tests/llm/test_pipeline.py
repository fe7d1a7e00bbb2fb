import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from helpers import documents, prose
from tablog.llm import queries
from tablog.llm.bpe import read_ranks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(30)
    texts, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randrange(20, 80), 10**6)
        bad = rng.random() < 0.25
        labels.append((i, int(not bad), 0))
        lines = [" ".join(x.upper() + "!!" if bad else x for x in w[k : k + 10]) for k in range(0, len(w), 10)]
        texts.append("\n".join(lines))
    good = next(i for i, quality, _ in labels if quality)
    texts += [texts[good], texts[good], None, ""]
    sources = [rng.choice(["a", "b", "c", None]) for _ in texts]
    documents(spark, texts, sources=sources).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, labels


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows after every stage."""
    path, _ = folder
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.collect()
    return out


def test_stages_keep_the_columns_and_take_effect(stages, folder):
    _, labels = folder
    ids = {name: [r.doc_id for r in rows] for name, rows in stages.items()}
    for name in ("quality", "lines", "near_duplicates", "mixing"):
        assert list(stages[name][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [i for i, quality, _ in labels if quality]
    assert len(set(good) - set(ids["quality"])) <= 3
    assert len([i for i, quality, _ in labels if not quality and i in ids["quality"]]) <= 3
    assert not {300, 301} & set(ids["lines"])  # copies, line by line
    assert set(ids["near_duplicates"]) <= set(ids["lines"])
    assert set(ids["mixing"]) <= set(ids["near_duplicates"])
    assert len(ids["mixing"]) != len(set(ids["mixing"]))  # epochs
    assert sorted(ids["tokens"]) == sorted(ids["mixing"])


def test_tokens_of_what_was_mixed(stages):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for r in stages["mixing"]:
        tokens = reference.encode_ordinary(r.text or "")
        ids = ",".join(map(str, tokens)).encode()
        want.append((r.doc_id, len(tokens), digest(ids), digest((r.text or "").encode())))
    assert sorted(map(tuple, stages["tokens"])) == sorted(want)


def test_run_is_the_stages_in_a_row(spark, folder, stages):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages["tokens"]))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_no_rows_and_odd_rows(spark, folder, name, stage):
    path, _ = folder
    assert stage(spark, documents(spark, []), path).count() == 0
    extra = ["score", "item", "_id", "n_words"]
    docs = documents(spark, [None, "", "one", None], ids=[None, 3, 3, 4], sources=[None, "a", "a", "b"], extra=extra)
    rows = stage(spark, docs, path)
    if name != "tokens":
        assert rows.columns == docs.columns
    assert rows.count() <= 8


def test_lines_stage_drops_long_lines_whose_letters_moved(spark, folder):
    path, _ = folder
    rng = random.Random(31)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(1200))
    texts = [long, "one more " * 30 + long, long[: len(long) // 2], "other"]
    rows = corpus_pipeline.lines(spark, documents(spark, texts), path).collect()
    assert sorted(r.doc_id for r in rows) == [0, 2, 3]


def test_every_operator_has_a_query():
    names = queries.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(queries.oracle_sql()) <= set(names)

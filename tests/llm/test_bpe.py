import public_tokenizers
import pytest
import tiktoken
from helpers import AWKWARD, documents
from tablog.llm import queries
from tablog.llm.bpe import Encoder, decode, encode, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    *AWKWARD,
    "It's 2024: they'll   pay $1,234.56\r\n\r\n  for naïve façades…",
    "def f(x):\n\treturn x**2  # ünïcode",
    "ab" * 3000,
    "<|endoftext|> <unk> ▁▁",
    "한국어와 日本語 и русский العربية",
]


@pytest.fixture(scope="module")
def reference():
    ranks = read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_as_the_ranks_say_and_round_trip(spark, reference):
    docs = documents(spark, TEXTS, extra=["ids", "decoded"])
    rows = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr("tablog.llm.bpe.REMEMBERED", 3)
    monkeypatch.setattr("tablog.llm.bpe.BLOCK", 5)
    encoder = Encoder(read_ranks(PATH), public_tokenizers.PATTERN)
    for text in TEXTS[-5:]:
        assert encoder.ids(text).tolist() == reference.encode_ordinary(text)


def test_empty_table_repeated_and_null_ids(spark):
    assert encode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    docs = documents(spark, ["a b", "a b"], ids=[None, None])
    assert [len(r.ids) for r in encode(docs, PATH, public_tokenizers.PATTERN).collect()] == [2, 2]


def test_unknown_ids_are_an_error(spark):
    rows = spark.createDataFrame([(1, [5, 10**6])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(rows, PATH).collect()
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bytes(decode(none, PATH).first().decoded) == b""


def test_round_trip_is_both_steps_in_one_worker(spark):
    docs = documents(spark, [*TEXTS, "a b"], ids=[*range(len(TEXTS)), None], extra=["ids", "decoded"])
    want = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    got = round_trip(docs, PATH, public_tokenizers.PATTERN)
    assert got.schema == want.schema
    key = lambda r: (-1 if r.doc_id is None else r.doc_id)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = queries.token_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1

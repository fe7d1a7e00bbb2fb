import hashlib
from collections import defaultdict

from helpers import AWKWARD, documents
from tablog.llm.exact import drop_exact, exact_groups


def test_groups_by_bytes_and_the_row_that_stays(spark):
    texts = [*AWKWARD, "x", "x", "x ", "X"]
    got = {r.doc_id: r for r in exact_groups(documents(spark, texts), keep="largest").collect()}
    groups = defaultdict(list)
    for i, text in enumerate(texts):
        groups[text or ""].append(i)
    for i, text in enumerate(texts):
        group = groups[text or ""]
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(got[i])[1:] == (max(group), len(group), i == max(group), sha)


def test_smallest_id_and_rows_without_id(spark):
    docs = documents(spark, ["a", "a", "a", "b", "b"], ids=[None, 4, 3, None, None])
    kept = {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert kept == {(None, False, 3, 3), (4, False, 3, 3), (3, True, 3, 3), (None, True, None, 2)}


def test_repeated_rows_and_clashing_columns(spark):
    docs = documents(spark, ["a", "a", "b"], ids=[1, 1, 2], extra=["keep_id", "kept", "_hash", "a.b"])
    assert sorted(r.kept for r in exact_groups(docs).collect()) == [True, True, True]
    stayed = drop_exact(docs)
    assert stayed.columns == docs.columns and stayed.count() == 3


def test_empty_table(spark):
    assert exact_groups(documents(spark, [])).count() == 0

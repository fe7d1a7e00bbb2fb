import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablog import Condition, View, ViewSpec, apply_filter, build_predicate, combine
from tablog.functions.regex import full_match_pattern, required_texts
from tablog.functions.text import is_blank, trim_query


def passing(log, *conditions, **spec):
    view = View(log, ViewSpec(conditions=conditions, **spec))
    return [r["line_number"] - 1 for r in view.rows().collect()]


CASES = [
    # text, column, rows, indices of rows that pass
    ("", None, [["test"]], [0]),
    (None, None, [["test"]], [0]),
    ("   ", 3, [["test"]], [0]),
    ("test", None, [["this is a test"], ["TEST"], ["nope"]], [0, 1]),
    ("error", 1, [["info", "error occurred"], ["error occurred", "info"], ["nope"]], [0]),
    ("/^test.*$/", None, [["test123"], ["other", "testing"], ["notest"]], [0, 1]),
    (r"/\d+/", 0, [["123", "text"], ["text", "123"]], [0]),
    ("/[invalid(/", None, [["a"], [""]], [0, 1]),
    ("ERROR", None, [["error occurred"], ["Error"], ["ERROR"]], [0, 1, 2]),
    ("test", 10, [["test"]], []),
    ("test", -1, [["test"]], []),
    ("/ERROR|FATAL/", None, [["an ERROR here"], ["FATAL"], ["x", "ERROR"]], [1, 2]),
    ("/error/", None, [["ERROR"], ["error"]], [1]),
    ("/.*/", 5, [["a", "b"], list("abcdef")], [1]),
    ("//", None, [["a", ""], ["a"]], [0]),
    ("/", None, [["a/b"], ["ab"]], [0]),
    ("  err  ", None, [["error"]], [0]),
    ("\u00a0", None, [["a\u00a0b"], ["a"]], [0]),  # not white space
    ("\x01", None, [["a"], [""]], [0, 1]),  # not blank, yet trimmed to nothing
    ("\x01", 1, [["a"], ["a", ""]], [1]),
    ("/a)(b/", None, [["x"]], [0]),
    (r"/\Qa.b/", None, [["a.b"], ["axb"]], [0]),
    ("/(?x)a b # comment/", None, [["ab"], ["a b"]], [0]),
    ("/(?i)error/", None, [["ERROR"]], [0]),
    ("/a|ab/", None, [["ab"], ["abc"]], [0]),
    ("/a$/", None, [["a"], ["a\u2028"]], [0]),
    (r"/(.)\1/", None, [["aa"], ["ab"]], [0]),
    ("ÄÖ", None, [["xäöx"]], [0]),
    ("日本", 0, [["日本語"], ["テスト"]], [0]),
]


@pytest.mark.parametrize("text,column,rows,expected", CASES)
def test_condition(make_log, text, column, rows, expected):
    assert passing(make_log(rows), Condition(text, column)) == expected


def test_and(make_log):
    log = make_log([["error 2024"], ["error only"], ["2024 only"]])
    assert passing(log, Condition("error"), Condition("2024")) == [0]
    assert passing(log) == [0, 1, 2]
    assert passing(log, Condition("only")) == [1, 2]


def test_combine(make_log, spark):
    log = make_log([["a"]])
    yes, no = F.lit(True), F.lit(False)
    assert apply_filter(log, combine([])).count() == 1
    assert apply_filter(log, combine([yes, no, yes])).count() == 0


def test_list_replaces_single_filter(make_log):
    log = make_log([["a"], ["zzz"]])
    zzz = Condition("zzz")
    assert passing(log, single=zzz) == [1]
    assert passing(log, Condition(""), single=zzz) == [0, 1]
    assert passing(log, Condition("a"), single=zzz) == [0]


def test_own_predicate(make_log):
    log = make_log([["a"], ["b", "a"], ["a", "b"]])
    assert passing(log, F.size("fields") > 1, Condition("a", 0)) == [2]
    # A predicate that is NULL does not pass.
    assert passing(log, F.get("fields", F.lit(1)) == "a") == [1]


def test_pandas_predicate(make_log):
    import pandas as pd

    @F.pandas_udf("boolean")
    def palindrome(texts: pd.Series) -> pd.Series:
        return texts == texts.str[::-1]

    log = make_log([["anna"], ["bob", "x"], ["eve2"]])
    assert passing(log, palindrome(F.get("fields", F.lit(0))), Condition("b")) == [1]


def test_one_file(make_log, spark):
    from dataclasses import replace

    both = make_log([["a"], ["b"]], file_name="x").frame.union(
        make_log([["a", "c"]], file_name="y").frame
    )
    log = replace(make_log([["a"]]), frame=both, order=("file_name", "line_number"), columns=2)
    assert passing(log.one_file("x"), Condition("a")) == [0]
    assert log.one_file("x").known_columns() == 1 and log.one_file("x").known_max_line() == 2


def test_rebind():
    spec = ViewSpec(
        conditions=(Condition("x", 2), Condition("y", 5), Condition("z")),
        single=Condition("q", 1),
        hidden=(1,),
    )
    again = spec.rebind(3)
    assert again.conditions == (Condition("x", 2), Condition("y"), Condition("z"))
    assert again.single is None and again.hidden == () and again.sort.by_line


def test_blank_and_trim():
    assert is_blank(None) and is_blank("") and is_blank(" \t\u3000\u2028")
    assert not is_blank("\u00a0") and not is_blank("\x01") and not is_blank("\u2007")
    assert trim_query("\x00\x1f a\u00a0 ") == "a\u00a0"


def test_predicates_apply_to_a_stream(spark, make_log, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("x\terror\ny\tok\n")
    log = make_log([["a"]])
    stream = spark.readStream.text(str(tmp_path / "in")).select(
        F.split("value", "\t", -1).alias("fields")
    )
    hits = stream.where(build_predicate(Condition("ERR", 1), log))
    query = hits.writeStream.format("memory").queryName("hits").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r["fields"] for r in spark.table("hits").collect()] == [["x", "error"]]


def test_only_a_bad_pattern_passes_all_rows(spark, monkeypatch):
    from pyspark.errors import PySparkException
    from tablog.functions import regex

    assert regex.full_match_pattern("[unclosed(") is None

    def fail(*args, **options):
        raise PySparkException("lost", errorClass="CONNECT_URL_NOT_SET", messageParameters={})

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", fail)
        with pytest.raises(PySparkException):
            regex.full_match_pattern("never seen before")
    assert regex.full_match_pattern("never seen before") is not None


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Like
    from tablog.plans.durable import shared_folder

    def session(master):
        context = Like(getCheckpointDir=lambda: None, master=master, setCheckpointDir=lambda folder: None)
        return Like(conf=Like(get=lambda name, default: None), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]"))


@pytest.mark.parametrize(
    "body,texts",
    [
        ("ERROR|FATAL", ["ERROR", "FATAL"]),
        ("user-.*timeout", ["timeout"]),
        ("abc?de", ["ab"]),
        ("ab+cd", ["ab"]),
        ("a{0}bcd", ["bcd"]),
        ("xy{2,3}z(hidden|group)w.end", ["end"]),
        (r"\d+\.\d+ ms", [" ms"]),
        (r"\[warn\] x", ["[warn] x"]),
        ("[a-z]lit[^]]", None),
        ("lit[a-c]+", ["lit"]),
        ("(only|groups)", None),
        ("abc|d", None),
        ("abc|", None),
        ("(?i)error", None),
        (r"\Qa|b\E", None),
        (r"\x41bc", None),
        (r"\p{L}abc", None),
        ("[a&&b]cde", None),
        ("a*", None),
        ("", None),
        ("ü日本+x", ["ü日本"]),
    ],
)
def test_texts_that_a_match_must_hold(body, texts):
    assert required_texts(body) == texts


def test_required_texts_lose_no_match(spark, make_log):
    draw = random.Random(17)
    atoms = ["a", "b", "ab", "bab", "c?", "(a|b)", "(ab)*", "[ab]", "[^c]", "a{2}", "b{0,1}", ".", r"\w", "c+", "a*?", r"\-", "|"]
    fields = [["".join(draw.choice("abc-") for _ in range(draw.randrange(8))) for _ in range(3)] for _ in range(300)]
    log = make_log(fields)
    lined = replace(
        log, frame=log.frame.withColumn("value", F.array_join("fields", "\t")), lines=True, raw=True
    )
    checked = 0
    for _ in range(60):
        body = "".join(draw.choice(atoms) for _ in range(draw.randrange(1, 6)))
        wrapped = full_match_pattern(body)
        if required_texts(body) is None or wrapped is None:
            continue
        plain = log.frame.where(F.exists("fields", lambda f: f.rlike(wrapped)))
        want = sorted(r[0] for r in plain.select("line_number").collect())
        for each in (log, lined):
            found = apply_filter(each, build_predicate(Condition(f"/{body}/"), each))
            assert sorted(r[0] for r in found.select("line_number").collect()) == want, body
        checked += 1
    assert checked > 8


def test_a_required_text_is_searched_before_the_pattern(make_log):
    log = make_log([["ERROR"], ["x"]])
    lined = replace(log, frame=log.frame.withColumn("value", F.array_join("fields", "\t")), lines=True)
    plan = View(lined, ViewSpec(conditions=(Condition("/ERROR|FATAL/"),))).rows()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" in text and text.index("Contains(") < text.index("exists(")

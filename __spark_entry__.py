"""

The reports below see the driver's tables as logs:

* ``events``: one line per event, fields event_id, user_id, event_type, props;
* ``documents``: each document is a file, its fields are separated by a space;
* ``pages``: each URL is a file of one line, its fields are separated by '/';
* ``orders``: one line per order in key order, all text columns as fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablog as tl
from tablog.functions.text import line_label
from tablog.operators.columns import (
    config_from_json,
    config_to_json,
    delete_hidden,
    load_config,
    read_config_json,
    save_config,
    update_config,
    upsert_hidden,
    with_hidden,
    write_config_json,
)
from tablog.operators.reshape import visible_fields, visible_line
from tablog.plans.durable import scratch_path
from tablog.sources.table import log_from_table, log_from_texts

try:  # the training-data operators are a package of their own, which may be absent
    import corpus_pipeline
    from tablog.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("tablog.llm", "corpus_pipeline"):
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
EVENT_FIELDS = ["event_id", "user_id", "event_type", "props"]
ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


# ---- the tables as logs -------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> tl.Log:
    events = table(spark, sf_dir, "events")
    return log_from_table(events, EVENT_FIELDS, line_number=F.col("event_id") + 1)


def document_log(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> tl.Log:
    documents = table(spark, sf_dir, "documents")
    return log_from_texts(documents, "text", "doc_id", separator=" ", max_rows=max_rows)


def order_log(spark: SparkSession, sf_dir: str) -> tl.Log:
    orders = table(spark, sf_dir, "orders")
    return log_from_table(orders, ORDER_FIELDS, order_by=[F.col("o_orderkey")])


def lines_of(df: DataFrame, *more: str) -> DataFrame:
    """Rows with their fields joined, for comparing."""
    return df.select("file_name", "line_number", *more, tl.row_text(F.col("fields")).alias("text"))


def event_view(spark: SparkSession, sf_dir: str, **spec) -> tl.View:
    return tl.View(event_log(spark, sf_dir), tl.ViewSpec(**spec))


def document_view(spark: SparkSession, sf_dir: str, **spec) -> tl.View:
    return tl.View(document_log(spark, sf_dir), tl.ViewSpec(**spec))


# ---- filters ------------------------------------------------------------


def on_events(*conditions, **spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines_of(event_view(spark, sf_dir, conditions=conditions, **spec).filtered)

    return query


def on_documents(*conditions, **spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines_of(document_view(spark, sf_dir, conditions=conditions, **spec).filtered)

    return query


def rebind_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions made for a wider log: column 9 does not exist among the events."""
    log = event_log(spark, sf_dir)
    wide = tl.ViewSpec(conditions=(tl.Condition("ERR", 2), tl.Condition("9", 9)))
    return lines_of(tl.View(log, wide.rebind(log.known_columns())).filtered)


def filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = document_log(spark, sf_dir)
    return lines_of(tl.apply_filter(log, F.size("fields") >= F.length("file_name") * 4))


# ---- sorts, positions ---------------------------------------------------

FLAGSHIP = dict(
    conditions=(tl.Condition("9"), tl.Condition("/error|signup|view/", 2)),
    sort=tl.Sort(2, ascending=False),
    hidden=(1,),
)


def filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two conditions, sort by a column, visible columns, position in the view."""
    view = event_view(spark, sf_dir, **FLAGSHIP)
    placed = tl.with_positions(view)
    line = visible_line(tl.Log(placed), view.visible_columns())
    return placed.select("position", "line_number", line.alias("line"))


def sort_column_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows: a missing field sorts first."""
    view = document_view(spark, sf_dir, sort=tl.Sort(6))
    return lines_of(tl.with_positions(view), "position")


def sort_column_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few hot keys: ties keep ascending line order."""
    view = event_view(spark, sf_dir, sort=tl.Sort(2, ascending=False))
    return lines_of(tl.with_positions(view), "position")


def sort_line_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(spark, sf_dir, sort=tl.Sort(ascending=False))
    return lines_of(tl.with_positions(view), "position")


def sort_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's own sort expression in front: widest lines first."""
    view = document_view(spark, sf_dir, order_by=((F.size("fields"), False),))
    return lines_of(tl.with_positions(view), "position")


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(order_log(spark, sf_dir).frame)


def page_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = document_view(spark, sf_dir, sort=tl.Sort(2))
    return lines_of(tl.page(view, 100, 50), "position")


def page_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near enough for a top-n, beyond what Spark limits within a window."""
    view = event_view(spark, sf_dir, sort=tl.Sort(2, ascending=False))
    return lines_of(tl.page(view, 5000, 50), "position")


def page_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reach of a top-n."""
    view = tl.View(order_log(spark, sf_dir), tl.ViewSpec(sort=tl.Sort(3, ascending=False)))
    return lines_of(tl.page(view, 12_000, 500), "position")


def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(spark, sf_dir, sort=tl.Sort(1))
    return lines_of(tl.row_range(view, 250, 40), "position")


def rows_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(spark, sf_dir, sort=tl.Sort(2, ascending=False))
    return lines_of(tl.rows_at(view, [700, 5, 5, 0, 99, -3, 10**9]), "position")


def rows_at_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a table: one per label, many more than a user would pick."""
    view = event_view(spark, sf_dir, sort=tl.Sort(2, ascending=False))
    chosen = table(spark, sf_dir, "labels").select((F.col("doc_id") * 11).alias("position"))
    return lines_of(tl.rows_at(view, chosen), "position")


GOTO_REQUESTS = ["7", " 12 ", "500", "0", "-4", "1.5", "abc", "", "+9", "99999999", "9999999999"]


def goto_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(spark, sf_dir, conditions=FLAGSHIP["conditions"], sort=FLAGSHIP["sort"])
    return tl.goto_lines(view, GOTO_REQUESTS)


def goto_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per label; those of toxic documents are not whole numbers."""
    view = event_view(spark, sf_dir, conditions=FLAGSHIP["conditions"], sort=FLAGSHIP["sort"])
    line = (F.col("doc_id") * 13).cast("string")
    request = F.when(F.col("toxic") == 1, F.concat(line, F.lit(".5"))).otherwise(line)
    labels = table(spark, sf_dir, "labels")
    return tl.goto_lines(view, labels.select(request.alias("request")))


def goto_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers with gaps: a number between two lines is missing, not filtered out."""
    orders = table(spark, sf_dir, "orders")
    log = log_from_table(orders, ORDER_FIELDS, line_number=(F.col("o_orderkey") + 1) * 4)
    view = tl.View(log, tl.ViewSpec(conditions=(tl.Condition("/O|P/", 2),)))
    request = (F.col("doc_id") * 6).cast("string")
    return tl.goto_lines(view, table(spark, sf_dir, "labels").select(request.alias("request")))


def find_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of as many lines as there are labels."""
    view = event_view(spark, sf_dir, conditions=FLAGSHIP["conditions"], sort=FLAGSHIP["sort"])
    lines = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("line_number"))
    return tl.position_table(view, lines)


# ---- projections, columns -----------------------------------------------


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight fields of every line; documents have lines of thousands."""
    return tl.wide_table(document_log(spark, sf_dir), columns=8)


def event_files(spark: SparkSession, sf_dir: str) -> tl.Log:
    """The events with a file per event_type, only errors with their props: the width is in the rows."""
    short = [F.col(name).cast("string") for name in EVENT_FIELDS[:3]]
    wide = F.array(*short, F.coalesce("props", F.lit("")))
    fields = F.when(F.col("event_type") == "error", wide).otherwise(F.array(*short))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("file_name"),
        (F.col("event_id") + 1).cast("bigint").alias("line_number"),
        fields.alias("fields"),
    )
    return tl.Log(frame=rows)


def wide_table_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many columns as the widest line of all files has."""
    return tl.wide_table(event_files(spark, sf_dir))


def wide_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as files of words: some dozens of columns, short lines padded to the widest one."""
    log = log_from_texts(table(spark, sf_dir, "benchmark"), "text", "item_id", separator=" ")
    wide = tl.wide_table(log)
    cells = [c for c in wide.columns if c.startswith("col_")]
    joined = F.array_join(F.array(*cells), "|").alias("cells")
    return wide.select("file_name", "line_number", F.lit(len(cells)).cast("bigint").alias("width"), joined)


def visible_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.wide_table(event_log(spark, sf_dir), hidden=(1, 3, 99, -1))


def label_config(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """Hidden columns for the labelled documents."""
    hidden = F.array(F.col("quality"), F.col("toxic") + 4)
    return table(spark, sf_dir, "labels").select(
        F.col(key).cast("string").alias("file_name"), hidden.alias("hidden")
    )


def document_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden columns for all documents."""
    hidden = F.array(F.lit(0), F.length("lang"), F.length("source"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_name"), hidden.alias("hidden")
    )


def shown_config(config: DataFrame) -> DataFrame:
    texts = F.transform("hidden", lambda i: i.cast("string"))
    return config.select("file_name", F.array_join(texts, ",").alias("hidden"))


def hidden_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = document_log(spark, sf_dir)
    rows = with_hidden(log, label_config(spark, sf_dir))
    shown = visible_fields(F.col("fields"), F.col("hidden"), 8)
    return rows.select("file_name", "line_number", tl.row_text(shown).alias("text"))


def hidden_by_file_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines padded to the width found, without their file's hidden columns."""
    log = event_files(spark, sf_dir)
    files = table(spark, sf_dir, "events").select(F.col("event_type").alias("file_name")).distinct()
    config = files.select("file_name", F.array(F.length("file_name") % 4).alias("hidden"))
    shown = visible_fields(F.col("fields"), F.col("hidden"), log.known_columns())
    return with_hidden(log, config).select("file_name", "line_number", tl.row_text(shown).alias("text"))


def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = document_config(spark, sf_dir)
    return shown_config(upsert_hidden(config, label_config(spark, sf_dir)))


def config_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = document_config(spark, sf_dir)
    return shown_config(delete_hidden(config, label_config(spark, sf_dir)))


def config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_config(config_from_json(config_to_json(document_config(spark, sf_dir))))


def config_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config written by line, read back and updated, a file's last update counting."""
    path = scratch_path(spark, "config")
    write_config_json(document_config(spark, sf_dir), path, lines=True)
    update = label_config(spark, sf_dir)
    earlier = update.select("file_name", F.array(F.lit(9)).alias("hidden"), F.lit(1).alias("turn"))
    updates = earlier.unionByName(update.withColumn("turn", F.lit(2)))
    return shown_config(upsert_hidden(read_config_json(spark, path), updates, order="turn"))


def config_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config saved, updated twice from what is newest, and loaded."""
    path = scratch_path(spark, "config")
    save_config(document_config(spark, sf_dir), path)
    update_config(spark, path, lambda config: upsert_hidden(config, label_config(spark, sf_dir)))
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    names = gone.select(F.col("doc_id").cast("string").alias("file_name"))
    update_config(spark, path, lambda config: delete_hidden(config, names))
    return shown_config(load_config(spark, path))


# ---- loading and writing ------------------------------------------------


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.load_summary(document_log(spark, sf_dir, max_rows=5))


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a capped log outlives storing and opening it again."""
    path = scratch_path(spark, "stored")
    tl.store_log(document_log(spark, sf_dir, max_rows=5), path)
    return tl.load_summary(tl.open_log(spark, path))


def one_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a capped log keeps its summary, too."""
    return tl.load_summary(document_log(spark, sf_dir, max_rows=5).one_file("7"))


def line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(document_log(spark, sf_dir, max_rows=5).frame)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_log(spark, sf_dir).frame.select("file_name", "line_number", "value")


def column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = document_log(spark, sf_dir).frame
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max(F.size("fields")), F.lit(0)).cast("bigint").alias("columns"),
    )


def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text files and read back, in line order over all files."""
    path = scratch_path(spark, "events")
    tl.write_view(event_view(spark, sf_dir), path)
    log = tl.read_log(spark, path)
    placed = tl.with_positions(tl.View(log))
    return placed.select("position", tl.row_text(F.col("fields")).alias("text"))


def read_back_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered view of text files keeps positions without a sort."""
    path = scratch_path(spark, "events")
    tl.write_view(event_view(spark, sf_dir), path)
    view = tl.View(
        tl.read_log(spark, path),
        tl.ViewSpec(conditions=FLAGSHIP["conditions"], sort=tl.Sort(ascending=False)),
    )
    placed = tl.with_positions(view)
    return placed.select("position", tl.row_text(F.col("fields")).alias("text"))


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered copy of the documents, searched and sorted again."""
    log = tl.store_log(document_log(spark, sf_dir), scratch_path(spark, "stored"))
    spec = tl.ViewSpec(conditions=(tl.Condition("/[a-z]+/", 1),), sort=tl.Sort(1))
    return lines_of(tl.with_positions(tl.View(log, spec)), "position")


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log with filters of its files, searched for a text and a pattern that requires one."""
    log = tl.store_log(document_log(spark, sf_dir), scratch_path(spark, "stored"), searchable=True)
    spec = tl.ViewSpec(conditions=(tl.Condition("The"), tl.Condition("/.*er.*/", 0)))
    return lines_of(tl.View(log, spec).rows())


def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files per language: rows and widest row."""
    path = scratch_path(spark, "documents")
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    summary = tl.read_log(spark, path, separator=" ").summarize()
    lang = F.regexp_extract("file_path", "lang=([^/]*)/", 1)
    return summary.groupBy(lang.alias("lang")).agg(
        F.sum("rows").alias("rows"),
        F.max("columns").cast("bigint").alias("columns"),
        F.bool_or("truncated").alias("truncated"),
    )


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = document_view(spark, sf_dir, sort=tl.Sort(3, ascending=False))
    return tl.export_lines(view, [0, 1, 5])


def export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows written and read back, with the count the writer returned."""
    view = event_view(spark, sf_dir, sort=tl.Sort(1), hidden=(0, 2))
    chosen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("position"))
    path = scratch_path(spark, "selected")
    written = tl.write_rows_at(view, chosen, path)
    lines = spark.read.text(path)
    return lines.select("value", F.lit(written).cast("bigint").alias("written"))


def export_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second export takes the place of the first."""
    path = scratch_path(spark, "twice")
    tl.write_view(event_view(spark, sf_dir), path)
    written = tl.write_view(event_view(spark, sf_dir, **FLAGSHIP), path)
    lines = spark.read.text(path)
    return lines.select("value", F.lit(written).cast("bigint").alias("written"))


def export_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty view, no selection and no visible column leave the target as it is."""
    path = scratch_path(spark, "kept")
    tl.write_view(event_view(spark, sf_dir, **FLAGSHIP), path)
    nothing = event_view(spark, sf_dir, conditions=(tl.Condition("no such text"),))
    hidden = event_view(spark, sf_dir, hidden=(0, 1, 2, 3))
    written = tl.write_view(nothing, path) + tl.write_rows_at(nothing, [0], path)
    written += tl.write_rows_at(event_view(spark, sf_dir), [], path)
    written += tl.write_rows_at(hidden, [0, 1], path)
    lines = spark.read.text(path)
    return lines.select("value", F.lit(written).cast("bigint").alias("written"))


def read_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder of files with two endings, those with one."""
    path = scratch_path(spark, "mixed")
    lines = event_lines(spark, sf_dir, F.lit(""))
    lines.where("kind = 'error'").select("value").write.text(path, compression="gzip")
    lines.where("kind <> 'error'").select("value").write.mode("append").text(path)
    log = tl.read_log(spark, path, glob="*.gz")
    return log.frame.select(tl.row_text(F.col("fields")).alias("text"))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows loaded, shown and written."""
    view = event_view(spark, sf_dir, **FLAGSHIP)
    written = tl.write_view(view, scratch_path(spark, "counted"))
    counts = [("loaded", view.log.frame.count()), ("shown", view.count()), ("written", written)]
    return spark.createDataFrame(counts, "kind string, rows bigint")


def event_lines(spark: SparkSession, sf_dir: str, extra) -> DataFrame:
    """Events as raw lines by type, with something appended to those of type error."""
    line = F.concat_ws("\t", *EVENT_FIELDS)
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.when(error, F.concat(line, extra)).otherwise(line).alias("value"),
    )


def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "malformed")
    bad = F.unhex(F.lit("FFFE")).cast("string")
    event_lines(spark, sf_dir, bad).select("value").write.text(path)
    log = tl.read_log(spark, path, on_malformed="keep")
    event_id = F.substring_index("value", "\t", 1).cast("bigint")
    found = tl.malformed_lines(log)
    return found.select(event_id.alias("event_id"), F.substring_index("value", "\t", -1).alias("end"))


def malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "malformed")
    bad = F.unhex(F.lit("C3")).cast("string")
    event_lines(spark, sf_dir, bad).select("value").write.text(path)
    log = tl.read_log(spark, path, on_malformed="drop")
    return log.frame.select(tl.row_text(F.col("fields")).alias("text"))


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in one folder per type; those of type error carry NUL bytes."""
    path = scratch_path(spark, "binary")
    event_lines(spark, sf_dir, F.lit("\0")).write.partitionBy("kind").text(path)
    kind = F.regexp_extract("file_path", "kind=([^/]*)/", 1)
    files = tl.binary_files(spark, path)
    return files.groupBy(kind.alias("kind")).agg(F.bool_and("is_binary").alias("is_binary"))


def binary_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "binary")
    event_lines(spark, sf_dir, F.lit("\0")).write.partitionBy("kind").text(path)
    log = tl.read_log(spark, path, on_binary="skip")
    return log.frame.select(tl.row_text(F.col("fields")).alias("text"))


# ---- rows in other forms ------------------------------------------------


def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_log(spark, sf_dir).frame
    return rows.select(
        "file_name",
        "line_number",
        F.size("fields").alias("width"),
        tl.row_text(F.col("fields")).alias("text"),
    )


def explode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.explode_fields(document_log(spark, sf_dir).frame)


def detail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_log(spark, sf_dir).frame
    return rows.select("file_name", "line_number", tl.detail_text(F.col("fields")).alias("detail"))


def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_log(spark, sf_dir).frame
    return rows.select("line_number", line_label(F.col("line_number")).alias("label"))


# ---- contract -----------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    return filter_sort(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    C = tl.Condition
    return {
        "filter_substring_any": on_events(C(" ERR ")),
        "filter_substring_line": on_documents(C("Ting")),
        "filter_substring_column": on_documents(C("AN", 5)),
        "filter_regex_any": on_documents(C("/[A-Z][a-z]{9,}/")),
        "filter_regex_rectangular": on_events(C("/1?99|error/")),
        "filter_regex_column": on_documents(C("/[a-z]{3,5}/", 4)),
        "filter_blank": on_events(C(" \t "), C(None, 2)),
        "filter_invalid_regex": on_events(C("/[invalid(/", 2)),
        "filter_out_of_range": on_documents(C("/.*/", 40)),
        "filter_and": on_events(C("error", 2), C("/.*7.*/", 1), C("")),
        "filter_precedence": on_events(C(""), single=C("error")),
        "filter_single": on_documents(single=C("tha", 0)),
        "filter_expr": filter_expr,
        "rebind_conditions": rebind_conditions,
        "filter_sort": filter_sort,
        "sort_column_asc": sort_column_asc,
        "sort_column_desc": sort_column_desc,
        "sort_line_desc": sort_line_desc,
        "sort_expr": sort_expr,
        "table_lines": table_lines,
        "page_near": page_near,
        "page_middle": page_middle,
        "page_far": page_far,
        "row_range": row_range,
        "rows_at_positions": rows_at_positions,
        "rows_at_table": rows_at_table,
        "goto_lines": goto_lines,
        "goto_table": goto_table,
        "goto_gaps": goto_gaps,
        "find_many": find_many,
        "wide_table": wide_table,
        "wide_table_found": wide_table_found,
        "wide_ragged": wide_ragged,
        "visible_columns": visible_columns,
        "hidden_by_file": hidden_by_file,
        "hidden_by_file_found": hidden_by_file_found,
        "config_upsert": config_upsert,
        "config_delete": config_delete,
        "config_json": config_json,
        "config_file": config_file,
        "config_saved": config_saved,
        "load_summary": load_summary,
        "stored_summary": stored_summary,
        "one_file_summary": one_file_summary,
        "line_limit": line_limit,
        "line_numbers": line_numbers,
        "column_count": column_count,
        "text_roundtrip": text_roundtrip,
        "read_back_search": read_back_search,
        "stored_log": stored_log,
        "stored_search": stored_search,
        "file_summary": file_summary,
        "export_lines": export_lines,
        "export_selected": export_selected,
        "export_overwrite": export_overwrite,
        "export_nothing": export_nothing,
        "read_glob": read_glob,
        "row_counts": row_counts,
        "malformed_rows": malformed_rows,
        "malformed_dropped": malformed_dropped,
        "binary_files": binary_files,
        "binary_skipped": binary_skipped,
        "row_text": row_text,
        "explode_fields": explode_fields,
        "detail_text": detail_text,
        "line_labels": line_labels,
    } | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


# The logs in SQL: file_name, file_key, line_number, fields.
EV = """ev AS (
  SELECT '' AS file_name, event_id + 1 AS line_number,
         [CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, props] AS fields
  FROM events)"""
DOC = r"""doc AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_name, doc_id AS file_key, i AS line_number,
         lines[i] AS value, string_split(lines[i], ' ') AS fields
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(
                regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS lines
              FROM documents WHERE text <> '')))"""
ORD = """ord AS (
  SELECT '' AS file_name, row_number() OVER (ORDER BY o_orderkey) AS line_number,
         [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
          o_orderpriority] AS fields
  FROM orders)"""
TEXT = "array_to_string(fields, chr(9)) AS text"
LINES = f"file_name, line_number, {TEXT}"
FLAGSHIP_WHERE = """(contains(fields[1], '9') OR contains(fields[2], '9')
  OR contains(fields[3], '9') OR contains(fields[4], '9'))
  AND regexp_full_match(fields[3], 'error|signup|view')"""
CONFIG = """cfg AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_name,
         concat_ws(',', 0, length(lang), length(source)) AS hidden FROM documents),
upd AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_name, concat_ws(',', quality, toxic + 4) AS hidden
  FROM labels)"""
GOTO = f"""shown AS (
  SELECT line_number, row_number() OVER (
           ORDER BY lower(fields[3]) DESC, line_number) - 1 AS position
  FROM ev WHERE {FLAGSHIP_WHERE}),
parsed AS (
  SELECT request, CASE WHEN regexp_full_match(trim(request), '[+-]?[0-9]+')
    THEN TRY_CAST(trim(request) AS BIGINT) END AS line FROM asked)
SELECT request, line,
  CASE WHEN line IS NULL OR line < 1 THEN 'invalid'
       WHEN position IS NOT NULL THEN 'shown'
       WHEN line IN (SELECT line_number FROM ev) THEN 'filtered_out'
       ELSE 'missing' END AS status,
  position, (SELECT count(*) FROM ev) AS max_line
FROM parsed LEFT JOIN shown ON line_number = line"""
ERROR_LINE = """concat_ws(chr(9), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR),
  event_type, props) AS text"""


SUMMARY = f"""WITH {DOC} SELECT CAST(doc_id AS VARCHAR) AS file_name,
    count(*) FILTER (WHERE line_number <= 5) AS rows,
    CAST(coalesce(max(len(fields)) FILTER (WHERE line_number <= 5), 0) AS INTEGER) AS columns,
    coalesce(bool_or(line_number > 5), false) AS truncated
  FROM documents LEFT JOIN doc ON file_key = doc_id GROUP BY doc_id"""


def events_where(condition: str) -> str:
    return f"WITH {EV} SELECT {LINES} FROM ev WHERE {condition}"


def documents_where(condition: str) -> str:
    return f"WITH {DOC} SELECT {LINES} FROM doc WHERE {condition}"


def positions(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS position"


def oracle_sql() -> dict[str, str]:
    split_last = "coalesce(fields[7], '')"
    by_type = "lower(fields[3]) DESC, line_number"
    return {
        "filter_substring_any": events_where(
            "contains(lower(fields[1]), 'err') OR contains(lower(fields[2]), 'err') "
            "OR contains(lower(fields[3]), 'err') OR contains(lower(fields[4]), 'err')"
        ),
        "filter_substring_line": documents_where(
            "len(list_filter(fields, lambda f: contains(lower(f), 'ting'))) > 0"
        ),
        "filter_substring_column": documents_where("coalesce(contains(lower(fields[6]), 'an'), false)"),
        "filter_regex_any": documents_where(
            "len(list_filter(fields, lambda f: regexp_full_match(f, '[A-Z][a-z]{9,}'))) > 0"
        ),
        "filter_regex_rectangular": events_where(
            "len(list_filter(fields, lambda f: regexp_full_match(f, '1?99|error'))) > 0"
        ),
        "filter_regex_column": documents_where(
            "coalesce(regexp_full_match(fields[5], '[a-z]{3,5}'), false)"
        ),
        "filter_blank": events_where("true"),
        "filter_invalid_regex": events_where("true"),
        "filter_out_of_range": documents_where("len(fields) > 40"),
        "filter_and": events_where("fields[3] = 'error' AND contains(fields[2], '7')"),
        "filter_precedence": events_where("true"),
        "filter_single": documents_where("coalesce(contains(lower(fields[1]), 'tha'), false)"),
        "filter_expr": documents_where("len(fields) >= length(file_name) * 4"),
        "rebind_conditions": events_where(
            "contains(lower(fields[3]), 'err') AND (contains(fields[1], '9') OR "
            "contains(fields[2], '9') OR contains(fields[3], '9') OR contains(fields[4], '9'))"
        ),
        "filter_sort": f"""WITH {EV} SELECT {positions(by_type)}, line_number,
            concat_ws(chr(9), fields[1], fields[3], fields[4]) AS line
            FROM ev WHERE {FLAGSHIP_WHERE}""",
        "sort_column_asc": f"""WITH {DOC} SELECT {LINES},
            {positions(f"lower({split_last}), file_key, line_number")} FROM doc""",
        "sort_column_desc": f"WITH {EV} SELECT {LINES}, {positions(by_type)} FROM ev",
        "sort_line_desc": f"""WITH {EV} SELECT {LINES}, {positions("line_number DESC")}
            FROM ev""",
        "sort_expr": f"""WITH {DOC} SELECT {LINES},
            {positions("len(fields) DESC, file_key, line_number")} FROM doc""",
        "table_lines": f"WITH {ORD} SELECT {LINES} FROM ord",
        "page_near": f"""WITH {DOC} SELECT * FROM (SELECT {LINES},
            {positions("lower(coalesce(fields[3], '')), file_key, line_number")} FROM doc)
            WHERE position BETWEEN 100 AND 149""",
        "page_middle": f"""WITH {EV} SELECT * FROM (SELECT {LINES}, {positions(by_type)}
            FROM ev) WHERE position BETWEEN 5000 AND 5049""",
        "page_far": f"""WITH {ORD} SELECT * FROM (SELECT {LINES},
            {positions("lower(fields[4]) DESC, line_number")} FROM ord)
            WHERE position BETWEEN 12000 AND 12499""",
        "row_range": f"""WITH {EV} SELECT * FROM (SELECT {LINES},
            {positions("lower(fields[2]), line_number")} FROM ev)
            WHERE position BETWEEN 40 AND 250""",
        "rows_at_positions": f"""WITH {EV} SELECT * FROM (SELECT {LINES}, {positions(by_type)}
            FROM ev) WHERE position IN (700, 5, 0, 99, 1000000000)""",
        "rows_at_table": f"""WITH {EV} SELECT * FROM (SELECT {LINES}, {positions(by_type)}
            FROM ev) WHERE position IN (SELECT doc_id * 11 FROM labels)""",
        "goto_lines": f"""WITH {EV}, asked AS (SELECT unnest({GOTO_REQUESTS}) AS request),
            {GOTO}""",
        "goto_table": f"""WITH {EV}, asked AS (SELECT CAST(doc_id * 13 AS VARCHAR) ||
              CASE WHEN toxic = 1 THEN '.5' ELSE '' END AS request FROM labels), {GOTO}""",
        "goto_gaps": """WITH lines AS (
              SELECT (o_orderkey + 1) * 4 AS line, o_orderstatus IN ('O', 'P') AS seen FROM orders),
            placed AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS position
              FROM lines WHERE seen),
            asked AS (SELECT doc_id * 6 AS line FROM labels)
            SELECT CAST(line AS VARCHAR) AS request, line,
              CASE WHEN line < 1 THEN 'invalid' WHEN position IS NOT NULL THEN 'shown'
                WHEN line IN (SELECT line FROM lines) THEN 'filtered_out'
                ELSE 'missing' END AS status,
              position, (SELECT max(line) FROM lines) AS max_line
            FROM asked LEFT JOIN placed USING (line)""",
        "find_many": f"""WITH {EV}, shown AS (
              SELECT line_number, row_number() OVER (ORDER BY {by_type}) - 1 AS position
              FROM ev WHERE {FLAGSHIP_WHERE})
            SELECT doc_id * 2 AS line_number, coalesce(position, -1) AS position
            FROM labels LEFT JOIN shown ON line_number = doc_id * 2""",
        "wide_table": f"""WITH {DOC} SELECT file_name, line_number, """
        + ", ".join(f"coalesce(fields[{i + 1}], '') AS col_{i}" for i in range(8))
        + " FROM doc",
        "wide_ragged": """WITH item AS (
              SELECT CAST(item_id AS VARCHAR) AS file_name, i AS line_number, string_split(lines[i], ' ') AS fields
              FROM (SELECT item_id, lines, unnest(range(1, len(lines) + 1)) AS i
                FROM (SELECT item_id, string_split_regex(
                    regexp_replace(text, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r|\\n') AS lines
                  FROM benchmark WHERE text <> ''))),
            sized AS (SELECT *, max(len(fields)) OVER () AS width FROM item)
            SELECT file_name, line_number, width,
              array_to_string(list_resize(fields, width, ''), '|') AS cells FROM sized""",
        "wide_table_found": """SELECT event_type AS file_name, event_id + 1 AS line_number,
            CAST(event_id AS VARCHAR) AS col_0, CAST(user_id AS VARCHAR) AS col_1,
            event_type AS col_2,
            CASE WHEN event_type = 'error' THEN coalesce(props, '') ELSE '' END AS col_3
            FROM events""",
        "visible_columns": f"""WITH {EV} SELECT file_name, line_number, fields[1] AS col_0,
            fields[3] AS col_2 FROM ev""",
        "hidden_by_file": f"""WITH {DOC} SELECT file_name, line_number, array_to_string(
              [coalesce(fields[i + 1], '') FOR i IN range(greatest(8, len(fields)))
               IF quality IS NULL OR (i <> quality AND i <> toxic + 4)], chr(9)) AS text
            FROM doc LEFT JOIN labels ON CAST(doc_id AS VARCHAR) = file_name""",
        "hidden_by_file_found": f"""WITH {EV} SELECT fields[3] AS file_name, line_number,
            array_to_string([CASE WHEN i = 3 AND fields[3] <> 'error' THEN ''
                ELSE coalesce(fields[i + 1], '') END
              FOR i IN range(4) IF i <> length(fields[3]) % 4], chr(9)) AS text FROM ev""",
        "config_upsert": f"""WITH {CONFIG} SELECT file_name, hidden FROM cfg
            WHERE file_name NOT IN (SELECT file_name FROM upd)
            UNION ALL SELECT file_name, hidden FROM upd""",
        "config_delete": f"""WITH {CONFIG} SELECT file_name, hidden FROM cfg
            WHERE file_name NOT IN (SELECT file_name FROM upd)""",
        "config_file": f"""WITH {CONFIG} SELECT file_name, hidden FROM cfg
            WHERE file_name NOT IN (SELECT file_name FROM upd)
            UNION ALL SELECT file_name, hidden FROM upd""",
        "config_saved": f"""WITH {CONFIG} SELECT file_name, hidden FROM
            (SELECT * FROM cfg WHERE file_name NOT IN (SELECT file_name FROM upd)
            UNION ALL SELECT * FROM upd)
            WHERE file_name NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
        "config_json": f"WITH {CONFIG} SELECT file_name, hidden FROM cfg",
        "load_summary": SUMMARY,
        "stored_summary": SUMMARY,
        "one_file_summary": f"SELECT * FROM ({SUMMARY}) WHERE file_name = '7'",
        "line_limit": documents_where("line_number <= 5"),
        "line_numbers": f"WITH {DOC} SELECT file_name, line_number, value FROM doc",
        "column_count": f"""WITH {DOC} SELECT count(*) AS rows,
            coalesce(max(len(fields)), 0) AS columns FROM doc""",
        "text_roundtrip": f"WITH {EV} SELECT line_number - 1 AS position, {TEXT} FROM ev",
        "read_back_search": f"""WITH {EV} SELECT {positions("line_number DESC")}, {TEXT}
            FROM ev WHERE {FLAGSHIP_WHERE}""",
        "stored_log": f"""WITH {DOC} SELECT {LINES},
            {positions("lower(fields[2]), file_key, line_number")} FROM doc
            WHERE coalesce(regexp_full_match(fields[2], '[a-z]+'), false)""",
        "stored_search": f"""WITH {DOC} SELECT {LINES} FROM doc
            WHERE contains(lower(value), 'the') AND contains(fields[1], 'er')""",
        "file_summary": r"""SELECT lang, CAST(sum(len(lines)) AS BIGINT) AS rows,
              CAST(max(list_max([len(string_split(l, ' ')) FOR l IN lines])) AS BIGINT) AS columns,
              false AS truncated
            FROM (SELECT lang, string_split_regex(text, '\r\n|\r|\n') AS lines FROM documents)
            GROUP BY lang""",
        "export_lines": f"""WITH {DOC} SELECT fields[1] || chr(9) || coalesce(fields[2], '')
            || chr(9) || coalesce(fields[6], '') AS value FROM doc""",
        "export_selected": f"""WITH {EV}, placed AS (SELECT fields[2] || chr(9) || fields[4]
              AS value, {positions("lower(fields[2]), line_number")} FROM ev)
            SELECT value, count(*) OVER () AS written FROM placed
            WHERE position IN (SELECT doc_id FROM labels)""",
        "export_overwrite": f"""WITH {EV} SELECT
              concat_ws(chr(9), fields[1], fields[3], fields[4]) AS value,
              count(*) OVER () AS written FROM ev WHERE {FLAGSHIP_WHERE}""",
        "export_nothing": f"""WITH {EV} SELECT
              concat_ws(chr(9), fields[1], fields[3], fields[4]) AS value,
              CAST(0 AS BIGINT) AS written FROM ev WHERE {FLAGSHIP_WHERE}""",
        "read_glob": f"SELECT {ERROR_LINE} FROM events WHERE event_type = 'error'",
        "row_counts": f"""WITH {EV}, hits AS (SELECT count(*) AS n FROM ev WHERE {FLAGSHIP_WHERE})
            SELECT 'loaded' AS kind, count(*) AS rows FROM ev
            UNION ALL SELECT 'shown', n FROM hits UNION ALL SELECT 'written', n FROM hits""",
        "malformed_rows": """SELECT event_id, props || '\ufffd\ufffd' AS "end" FROM events
            WHERE event_type = 'error'""",
        "malformed_dropped": f"SELECT {ERROR_LINE} FROM events WHERE event_type <> 'error'",
        "binary_files": """SELECT DISTINCT event_type AS kind, event_type = 'error' AS is_binary
            FROM events""",
        "binary_skipped": f"SELECT {ERROR_LINE} FROM events WHERE event_type <> 'error'",
        "row_text": f"""WITH {DOC} SELECT file_name, line_number,
            CAST(len(fields) AS INTEGER) AS width, {TEXT} FROM doc""",
        "explode_fields": f"""WITH {DOC} SELECT file_name, line_number,
            CAST(generate_subscripts(fields, 1) - 1 AS INTEGER) AS index,
            unnest(fields) AS field FROM doc""",
        "detail_text": f"""WITH {DOC} SELECT file_name, line_number, array_to_string(
              [concat('[', i - 1, ']', chr(9), fields[i], chr(13), chr(10))
               FOR i IN range(1, len(fields) + 1)], '') AS detail FROM doc""",
        "line_labels": f"""WITH {ORD} SELECT line_number,
            format('{{:,}}', line_number) AS label FROM ord""",
    } | (llm.oracle_sql() if llm else {})

"""The registered queries of this package, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.llm.bpe import round_trip
from tablog.llm.columns import documents, held_out
from tablog.llm.decontamination import LOWER, UPPER, WORDS, find_contamination
from tablog.llm.embedding import near_vectors
from tablog.llm.exact import exact_groups
from tablog.llm.manifest import merkle_manifest
from tablog.llm.minhash import near_groups
from tablog.llm.mixing import mix
from tablog.llm.near_lines import drop_near_lines
from tablog.llm.quality import fit_rules, score_quality
from tablog.llm.resampling import importance_scores
from tablog.llm.secrets import BASE, KINDS, EXAMPLE_OWNERS, LIVE_CHARACTERS, find_secrets, span_list
from tablog.llm.substring import drop_repeated
from tablog.llm.toxicity import fit_sentences, score_toxicity


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = drop_repeated(documents(spark, sf_dir))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


RANKS = "byte_bpe_multi_50k.tiktoken"


def token_digests(docs: DataFrame) -> DataFrame:
    """Every document's token ids, and what they decode to, as digests."""
    rows = round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
        count("status", "owner_specific").alias("n_owner_specific"),
    )


SECRETS_SQL = f"""
    WITH found AS (
      {" UNION ALL ".join(f"""
      SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, {least} AS least,
        generate_subscripts(regexp_extract_all(t, p, 1), 1) AS number,
        unnest(regexp_extract_all(t, p, 1)) AS gap, unnest(regexp_extract_all(t, p, 2)) AS hit,
        unnest(regexp_extract_all(t, p, 3)) AS value
      FROM (SELECT doc_id, source, coalesce(text, '') AS t,
              '(?s)(.*?){pattern.replace("'", "''")}' AS p FROM documents)"""
      for rank, (kind, (pattern, least)) in enumerate(KINDS.items()))}),
    placed AS (
      SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY number) AS stop
      FROM found),
    spans AS (
      SELECT *, CAST(stop - length(hit) AS BIGINT) AS start FROM placed
      WHERE length(value) >= least AND (rank < {len(BASE)} OR (
        regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS}))),
    alone AS (
      SELECT * FROM spans s WHERE rank < {len(BASE)} OR NOT EXISTS (
        SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.rank < {len(BASE)}
          AND b.start < s.stop AND b.stop > s.start)),
    owned AS (
      SELECT value, count(DISTINCT coalesce('s' || source, '')) AS owners FROM alone GROUP BY value),
    known AS (
      SELECT a.*, owners, kind || ':' || start || ':' || CAST(stop AS BIGINT) AS told
      FROM alone a JOIN owned USING (value)
      WHERE rank < {len(BASE)} OR owners < {EXAMPLE_OWNERS})
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
      count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256(coalesce(string_agg(told, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), ''))
        AS base_sha256,
      coalesce(string_agg(told, ',' ORDER BY start, rank), '') AS spans,
      count(*) FILTER (owners < {EXAMPLE_OWNERS}) AS n_owner_specific
    FROM documents d LEFT JOIN known USING (doc_id) GROUP BY d.doc_id"""


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_near_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_sentences(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        "predicted",
        F.size("sentences").alias("n_offending"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_scores(documents(spark, sf_dir), benchmark)


# Lower-cased words as SQL takes them, and CRC-32 byte by byte.
SQL_WORDS = f"""regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"""

RESAMPLING_SQL = f"""
    WITH tables AS (
      SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps
      FROM range(256) t(b)),
    found AS (
      SELECT true AS own, doc_id, unnest({SQL_WORDS}) AS word FROM documents
      UNION ALL SELECT false, NULL, unnest({SQL_WORDS}) FROM benchmark),
    words AS (
      SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM found)),
    hashed AS (
      SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
          range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
      FROM words, tables),
    counts AS (
      SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t
      FROM found JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
      SELECT bucket, CAST(floor(1000 * ln(
          ((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
          / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM counts),
    weights AS (
      SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
      FROM found JOIN hashed USING (word) JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
    scored AS (
      SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
          (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
          / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM documents d LEFT JOIN weights USING (doc_id)),
    placed AS (
      SELECT *, n_features >= 20 AS long,
        row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS eligible
      FROM scored)
    SELECT doc_id, n_features, weight, score,
      CASE WHEN long AND place <= eligible * 10 // 100 THEN place END AS rank
    FROM placed"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(documents(spark, sf_dir), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = f"""
    WITH items AS (
      SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS words FROM benchmark),
    sized AS (
      SELECT item, words, least(len(words), 10) AS size FROM items WHERE len(words) > 0),
    placed AS (
      SELECT item, size, words, unnest(range(len(words) - size + 1)) AS start FROM sized),
    windows AS (
      SELECT DISTINCT item, size, array_to_string(words[start + 1 : start + size], ' ') AS run FROM placed),
    texts AS (
      SELECT doc_id, {SQL_WORDS} AS words FROM documents),
    runs AS (
      SELECT doc_id, size, start, array_to_string(words[start + 1 : start + size], ' ') AS run
      FROM (SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS start
            FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
    met AS (
      SELECT doc_id, item, size, start FROM runs JOIN windows USING (size, run)),
    hit AS (
      SELECT doc_id, count(DISTINCT word) AS n
      FROM (SELECT doc_id, unnest(range(start, start + size)) AS word FROM met) GROUP BY doc_id),
    listed AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit,
      coalesce(listed.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      hit.n IS NOT NULL AS contaminated
    FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = merkle_manifest(documents(spark, sf_dir), changed={"text": text})

    def shown(digest: str) -> Column:
        return F.lower(F.hex(digest))

    return proven.select(
        "doc_id",
        shown("leaf").alias("leaf"),
        shown("subroot").alias("subroot"),
        shown("root").alias("root"),
        F.sha2(shown("proof"), 256).alias("proof_sha256"),
        shown("folded").alias("folded_root"),
        "verified",
    )


# Levels that the SQL of the manifest goes up: more than its trees can have.
SQL_LEVELS = 24


def _sql_tree(name: str) -> str:
    """Levels over the nodes ``{name}0`` (tree, node, n, digest) and ways up from ``{name}_up0``."""
    levels = []
    for k in range(SQL_LEVELS):
        levels.append(f"""
    {name}{k + 1} AS MATERIALIZED (
      SELECT tree, node // 3 AS node, (n + 2) // 3 AS n, CASE WHEN n > 1
        THEN sha256(string_agg(digest, '' ORDER BY node)) ELSE max(digest) END AS digest
      FROM {name}{k} GROUP BY tree, n, node // 3),
    {name}_up{k + 1} AS MATERIALIZED (
      SELECT u.tree, u.leaf, u.own // 3 AS own,
        u.proof || coalesce(string_agg(digest, '' ORDER BY node) FILTER (node <> own), '') AS proof,
        CASE WHEN n > 1 THEN sha256(string_agg(CASE WHEN node = own THEN seen ELSE digest END, '' ORDER BY node))
          ELSE seen END AS seen
      FROM {name}_up{k} u JOIN {name}{k} t ON t.tree = u.tree AND t.node // 3 = u.own // 3
      GROUP BY u.tree, u.leaf, u.own, u.proof, u.seen, n)""")
    return ",".join(levels)


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)


MANIFEST_SQL = f"""
    WITH leaves AS (
      SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS node,
        count(*) OVER (PARTITION BY source) AS n, sha256({_sql_leaf("text")}) AS leaf,
        sha256({_sql_leaf("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")}) AS seen
      FROM documents JOIN crcs USING (doc_id)),
    t0 AS (SELECT tree, node, n, leaf AS digest FROM leaves),
    t_up0 AS (SELECT tree, node AS leaf, node AS own, '' AS proof, seen FROM leaves),{_sql_tree("t")},
    s0 AS (SELECT 0 AS tree, tree AS node, count(*) OVER () AS n, digest FROM t{SQL_LEVELS}),
    s_up0 AS (SELECT 0 AS tree, (tree, leaf) AS leaf, tree AS own, proof, seen
      FROM t_up{SQL_LEVELS}),{_sql_tree("s")}
    SELECT doc_id, l.leaf, t{SQL_LEVELS}.digest AS subroot, r.digest AS root,
      sha256(u.proof) AS proof_sha256, u.seen AS folded_root, u.seen = r.digest AS verified
    FROM leaves l JOIN t{SQL_LEVELS} USING (tree)
      JOIN s_up{SQL_LEVELS} u ON u.leaf = (l.tree, l.node), s{SQL_LEVELS} r"""
MANIFEST_SQL = MANIFEST_SQL.replace("WITH leaves AS", """WITH tables AS (
      SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps
      FROM range(256) t(b)),
    crcs AS (
      SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295,
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) % 2 = 0 AS even
      FROM documents, tables),
    leaves AS""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_minhash": op2_minhash,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_secrets": op4_secrets,
        "op5_lines": op5_lines,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_embedding": op7_embedding,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_resampling": op11_resampling,
        "op12_decontamination": op12_decontamination,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secrets": SECRETS_SQL,
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op9_mixing": r"""
            WITH sized AS (
              SELECT doc_id, source, coalesce(text, '') AS t,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
              FROM documents),
            keyed AS (
              SELECT doc_id, source, size,
                -ln((CAST(('0x' || substr(md5(doc_id || '/1'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
                    / 4503599627370496::DOUBLE)
                / ((1000 + CASE WHEN length(t) = 0 THEN 0 ELSE CAST(floor(
                     (length(t) - len(regexp_extract_all(t, '[0-9!-/:-@\[-`{-~]'))) * 3000::DOUBLE
                     / length(t)) AS BIGINT) END) / 1000::DOUBLE) AS key
              FROM sized),
            sources AS (
              SELECT source, CAST(sum(size) AS BIGINT) AS total,
                ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w
              FROM sized GROUP BY source),
            levels AS (
              SELECT *, ((CAST(sum(total) OVER () AS BIGINT) * 1.5::DOUBLE)
                  - coalesce(sum(total * 2::DOUBLE) OVER (ORDER BY total * 2::DOUBLE / w, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY total * 2::DOUBLE / w, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM sources),
            targets AS (
              SELECT source, total,
                least(total * 2::DOUBLE, max(level) OVER () * w) AS target FROM levels),
            placed AS (
              SELECT k.doc_id, k.size, g.total, g.target,
                coalesce(CAST(floor(g.target / nullif(g.total, 0)) AS BIGINT), 0) AS epochs,
                sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, CAST(k.doc_id AS VARCHAR)
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
              FROM keyed k JOIN targets g ON k.source IS NOT DISTINCT FROM g.source)
            SELECT doc_id, size, total AS source_size, target,
              CAST(size * (epochs + CASE WHEN 2 * running - size <= 2 * (target - epochs * total)
                THEN 1 ELSE 0 END) AS BIGINT) AS taken
            FROM placed""",
        "op11_resampling": RESAMPLING_SQL,
        "op12_decontamination": CONTAMINATION_SQL,
        "op13_manifest": MANIFEST_SQL,
    }

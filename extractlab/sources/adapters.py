"""Stand-in fact tables, derived from the driver tables and not extracted from documents.

Each adapter is one SQL text that Spark and DuckDB both run, so a query and its oracle start from equal
facts. Within a text, ``{name}`` refers to another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    # Readings of one field by batch: job, batch, status, raw candidate, weakest probability, alternate.
    "readings": """
        SELECT l_orderkey AS job, CAST(seq AS INT) AS batch,
               CASE WHEN k = 0 THEN 'unreadable' WHEN k = 1 THEN 'ambiguous' WHEN k = 2 THEN 'invalid' WHEN k <= 4 THEN 'missing' ELSE 'extracted' END AS status,
               CASE WHEN k = 2 OR k > 4 THEN CASE WHEN (l_partkey + l_suppkey) % 6 = 0 THEN l_returnflag ELSE 'N' END END AS raw,
               CAST((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 1000 AS INT) AS mille,
               CASE WHEN CAST(round(l_tax * 100) AS INT) = 8 THEN 'X' WHEN (l_partkey + l_suppkey) % 6 = 0 THEN l_returnflag ELSE 'N' END AS alternate
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
                     (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 20 AS k FROM lineitem) t""",
    # Rows of one list by batch, with continuation flags and a source key.
    "list_rows": """
        SELECT l_orderkey AS job, CAST(seq AS INT) AS pos, l_partkey % 5 = 0 AS continues_next, l_suppkey % 5 = 0 AS continues_previous,
               CAST(l_linenumber % 3 AS INT) AS source_key, l_returnflag AS a, l_linestatus AS b
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem) t""",
    # Candidate scores (thousandths) of three profiles for each job.
    "matching": """
        SELECT o_orderkey AS job, CAST(o_orderkey % 3 AS INT) AS selected, CAST(ix AS INT) AS ix,
               CAST((o_orderkey * 37 + o_custkey * 11 + ix * 331) % 1000 AS INT) AS mille
        FROM orders CROSS JOIN (SELECT 0 AS ix UNION ALL SELECT 1 UNION ALL SELECT 2) c""",
    # Scored documents: truth and reading of one value, with the dimensions of a case.
    "cases": """
        SELECT d.doc_id AS case_id, d.lang AS script, d.source AS category, CASE WHEN l.quality = 1 THEN 'readable' ELSE 'difficult' END AS quality,
               CASE WHEN d.doc_id % 3 = 0 THEN 'pdf' WHEN d.doc_id % 3 = 1 THEN 'photo' ELSE 'image' END AS delivery_path,
               CASE WHEN d.doc_id % 7 = 0 THEN 'missing' ELSE 'extracted' END AS truth_status, CAST(d.n_chars % 10 AS INT) AS truth_value,
               CASE WHEN d.doc_id % 13 = 0 THEN 'failed' WHEN d.doc_id % 17 = 0 THEN 'timeout' ELSE 'completed' END AS execution_state,
               CASE WHEN d.doc_id % 11 = 0 THEN 'ambiguous' WHEN d.doc_id % 5 = 0 THEN 'missing' ELSE 'extracted' END AS status,
               CAST(CASE WHEN d.doc_id % 19 = 0 THEN (d.n_chars + 1) % 10 ELSE d.n_chars % 10 END AS INT) AS value
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    # Model calls of a case: kind, seconds (hundredths), pages.
    "calls": """
        SELECT event_id AS call_id, user_id AS case_id,
               CASE WHEN event_type = 'view' THEN 'extraction' WHEN event_type = 'click' THEN 'alternate' WHEN event_type = 'purchase' THEN 'matching' ELSE 'token_count' END AS kind,
               CAST(round(abs(value) * 100) AS BIGINT) AS centis, CAST(1 + event_id % 3 AS INT) AS pages FROM events""",
    # Traces of jobs: how each began and ended, and its batches, read once or twice (times in hundredths).
    "traces": """
        SELECT o_orderkey AS job, o_custkey % 300 AS setup, n + CASE WHEN o_orderkey % 31 = 5 THEN 1 ELSE 0 END AS pages, o_orderkey % 9 = 0 AS manual,
               CASE WHEN o_orderkey % 37 = 3 THEN NULL WHEN o_orderkey % 29 = 4 THEN 'no_profile' ELSE 'matched' END AS matching,
               CASE WHEN o_custkey % 19 = 0 THEN 'runtime_timeout' WHEN o_custkey % 23 = 0 THEN 'damaged_input' WHEN o_custkey % 41 = 0 THEN 'runtime_failure' END AS failure,
               o_custkey % 500 AS phase, 900 + o_orderkey % 4000 AS elapsed
        FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c ON l_orderkey = o_orderkey""",
    "trace_batches": """
        SELECT job, batch, 1 AS pages, 100 + mille AS first_s, mille % 97 = 0 AS rejects, mille % 53 <> 0 AS attempted, mille % 400 AS second_s,
               CASE WHEN mille % 61 = 0 THEN 'runtime_failure' WHEN mille % 67 = 0 THEN 'recognition_contract_violation' END AS second_error, mille % 71 = 0 AS second_rejects FROM {readings} r""",
    # Owners' updates in order: seconds since the epoch, kind, message and generation numbers.
    "updates": """
        SELECT event_id, user_id AS owner, {seconds} AS t, event_type AS kind, event_id % 997 AS message_id, CAST(event_id % 4 AS INT) AS generation,
               CAST(user_id % 3 AS INT) AS current_generation FROM events""",
    # Stored profiles and change requests against them.
    "profiles": """
        SELECT p_partkey AS id, p_partkey % 50 AS owner, CAST(1 + p_partkey % 4 AS INT) AS version, p_name AS name, p_size AS created FROM part""",
    "requests": """
        SELECT DISTINCT l_partkey AS id, CASE WHEN l_linenumber = 7 THEN (l_partkey + 1) % 50 ELSE l_partkey % 50 END AS owner,
               CAST(1 + (l_partkey + l_linenumber) % 4 AS INT) AS expected FROM lineitem""",
    # Documents by split, with content identity.
    "splits": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'benchmark' WHEN doc_id % 3 = 0 THEN 'tuning' ELSE 'development' END AS split, text FROM documents""",
}
#: How many texts that are parsed a task gets.
TEXTS = 50_000
#: How many lines a task sorts, whatever the table's size.
LINES = 200_000
#: The one dialect difference that an adapter needs.
SECONDS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP)) div 1000000", "duckdb": "epoch_us(ts) // 1000000"}


def expanded(sql: str, dialect: str = "duckdb") -> str:
    """SQL with the adapters that it names put in as subqueries."""
    while found := re.search(r"\{([a-z_]+)\}", sql):
        name = found[1]
        inner = SECONDS[dialect] if name == "seconds" else f"({ADAPTERS[name]})"
        sql = sql.replace(found[0], inner)
    return sql


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's table."""
    sql = expanded(ADAPTERS[name], "spark")
    used = {t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    tables = {t: table(spark, sf_dir, t) for t in used}
    if "PARTITION BY l_orderkey" in sql:  # windows over an order's lines, and what follows them by job
        tables["lineitem"] = spread(tables["lineitem"], LINES, "l_orderkey")
    return spark.sql(sql, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(df: DataFrame, rows: int) -> int:
    """How many tasks get about so many rows of a table each, at least the session's number. The number of rows comes from the files' footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A table dealt out over tasks of about so many rows each, by its keys: a small file is a single task, whatever each row costs, and
    of a fixed number of partitions each grows with its table."""
    return df.repartition(shares(df, rows), *keys)


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A SQL text over some tables, whose names stand in braces; all other braces are its own. With the tables' keys they are spread
    over tasks, for texts that cost much more to read than to make."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    tables = {name: table(spark, sf_dir, name) for name in names}
    return spark.sql(text, **(tables | {name: spread(tables[name], TEXTS, key) for name, key in zip(names, keys)}))

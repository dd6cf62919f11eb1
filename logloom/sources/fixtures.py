"""Deterministic log tables derived from the driver's parquet tables.

``log_view`` turns ``events``, ``orders`` and ``lineitem`` into log messages
with known ground-truth templates; ``labelled_examples`` gives one labelled
example (named ``{slot}`` template) per message branch. The SQL is the same
text for Spark and DuckDB, so the oracle and the engine read identical input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# One row per message branch: content, <*> truth template, {label} template.
_BRANCHES_SQL = """
SELECT 'events' AS system, event_id AS seq, event_type AS branch,
  CASE event_type
    WHEN 'view'   THEN concat('User ', user_id, ' viewed page /item/', event_id % 50, '/detail')
    WHEN 'signup' THEN concat('Accepted signup for user', user_id, '@example.com from 10.', user_id % 256, '.', event_id % 256, '.7 port ', 1024 + event_id % 5000)
    WHEN 'error'  THEN concat('Task failed: uid=', user_id, ' code=', event_id % 13, ' retry ', event_id % 4)
    WHEN 'click'  THEN concat('Button ', CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'save' ELSE 'share' END, ' clicked in session 0x', user_id)
    ELSE concat('Order ', event_id, ' paid, total ', CAST(round(value * 100) AS BIGINT), ' cents') END AS Content,
  CASE event_type
    WHEN 'view'   THEN 'User <*> viewed page <*>'
    WHEN 'signup' THEN 'Accepted signup for <*> from <*> port <*>'
    WHEN 'error'  THEN 'Task failed: <*> <*> retry <*>'
    WHEN 'click'  THEN 'Button <*> clicked in session <*>'
    ELSE 'Order <*> paid, total <*> cents' END AS EventTemplate,
  CASE event_type
    WHEN 'view'   THEN 'User {user_id} viewed page {file_path}'
    WHEN 'signup' THEN 'Accepted signup for {email} from {ip_address} port {port}'
    WHEN 'error'  THEN 'Task failed: uid={user_id} code={error_code} retry {attempt}'
    WHEN 'click'  THEN 'Button {button} clicked in session {hex_code}'
    ELSE 'Order {order_id} paid, total {amount} cents' END AS Labelled
FROM {events}
UNION ALL
SELECT 'orders', o_orderkey, 'status',
  concat('Order ', o_orderkey, ' for customer ', o_custkey, ' moved to status ', o_orderstatus, ' priority ', o_orderpriority),
  'Order <*> for customer <*> moved to status <*> priority <*>',
  'Order {order_id} for customer {customer_id} moved to status {status} priority {priority}'
FROM {orders}
UNION ALL
SELECT 'shipping',
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice),
  CASE WHEN l_returnflag = 'R' THEN 'return' WHEN l_linestatus = 'O' THEN 'load' ELSE 'heartbeat' END,
  CASE WHEN l_returnflag = 'R' THEN concat('Return of line ', l_linenumber, ' for order ', l_orderkey, ' accepted')
       WHEN l_linestatus = 'O' THEN concat('Shipment ', l_orderkey, ':', l_linenumber, ' loaded at /dock/', l_suppkey, '/bay')
       ELSE 'Carrier heartbeat received' END,
  CASE WHEN l_returnflag = 'R' THEN 'Return of line <*> for order <*> accepted'
       WHEN l_linestatus = 'O' THEN 'Shipment <*> loaded at <*>'
       ELSE 'Carrier heartbeat received' END,
  CASE WHEN l_returnflag = 'R' THEN 'Return of line {line_number} for order {order_id} accepted'
       WHEN l_linestatus = 'O' THEN 'Shipment {shipment_id} loaded at {file_path}'
       ELSE 'Carrier heartbeat received' END
FROM {lineitem}
"""

LOG_VIEW_SQL = "SELECT system, seq, Content, EventTemplate FROM ({branches}) b"

EXAMPLES_SQL = """
SELECT system, seq, Content, Labelled AS EventTemplate FROM (
  SELECT *, row_number() OVER (PARTITION BY system, branch ORDER BY seq) AS rn
  FROM ({branches}) b) x
WHERE rn = 1
"""

# Text tables as log messages: (system, seq, Content).
TEXT_VIEW_SQL = """
SELECT 'documents' AS system, doc_id AS seq, text AS Content FROM {documents}
UNION ALL
SELECT 'conversations', conv_id * 1000 + turn, text FROM {conversations}
UNION ALL
SELECT 'pages', page_id, html FROM {pages}
"""


def branches_sql(events="events", orders="orders", lineitem="lineitem") -> str:
    return _BRANCHES_SQL.replace("{events}", events).replace("{orders}", orders).replace("{lineitem}", lineitem)


def log_view_sql(**names) -> str:
    """DuckDB/ANSI text of the log view over tables named as given."""
    return LOG_VIEW_SQL.replace("{branches}", branches_sql(**names))


def examples_sql(**names) -> str:
    return EXAMPLES_SQL.replace("{branches}", branches_sql(**names))


def text_view_sql(documents="documents", conversations="conversations", pages="pages") -> str:
    return (TEXT_VIEW_SQL.replace("{documents}", documents)
            .replace("{conversations}", conversations).replace("{pages}", pages))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's cores when a scan yields fewer
    partitions than cores (one-row-group files). Large inputs already split
    into many scan tasks and pass through untouched, so no shuffle is added
    at scale; per-row regex work is CPU-bound, so small scans gain from it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _spark_sql(spark: SparkSession, sf_dir: str, text: str, names) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in names}
    # spark.sql substitutes {name} with the DataFrame; literal braces are escaped.
    return spark.sql(text, **frames)


def _spark_text(sql: str, names) -> str:
    out = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        out = out.replace("{{" + n + "}}", "{" + n + "}")
    return out


_LOG_TABLES = ("events", "orders", "lineitem")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``system, seq, Content, EventTemplate`` over events, orders, lineitem."""
    text = LOG_VIEW_SQL.replace("{branches}", _BRANCHES_SQL)
    return _spark_sql(spark, sf_dir, _spark_text(text, _LOG_TABLES), _LOG_TABLES)


def labelled_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``system, seq, Content, EventTemplate, Labelled`` for every message."""
    text = "SELECT system, seq, Content, EventTemplate, Labelled FROM ({branches}) b".replace("{branches}", _BRANCHES_SQL)
    return _spark_sql(spark, sf_dir, _spark_text(text, _LOG_TABLES), _LOG_TABLES)


def labelled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First message by ``seq`` of every branch, with its ``{label}`` template."""
    text = EXAMPLES_SQL.replace("{branches}", _BRANCHES_SQL)
    return _spark_sql(spark, sf_dir, _spark_text(text, _LOG_TABLES), _LOG_TABLES)


class StoredLogs(NamedTuple):
    """The message branches, built and stored once for a query that reads them several
    times (each build sorts all of lineitem); the views are the same SQL over that table."""

    spark: SparkSession
    branches: DataFrame

    def _over(self, sql: str) -> DataFrame:
        text = sql.replace("{branches}", "SELECT * FROM {branches}")
        return self.spark.sql(text, branches=self.branches)

    def log_view(self) -> DataFrame:
        return self._over(LOG_VIEW_SQL)

    def labelled_examples(self) -> DataFrame:
        return self._over(EXAMPLES_SQL)


def stored_logs(spark: SparkSession, sf_dir: str) -> StoredLogs:
    rows = _spark_sql(spark, sf_dir, _spark_text(_BRANCHES_SQL, _LOG_TABLES), _LOG_TABLES)
    return StoredLogs(spark, written(rows, "branches"))


def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``system, seq, Content`` over documents, conversations and pages."""
    names = ("documents", "conversations", "pages")
    return _spark_sql(spark, sf_dir, _spark_text(TEXT_VIEW_SQL, names), names)

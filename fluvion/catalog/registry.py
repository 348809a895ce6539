"""Registration of queries with their SQL, and the SQL form of the logical tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fluvion.session import use_utc
from fluvion.sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL form of the bindings in fluvion.sources.bindings.
BINDINGS: dict[str, str] = {
    "b_obs": """SELECT event_id AS id, user_id AS station, event_type AS variable, value,
        date_trunc('hour', ts) AS valid_time,
        date_trunc('hour', ts) + to_hours(CAST(event_id % 7 AS INTEGER)) AS available_at,
        date_trunc('hour', ts) + to_hours(CAST(event_id % 7 AS INTEGER)) AS retrieved_at,
        CAST(row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id) - 1 AS INTEGER) AS revision_seq
        FROM events""",
    "b_lvl": "SELECT * FROM (VALUES ('action',1,CAST(50 AS DOUBLE)),('minor',2,100),('moderate',3,200),('major',4,400)) AS v(category, ord, lvl)",
    "b_dated": """SELECT o_custkey AS station, ['action', 'minor', 'moderate', 'major'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS category, [50, 100, 200, 400][CAST(o_orderkey % 4 AS INTEGER) + 1] * (0.75 + (o_orderkey % 8) / 16.0::DOUBLE) AS level,
  TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 AS INTEGER)) AS effective_from, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 + o_orderkey % 48 AS INTEGER)) AS known_at, o_orderkey AS id FROM orders""",
    "b_fast": """SELECT user_id % 10 AS station, time_bucket(INTERVAL 15 MINUTE, ts) AS t, max(value) AS v
        FROM events GROUP BY ALL""",
    "b_day": "SELECT l_suppkey % 10 AS site, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "b_dayall": "SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "b_rows": """SELECT l_suppkey % 10 AS site, CAST(l_shipdate AS DATE) AS day, l_quantity AS quantity,
        CASE WHEN l_linestatus = 'F' THEN 'Approved' ELSE 'Provisional' END AS approval,
        (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS file_pos FROM lineitem""",
    "b_run": """SELECT o_orderkey AS run_id, o_custkey AS fp, o_orderpriority AS product, o_orderdate AS issued_at,
        o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS available_at FROM orders""",
    "b_val": """SELECT r.*, l.l_linenumber AS lead, l.l_partkey AS part, l.l_suppkey % 6 AS member,
        l.l_extendedprice AS flow, l.l_quantity AS stage,
        r.issued_at + to_hours(l.l_linenumber * 6) AS valid_time
        FROM b_run r JOIN lineitem l ON l.l_orderkey = r.run_id""",
    "b_feat": """SELECT feature, scope, valid_time, value, id,
        CASE WHEN day(valid_time) % 2 = 0 THEN '24h' END AS win,
        valid_time + to_hours(CAST(id % 48 AS INTEGER)) AS available_at
        FROM (SELECT event_type AS feature, user_id % 10 AS scope, date_trunc('day', ts) AS valid_time,
              max(value) AS value, max(event_id) AS id FROM events GROUP BY ALL)""",
    "b_cell": """SELECT vec_id AS field, label AS grid_hash, CAST(i - 1 AS INTEGER) AS flat_index,
        round(CAST(embedding[i] AS DOUBLE) * 1000) + 0.0 AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "b_gap": "SELECT * FROM b_cell WHERE NOT (field % 9 = 0 AND flat_index >= 60)",
    "b_masktotal": "SELECT basin, count(*) AS n, sum(weight) AS w FROM b_mask GROUP BY basin",
    "b_mask": """SELECT * FROM (SELECT CAST(b AS INTEGER) AS basin, CAST(f AS INTEGER) AS flat_index, ((f * 7 + b) % 10) / 10.0::DOUBLE AS weight
        FROM range(0, 6) AS x(b), (SELECT DISTINCT flat_index AS f FROM b_cell)) WHERE weight > 0""",
    "b_alert": """SELECT concat_ws('-', 'alert', conv_id, turn) AS alert_id, conv_id, turn, sent,
        sent + to_hours(CAST(turn AS INTEGER)) AS available_at,
        CASE WHEN turn % 3 <> 0 THEN sent + INTERVAL 10 DAY END AS ends,
        CASE WHEN turn % 2 = 0 THEN sent + INTERVAL 20 DAY END AS expires,
        CASE WHEN role = 'system' THEN 'Test' ELSE 'Actual' END AS status,
        CASE WHEN turn = 5 THEN 'Cancel' ELSE 'Alert' END AS message_type,
        CASE WHEN turn > 0 AND turn % 2 = 1 THEN concat_ws('-', 'alert', conv_id, turn - 1) END AS reference,
        printf('WAC%03d', conv_id % 25) AS ugc1, printf('WAC%03d', (turn * 3) % 25) AS ugc2
        FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 1800) AS sent FROM conversations)""",
}


# Both sides add this before rounding to six decimals, so that the last bit of a sum taken in another
# order cannot tip an exact tie.
TIE = 1e-9


def with_ties(sql: str) -> str:
    """The SQL with the tie term inside each ``round(..., 6)``; a final 6 of any other call stays as it is."""
    out, at = [], 0
    for m in re.finditer(r", 6\)", sql):
        depth, i = 1, m.start()
        while depth and i:
            i -= 1
            depth += {")": 1, "(": -1}.get(sql[i], 0)
        out.append(sql[at : m.start()] + (f" + {TIE}" if re.search(r"\bround$", sql[:i]) else ""))
        at = m.start()
    return "".join(out) + sql[at:]


def with_bindings(sql: str) -> str:
    """Prefix the SQL with the logical tables it names, in dependency order."""
    sql = with_ties(sql)
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bb_[a-z]+\b", text):
            if name in BINDINGS and name not in needed:
                need(BINDINGS[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def presentable(df: DataFrame) -> DataFrame:
    """Plain values for comparison: instants and days as text, doubles at six decimals."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + TIE, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.concat_ws("|", c.cast("array<string>"))
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with the SQL that must agree with it."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(Tables(use_utc(spark), sf_dir)))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_bindings(sql)
        return fn

    return register

"""Registration of queries, and the adapters that give the tables the shapes operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E_SQL = """select user_id as k, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as v,
  case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 0 end as state,
  event_type as label, event_id from {events}"""
L_SQL = """select l_suppkey as k, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as t,
  l_quantity as x, l_extendedprice as y1, l_discount as y2, l_tax as y3 from {lineitem}"""
C_SQL = """select conv_id as k, turn, case role when 'user' then 1 when 'assistant' then 2 else 0 end as speaker,
  (sum(length(text)) over (partition by conv_id order by turn) - length(text)) / 100e0 as start_s,
  sum(length(text)) over (partition by conv_id order by turn) / 100e0 as end_s from {conversations}"""
#: Paired conditions: subject, condition, channel and a metric.
P_SQL = "select l_suppkey as subject, l_returnflag as condition, cast(l_linenumber as bigint) as channel, avg(l_extendedprice) as v from {lineitem} group by l_suppkey, l_returnflag, l_linenumber"
_M_SPARK = "select vec_id, label, cast(pos as bigint) as ch, cast(v as double) as v from {embeddings} lateral view posexplode(embedding) e as pos, v"
_M_DUCK = "select vec_id, cast(label as bigint) as label, i - 1 as ch, cast(embedding[i] as double) as v from embeddings, (select unnest(range(1, 65)) as i)"

#: The adapters as DuckDB common table expressions.
E, L, C, P = (f"{n} as ({s.format(events='events', lineitem='lineitem', conversations='conversations')})" for n, s in (("E", E_SQL), ("L", L_SQL), ("C", C_SQL), ("P", P_SQL)))
M = f"M as ({_M_DUCK})"


class Tables:
    """The tables of a folder, and the adapters over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def adapt(self, sql: str, table: str) -> DataFrame:
        return self.spark.sql(sql, **{table: self[table]})

    @property
    def e(self) -> DataFrame:
        return self.adapt(E_SQL, "events").selectExpr("k", "cast(t as bigint) as t", "v", "cast(state as bigint) as state", "label", "event_id")

    @property
    def l(self) -> DataFrame:  # noqa: E743
        return self.adapt(L_SQL, "lineitem").selectExpr("cast(k as bigint) as k", "cast(t as bigint) as t", "x", "y1", "y2", "y3")

    @property
    def c(self) -> DataFrame:
        return self.adapt(C_SQL, "conversations").selectExpr("k", "turn", "cast(speaker as bigint) as speaker", "start_s", "end_s")

    @property
    def m(self) -> DataFrame:
        return self.adapt(_M_SPARK, "embeddings").selectExpr("vec_id", "cast(label as bigint) as label", "ch", "v")

    @property
    def p(self) -> DataFrame:
        return self.adapt(P_SQL, "lineitem").selectExpr("cast(subject as bigint) as subject", "condition", "cast(channel as bigint) as channel", "v")


def r(x: str, decimals: int = 6) -> str:
    """So many decimals in DuckDB, without a negative zero."""
    return f"round({x}, {decimals}) + 0.0"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name, with the SQL of its result if there is one."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return add

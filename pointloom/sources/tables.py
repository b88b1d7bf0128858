"""Points from tables: any table by a column mapping, and the room fixture computed from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered, parts_of
from ..session import written

POINT_COLUMNS = ["point_idx", "x", "y", "z", "intensity", "classification", "red", "green", "blue"]

#: A room of 3 m with one window and one groove strip: the rows by number, which only DuckDB takes from this text, and what Spark and DuckDB both make of them.
_NUMBERED = """
with li as (
  select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as point_idx,
         count(*) over () as n
  from {lineitem}),
"""
_MADE_OF_THEM = """p as (select *, cast(floor(sqrt(n / 4.2E0)) as bigint) as m from li),
q as (select *, cast(floor(m * 0.78E0) as bigint) as mz, 3.0E0 / m as h from p),
r as (select *, case when point_idx < m*m then 0
                     when point_idx < m*m + 4*m*mz
                       then 1 + cast(floor((point_idx - m*m) / cast(m*mz as double)) as bigint)
                     else 5 end as surf from q),
t as (select *, case when surf = 0 then point_idx else (point_idx - m*m) % (m*mz) end as k from r),
g as (select *, ((k % m) + 0.5E0) * h as a,
             (floor(k / cast(m as double)) + 0.5E0) * h as b,
             (l_discount - 0.05E0) * 0.08E0 as e from t),
j as (select *, case when surf = 2 and a between 0.5E0 and 2.5E0 and b between 1.0E0 and 1.2E0
                     then 0.010E0 else e end as off from g)
select cast(point_idx as bigint) as point_idx, cast(surf as int) as surf,
  case surf when 3 then off when 4 then 3.0E0 + off when 5 then l_quantity * 0.06E0 else a end as x,
  case surf when 0 then b when 1 then off when 2 then 3.0E0 + off
            when 5 then l_tax * 37.5E0 else a end as y,
  case surf when 0 then off when 5 then 2.0E0 + e else b end as z,
  cast(l_quantity * 6 as int) as intensity,
  l_linenumber as classification,
  cast(floor(l_extendedprice / 500.0E0) as int) as red,
  cast(floor(l_discount * 1000) as int) as green,
  cast(floor(l_tax * 1000) as int) as blue
from j
"""
ROOM_SQL = _NUMBERED + _MADE_OF_THEM + """where not (surf = 1 and a between 1.0E0 and 2.0E0 and b between 0.9E0 and 1.9E0)
"""
#: The same on the columns made, since on that wall x is a and z is b. Spark would otherwise carry all that a and b are made of into one condition, too long to be compiled.
_NO_WINDOW = "not (surf = 1 and x between 1.0E0 and 2.0E0 and z between 0.9E0 and 1.9E0)"
#: The order of the rows.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture, made once for a session and input. Its row numbers need one order of the whole table, found by ranges; real scans carry point_idx."""
    known = spark.sparkContext.__dict__.setdefault("_pointloom_rooms", {})
    if sf_dir not in known:
        table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(ORDER)
        n = table.count()
        shown = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        rows = numbered(table, ORDER, "place", shown, parts_of(table, n))
        # The number of rows is a literal, so that all sizes of the room are; no row shows the one of an empty table.
        li = rows.select("*", (F.col("place") - 1).alias("point_idx"), F.lit(n or 5).cast("long").alias("n"))
        known[sf_dir] = written(spark.sql("with " + _MADE_OF_THEM.replace("from li)", "from {li})", 1), li=li), "room").where(_NO_WINDOW)
    return known[sf_dir]


def points(table: DataFrame, **mapping: str | Column) -> DataFrame:
    """Any table as points: ``points(df, x="lon", y="lat", z=F.lit(0.0))``; columns without a mapping or of that name are null."""
    kinds = {"point_idx": "long", "intensity": "int", "classification": "int", "red": "int", "green": "int", "blue": "int"}

    def column(name: str) -> Column:
        source = mapping.get(name, name)
        if isinstance(source, str):
            source = F.col(source) if source in table.columns else F.lit(None)
        return source.cast(kinds.get(name, "double")).alias(name)

    return table.select(*[column(c) for c in POINT_COLUMNS])

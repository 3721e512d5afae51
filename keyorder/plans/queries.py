"""Driver queries over the reference tables and the DuckDB SQL of each.

The driver compares rows without regard to their order, so every query shows
order in a value: a position, or a fold that depends on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyorder.functions import desc
from keyorder.operators import (
    fold_from_keyed_start,
    fold_from_keyed_start_py,
    map_with_resource,
    map_with_resource_py,
    sorted_fold,
    sorted_fold_py,
    sorted_groups,
    sorted_join,
)
from keyorder.sources import table

LINE = ["l_linenumber", "l_partkey", "l_suppkey"]
MODULUS = 1_000_003


#: Orders that differ from the natural one of ``LINE``, made when a query runs (columns need a session), and their SQL.
ORDERS: dict[str, Callable[[], list | None]] = {
    "natural": lambda: None,
    "by_expr": lambda: [-F.col("l_extendedprice"), *LINE],
    "desc": lambda: [desc("l_extendedprice"), desc("l_linenumber"), "l_partkey", "l_suppkey"],
    "desc_line": lambda: [desc("l_linenumber"), "l_partkey", "l_suppkey"],
}
ORDERS_SQL = {
    "natural": "l_linenumber, l_partkey, l_suppkey",
    "by_expr": "-l_extendedprice, l_linenumber, l_partkey, l_suppkey",
    "desc": "l_extendedprice DESC NULLS LAST, l_linenumber DESC, l_partkey, l_suppkey",
    "desc_line": "l_linenumber DESC, l_partkey, l_suppkey",
}


def _by_count(_: str) -> dict:
    return {"num_partitions": 7}


def _by_id(key: str) -> dict:
    """The caller's own partitioner: a partition id that depends on the key."""
    return {"num_partitions": 3, "partition_id": F.pmod(key, F.lit(3)).cast("int")}


#: Suffix of a query's name: how its result is placed, given its key.
PLACED: dict[str, Callable[[str], dict]] = {"": lambda _: {}, "_n": _by_count, "_placed": _by_id}


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _positions(groups: DataFrame, key: str, *fields: str) -> DataFrame:
    rows = groups.select(key, F.posexplode("values").alias("pos", "v"))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), *(F.col("v")[f].alias(f) for f in fields))


def _groups(order: list | None, values: list[str], shown: list[str], where: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        return _positions(sorted_groups(events, "user_id", order, values=values, **PLACED[where]("user_id")), "user_id", *shown)

    return query


def _line_groups(order: str, where: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        return _positions(sorted_groups(lines, "l_orderkey", ORDERS[order](), values=LINE, **PLACED[where]("l_orderkey")), "l_orderkey", *LINE)

    return query


def _hash_step(acc, v):
    """For columns and for Python values alike."""
    return (acc * 31 + v["l_partkey"] * 7 + v["l_linenumber"]) % MODULUS


def _fold(order: str, where: str = "", fold: Callable = sorted_fold) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        return fold(lines, "l_orderkey", ORDERS[order](), 1, _hash_step, "bigint", values=LINE, into="h", **PLACED[where]("l_orderkey"))

    return query


def fold_floor_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn(
        "cents", F.when(F.col("event_type") == "purchase", _cents("value")).otherwise(-_cents("value"))
    )
    step = lambda acc, v: F.greatest(acc + v["cents"], F.lit(0))
    return sorted_fold(events, "user_id", ["ts", "event_id"], 0, step, "bigint", values=["cents", "event_id"], into="balance")


def fold_funnel_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs of view, click, purchase, by a Python state machine: 10 x completed + stage."""
    stages = ("view", "click", "purchase")

    def step(acc: int, v: dict) -> int:
        done, stage = divmod(acc, 10)
        if v["event_type"] == stages[stage]:
            stage += 1
        return 10 * (done + 1) if stage == 3 else 10 * done + stage

    events = table(spark, sf_dir, "events")
    return sorted_fold_py(events, "user_id", ["ts", "event_id"], 0, step, "bigint", values=["ts", "event_id", "event_type"], into="funnel")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (_cents("o_totalprice") % MODULUS).alias("start"))


def _with_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of orders that exist; an item without its order would be an error."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(_starts(spark, sf_dir).select("l_orderkey"), "l_orderkey", "left_semi")


def _keyed_fold(order: str, where: str = "", fold: Callable = fold_from_keyed_start) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, starts = _with_starts(spark, sf_dir), _starts(spark, sf_dir)
        place = PLACED[where]("l_orderkey")
        return fold(lines, starts, "l_orderkey", ORDERS[order](), lambda acc, v: (acc * 31 + v["l_partkey"]) % MODULUS, "bigint", start="start", values=LINE, into="h", **place)

    return query


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each nation that has customers, as a resource without values is an error."""
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    names = table(spark, sf_dir, "nation").join(used, "n_nationkey", "left_semi")
    return names.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.create_map(F.lit(0), F.col("n_regionkey").cast("bigint"), F.lit(1), F.col("n_nationkey").cast("bigint") * 10).alias("lookup"),
    )


_RICHEST_SQL = "CAST(round(c_acctbal * 100) AS BIGINT) DESC NULLS LAST, c_custkey"
_FOUND = "struct<c_custkey:bigint,x:bigint>"


def _richest() -> list:
    """Order of the values of a key where a query gives one."""
    return [desc("cents"), "c_custkey"]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", _cents("c_acctbal").alias("cents"))


def _with_place(found: DataFrame, key: str) -> DataFrame:
    """``found`` with the place of each row among those of its key, as the operator put it."""
    at = found.withColumn("at", F.monotonically_increasing_id())
    return at.withColumn("pos", F.col("at") - F.min("at").over(Window.partitionBy(key))).drop("at")


def _resource(prepared: bool, ordered: bool = False, where: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """Each customer's number plus what its nation's map, or the prepared map of negated values, has for it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def op(r: Column, v: Column) -> Column:
            lookup = r if prepared else r["lookup"]
            return F.struct(v["c_custkey"].alias("c_custkey"), (lookup[(v["c_custkey"] % 2).cast("int")] + v["c_custkey"]).alias("x"))

        found = map_with_resource(
            _customers(spark, sf_dir), _nations(spark, sf_dir), "c_nationkey", _richest() if ordered else ["c_custkey"], op,
            prepare=(lambda r: F.transform_values(r["lookup"], lambda _, x: -x)) if prepared else None,
            values=["c_custkey", "cents"], into="r", **PLACED[where]("c_nationkey"),
        )
        return _with_place(found.select("c_nationkey", F.col("r.c_custkey").alias("c_custkey"), F.col("r.x").alias("x")), "c_nationkey")

    return query


def _resource_sql(prepared: bool, ordered: bool = False) -> str:
    return f"""
SELECT c_nationkey, c_custkey,
  {"-" if prepared else ""} CASE c_custkey % 2 WHEN 0 THEN n_regionkey::BIGINT ELSE n_nationkey::BIGINT * 10 END + c_custkey AS x,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY {_RICHEST_SQL if ordered else "c_custkey"}) - 1 AS pos
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def resource_prepared_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare = lambda r: {k: -x for k, x in r["lookup"]}
    op = lambda r, v: {"c_custkey": v["c_custkey"], "x": r[v["c_custkey"] % 2] + v["c_custkey"]}
    found = map_with_resource_py(
        _customers(spark, sf_dir), _nations(spark, sf_dir), "c_nationkey", ["c_custkey"], op, _FOUND, prepare=prepare, values=["c_custkey", "cents"], into="r"
    )
    return _with_place(found.select("c_nationkey", "r.c_custkey", "r.x"), "c_nationkey")


def _curried(ordered: bool = False, where: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """Python resources count the values they have seen, so the order of values shows."""

    def ready(r: dict):
        seen = iter(range(1 << 62))
        base = dict(r["lookup"])[1]
        return lambda v: {"c_custkey": v["c_custkey"], "x": base * 100_000 + next(seen)}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = map_with_resource_py(
            _customers(spark, sf_dir), _nations(spark, sf_dir), "c_nationkey", _richest() if ordered else None, ready, _FOUND,
            curried=True, values=["c_custkey", "cents"], into="r", **PLACED[where]("c_nationkey"),
        )
        return found.select("c_nationkey", F.col("r.c_custkey").alias("c_custkey"), F.col("r.x").alias("x"))

    return query


def _curried_sql(ordered: bool = False) -> str:
    return f"""
SELECT c_nationkey, c_custkey, c_nationkey::BIGINT * 10 * 100000
  + row_number() OVER (PARTITION BY c_nationkey ORDER BY {_RICHEST_SQL if ordered else "c_custkey"}) - 1 AS x
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")),
        table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v")),
        table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("v")),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v")),
    ]


def _join(how: str, n: int, where: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = sorted_join(how, *_sides(spark, sf_dir)[:n], keys="k", **PLACED[where]("k"))
        return _with_place(found.select("k", *(F.col(c)["v"].alias(f"{c}v") for c in "abcd"[:n])), "k")

    return query


JOINS = [(how, n, where) for how in ("full", "inner", "left", "right") for n in (2, 3, 4) for where in PLACED]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "sorted_groups": _groups(["ts", "event_id"], ["ts", "event_id"], ["event_id"]),
        **{f"sorted_groups_natural{w}": _groups(None, ["event_type", "event_id"], ["event_type", "event_id"], w) for w in PLACED},
        **{f"sorted_groups_by_expr{w}": _line_groups("by_expr", w) for w in PLACED},
        "sorted_groups_desc": _line_groups("desc"),
        "sorted_groups_desc_n": _line_groups("desc", "_n"),
        "sorted_groups_placed": _groups(["ts", "event_id"], ["ts", "event_id"], ["event_id"], "_placed"),
        **{f"fold_hash{w}": _fold("natural", w) for w in PLACED},
        **{f"fold_hash_py{w}": _fold("natural", w, sorted_fold_py) for w in ("", "_placed")},
        **{f"fold_by_expr{w}": _fold("by_expr", w) for w in PLACED},
        "fold_desc": _fold("desc"),
        "fold_desc_n": _fold("desc", "_n"),
        "fold_floor_balance": fold_floor_balance,
        "fold_funnel_py": fold_funnel_py,
        **{f"fold_keyed_start{w}": _keyed_fold("natural", w) for w in PLACED},
        "fold_keyed_start_desc": _keyed_fold("desc_line"),
        "fold_keyed_start_desc_n": _keyed_fold("desc_line", "_n"),
        **{f"fold_keyed_start_py{w}": _keyed_fold("natural", w, fold_from_keyed_start_py) for w in ("", "_placed")},
        **{f"resource_curried{w}": _curried(where=w) for w in PLACED},
        **{f"resource_prepared{w}": _resource(True, where=w) for w in PLACED},
        **{f"resource_map{w}": _resource(False, where=w) for w in PLACED},
        **{f"resource_curried_sorted{w}": _curried(True, w) for w in PLACED},
        **{f"resource_prepared_sorted{w}": _resource(True, True, w) for w in PLACED},
        **{f"resource_map_sorted{w}": _resource(False, True, w) for w in PLACED},
        "resource_prepared_py": resource_prepared_py,
        **{f"join_{how}_{n}{w}": _join(how, n, w) for how, n, w in JOINS},
    }


def _groups_sql(select: str, source: str, key: str, order: str) -> str:
    return f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS BIGINT) AS pos, {select} FROM {source}"


def _fold_sql(order: str) -> str:
    return f"""
SELECT l_orderkey, list_reduce(list(l_partkey * 7 + l_linenumber ORDER BY {order}),
  lambda acc, x: (acc * 31 + x) % {MODULUS}, 1::BIGINT) AS h
FROM lineitem GROUP BY l_orderkey"""


_FLOOR = """
SELECT user_id, list_reduce(
  list(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT) ORDER BY ts, event_id),
  lambda acc, x: greatest(acc + x, 0), 0::BIGINT) AS balance
FROM events GROUP BY user_id"""

_FUNNEL = """
SELECT user_id, list_reduce(
  list(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 9 END::BIGINT ORDER BY ts, event_id),
  lambda acc, x: CASE WHEN x <> acc % 10 THEN acc WHEN x = 2 THEN acc - 2 + 10 ELSE acc + 1 END, 0::BIGINT) AS funnel
FROM events GROUP BY user_id"""


def _keyed_sql(order: str) -> str:
    return f"""
WITH starts AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) % {MODULUS} AS start FROM orders),
lists AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY {order}) AS parts FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN parts IS NULL THEN start
  ELSE list_reduce(parts, lambda acc, x: (acc * 31 + x) % {MODULUS}, start) END AS h
FROM starts LEFT JOIN lists USING (k)"""


_SIDES = """
WITH a AS (SELECT o_custkey AS k, o_orderkey AS av FROM orders),
b AS (SELECT user_id AS k, event_id AS bv FROM events),
c AS (SELECT conv_id AS k, turn AS cv FROM conversations),
d AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS dv FROM customer)
"""


def _join_sql(how: str, n: int) -> str:
    sides = "abcd"[:n]
    values = ", ".join(f"{s}v" for s in sides)
    if how in ("left", "right"):  # left joins from the first or from the last table
        first, *rest = sides if how == "left" else sides[::-1]
        plain = f"SELECT {first}.k AS k, {values} FROM {first}" + "".join(f" LEFT JOIN {s} ON {s}.k = {first}.k" for s in rest)
    else:
        kind = "FULL JOIN" if how == "full" else "JOIN"
        plain = f"SELECT k, {values} FROM a" + "".join(f" {kind} {s} USING (k)" for s in sides[1:])
    order = ", ".join(f"{s}v NULLS FIRST" for s in sides)
    return f"{_SIDES} SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) - 1 AS pos FROM ({plain})"


def oracle_sql() -> dict[str, str]:
    events = _groups_sql("event_id", "events", "user_id", "ts, event_id")
    natural = _groups_sql("event_type, event_id", "events", "user_id", "event_type, event_id")
    by_lines = lambda order: _groups_sql(", ".join(LINE), "lineitem", "l_orderkey", ORDERS_SQL[order])
    each = lambda name, sql, where=PLACED: {f"{name}{w}": sql for w in where}
    return {
        "sorted_groups": events,
        "sorted_groups_placed": events,
        **each("sorted_groups_natural", natural),
        **each("sorted_groups_by_expr", by_lines("by_expr")),
        **each("sorted_groups_desc", by_lines("desc"), ("", "_n")),
        **each("fold_hash", _fold_sql(ORDERS_SQL["natural"])),
        **each("fold_hash_py", _fold_sql(ORDERS_SQL["natural"]), ("", "_placed")),
        **each("fold_by_expr", _fold_sql(ORDERS_SQL["by_expr"])),
        **each("fold_desc", _fold_sql(ORDERS_SQL["desc"]), ("", "_n")),
        "fold_floor_balance": _FLOOR,
        "fold_funnel_py": _FUNNEL,
        **each("fold_keyed_start", _keyed_sql(ORDERS_SQL["natural"])),
        **each("fold_keyed_start_py", _keyed_sql(ORDERS_SQL["natural"]), ("", "_placed")),
        **each("fold_keyed_start_desc", _keyed_sql(ORDERS_SQL["desc_line"]), ("", "_n")),
        **each("resource_curried", _curried_sql()),
        **each("resource_prepared", _resource_sql(True)),
        **each("resource_map", _resource_sql(False)),
        **each("resource_curried_sorted", _curried_sql(True)),
        **each("resource_prepared_sorted", _resource_sql(True, True)),
        **each("resource_map_sorted", _resource_sql(False, True)),
        "resource_prepared_py": _resource_sql(True),
        **{f"join_{how}_{n}{w}": _join_sql(how, n) for how, n, w in JOINS},
    }

"""The catalogue: a query for each operator over the test tables, with the equivalent ANSI SQL.

Sums of prices are of decimals, so they don't depend on the order of the rows; sort keys that are limited are total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import named as N
from tessera.functions import options as O
from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.operators.query import Query, asc, desc
from tessera.plans import dml
from tessera.plans.compiled import Compiled, switch
from tessera.sources.plainsql import set_parameter, sql
from tessera.sources.table import Catalog, Col, ForeignKey, Mapped, Table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str) -> Callable:
    def register(f: Callable[[Catalog], Query | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Catalog(spark, sf_dir))
            return out.df if isinstance(out, Query) else out

        _QUERIES[f.__name__] = run
        _SQL[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class Nation(Table):
    name = "nation"
    n_nationkey = Col("int", primary_key=True)
    n_name = Col("string")
    n_regionkey = Col("int")
    foreign_keys = {"region": ForeignKey(("n_regionkey",), "region", ("r_regionkey",))}


class Region(Table):
    name = "region"
    r_regionkey = Col("int", primary_key=True)
    r_name = Col("string")


class Supplier(Table):
    name = "supplier"
    s_suppkey = Col("bigint", primary_key=True)
    s_name = Col("string")
    s_nationkey = Col("int")
    s_acctbal = Col("double")
    foreign_keys = {"nation": ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)), "same": ForeignKey(("s_suppkey",), "nation", ("n_nationkey",))}


class PricedPart(Table):
    """A default projection that computes a column and leaves others out."""

    name = "part"
    p_partkey = Col("bigint", primary_key=True)
    p_name = Col("string")
    p_size = Col("int")

    @classmethod
    def star(cls, row):
        return {"p_partkey": row.p_partkey, "size10": row.p_size * 10}


def money(c):
    return c.cast("decimal(18,2)")


# ---------------------------------------------------------------- projections and filters


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_shipmode_ AS flag FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)")
def op_project(c):
    return c.query("lineitem").map(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "twice": r.l_quantity * 2, "flag": r.l_returnflag})


@query("SELECT p_partkey, p_size * 10 AS size10 FROM part")
def op_computed_star(c):
    return c.query(PricedPart)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_discount >= 0.05")
def op_filter(c):
    return c.query("lineitem").filter(lambda r: (r.l_quantity < 5) & (r.l_discount >= 0.05)).map(lambda r: {"l_orderkey": r.l_orderkey, "l_partkey": r.l_partkey, "l_quantity": r.l_quantity})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END = 'F')")
def op_filter_not(c):
    return c.query("orders").filter_not(lambda r: F.when(r.o_orderstatus != "P", r.o_orderstatus) == "F").map(lambda r: {"o_orderkey": r.o_orderkey, "o_orderstatus": r.o_orderstatus})


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND NOT p_brand = 'Brand#11'")
def op_filter_opt(c):
    return (
        c.query("part")
        .filter_opt(40, lambda r, v: r.p_size > v)
        .filter_opt(None, lambda r, v: r.p_size > v)
        .filter_not_opt("Brand#11", lambda r, v: r.p_brand == v)
        .filter_not_opt(None, lambda r, v: r.p_brand == v)
        .map(lambda r: {"p_partkey": r.p_partkey})
    )


@query("SELECT p_partkey FROM part WHERE p_size > 45 AND NOT p_size = 50")
def op_filter_if(c):
    return c.query("part").filter_if(True, lambda r: r.p_size > 45).filter_if(False, lambda r: r.p_size > 100).filter_not_if(True, lambda r: r.p_size == 50).filter_not_if(False, lambda r: r.p_size > 0).map(lambda r: {"p_partkey": r.p_partkey})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
def op_between(c):
    return c.query("orders").filter(lambda r: P.between(r.o_orderdate, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))).map(lambda r: {"o_orderkey": r.o_orderkey, "o_totalprice": r.o_totalprice})


@query("SELECT p_partkey, p_size IN (1, 2, 3) AS small, FALSE AS never FROM part WHERE p_size IN (1, 2, 3, 49)")
def op_in_set(c):
    return c.query("part").filter(lambda r: P.in_set(r.p_size, [1, 2, 3, 49])).map(lambda r: {"p_partkey": r.p_partkey, "small": P.is_in(r.p_size, 1, 2, 3), "never": P.in_set(r.p_size, [])})


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%b_l%' AND NOT p_name LIKE '%^%%' ESCAPE '^' AND (starts_with(p_name, 'red') OR starts_with(p_name, 'b')) OR ends_with(p_name, 'ring')")
def op_like(c):
    return (
        c.query("part")
        .filter(lambda r: (P.like(r.p_name, "%b_l%") & ~P.like(r.p_name, "%^%%", "^") & (P.starts_with(r.p_name, "red") | P.starts_with(r.p_name, "b"))) | P.ends_with(r.p_name, "ring"))
        .map(lambda r: {"p_partkey": r.p_partkey, "p_name": r.p_name})
    )


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, CASE WHEN p_size < 5 THEN p_size END AS tiny FROM part")
def op_case(c):
    return c.query("part").map(lambda r: {"p_partkey": r.p_partkey, "kind": P.Case.If(r.p_size < 10).Then("small").If(r.p_size < 30).Then("medium").Else("large"), "tiny": P.Case.If(r.p_size < 5).Then(r.p_size).column})


@query("SELECT l_orderkey, CAST(trunc(l_quantity) AS INT) AS q, CAST(l_linenumber AS VARCHAR) AS n, CAST(l_linenumber AS BIGINT) AS big, CAST(CAST(l_linenumber AS VARCHAR) AS INT) AS back FROM lineitem")
def op_cast(c):
    return c.query("lineitem").map(lambda r: {"l_orderkey": r.l_orderkey, "q": S.cast(r.l_quantity, "int"), "n": S.cast(r.l_linenumber, "string"), "big": S.cast(r.l_linenumber, "bigint"), "back": S.cast(S.cast(r.l_linenumber, "string"), "int")})


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '1-URGENT') OR NOT (o_orderstatus = 'F' OR o_totalprice > 50000)")
def op_boolean(c):
    return c.query("orders").filter(lambda r: P.equal((r.o_orderstatus, r.o_orderpriority), ("F", "1-URGENT")) | ~((r.o_orderstatus == "F") | (r.o_totalprice > 50000))).map(lambda r: {"o_orderkey": r.o_orderkey})


@query("SELECT 42 AS answer, 'x' AS letter")
def op_scalar_source(c):
    return Query.scalar(c.spark, answer=42, letter="x")


# ---------------------------------------------------------------- scalar functions


@query(
    """SELECT p_partkey, CAST(length(p_name) AS INT) AS len, upper(p_name) AS up, lower(p_brand) AS low, p_name || '/' || p_brand AS both, substr(p_name, 3) AS dropped, substr(p_name, 1, 4) AS taken,
       substr(p_name, 3, 3) AS mid, CAST(instr(p_brand, '#') AS INT) - 1 AS at, CAST(instr(p_brand, '?') AS INT) - 1 AS nowhere, replace(p_name, 'a', 'oo') AS replaced, reverse(p_brand) AS backwards, repeat(p_brand, 2) AS doubled,
       ltrim('  ' || p_brand || ' ') AS l, rtrim('  ' || p_brand || ' ') AS r, trim('  ' || p_brand || ' ') AS t FROM part"""
)
def op_string_funcs(c):
    def made(r):
        padded = S.concat(F.lit("  "), r.p_brand, F.lit(" "))
        return {
            "p_partkey": r.p_partkey, "len": S.length(r.p_name), "up": S.upper(r.p_name), "low": S.lower(r.p_brand), "both": S.concat(r.p_name, F.lit("/"), r.p_brand),
            "dropped": S.drop(r.p_name, 2), "taken": S.take(r.p_name, 4), "mid": S.substring(r.p_name, 2, 5), "at": S.index_of(r.p_brand, "#"), "nowhere": S.index_of(r.p_brand, "?"),
            "replaced": S.replace(r.p_name, "a", "oo"), "backwards": S.reverse(r.p_brand), "doubled": S.repeat(r.p_brand, 2), "l": S.ltrim(padded), "r": S.rtrim(padded), "t": S.trim(padded),
        }

    return c.query("part").map(made)


@query(
    """SELECT c_custkey, abs(c_acctbal) AS magnitude, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, CAST(sign(c_acctbal) AS INT) AS sgn, CAST(c_custkey AS BIGINT) // 7 AS whole, c_custkey % 7 AS rest,
       -c_custkey % 7 AS negative, round(degrees(c_nationkey), 6) AS deg, round(radians(c_nationkey), 6) AS rad, round(pi(), 9) AS pi, c_acctbal * 2 - 1 + c_acctbal / 4 AS mixed FROM customer"""
)
def op_math_funcs(c):
    return c.query("customer").map(
        lambda r: {
            "c_custkey": r.c_custkey, "magnitude": S.absolute(r.c_acctbal), "up": S.ceil(r.c_acctbal), "down": S.floor(r.c_acctbal), "sgn": S.sign(r.c_acctbal), "whole": S.divide(r.c_custkey, 7, "bigint"),
            "rest": S.modulo(r.c_custkey, 7), "negative": S.modulo(-r.c_custkey, 7), "deg": F.round(S.to_degrees(r.c_nationkey), 6), "rad": F.round(S.to_radians(r.c_nationkey), 6), "pi": F.round(S.pi(), 9),
            "mixed": r.c_acctbal * 2 - 1 + S.divide(r.c_acctbal, 4),
        }
    )


@query("SELECT p_partkey, lpad(p_brand, 12, '*') AS padded, p_size // 3 AS third, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, p_size + 1 AS more FROM part")
def op_named_functions(c):
    return c.query("part").map(lambda r: {"p_partkey": r.p_partkey, "padded": N.function("lpad")(r.p_brand, 12, "*"), "third": N.operator("div")(r.p_size, 3).cast("int"), "kind": N.expression("CASE WHEN {0} > 25 THEN 'big' ELSE 'small' END")("p_size"), "more": N.operator("+")(r.p_size, N.literal("1"))})


@query(
    """SELECT o_orderkey, q IS NULL AS missing, coalesce(q, -1.0) AS or_else, CASE WHEN q IS NULL THEN 'none' ELSE 'some' END AS folded, q * 2 AS mapped, CASE WHEN q > 20 THEN q END AS big, q AS flat, CAST(NULL AS INT) AS nothing
       FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def op_option_ops(c):
    most = c.query("lineitem").group_by(lambda r: r.l_orderkey).map(lambda k, g: {"l_orderkey": k, "q": g.map(lambda r: r.l_quantity).max})
    joined = c.query("orders").join_left(most).on(lambda o, m: o.o_orderkey == m.l_orderkey)

    def made(r):
        q = r[1].map(lambda m: m.q)
        return {
            "o_orderkey": r[0].o_orderkey, "missing": O.is_empty(q), "or_else": O.get_or_else(q, -1.0), "folded": O.fold(q, "none", lambda _: F.lit("some")), "mapped": O.map_option(q, lambda v: v * 2),
            "big": O.filter_option(q, lambda v: v > 20), "flat": O.flatten(O.nest(q)), "nothing": O.none("int"),
        }

    return joined.map(made)


# ---------------------------------------------------------------- joins


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def op_join_cross(c):
    return c.query("region").join(c.query("nation")).map(lambda r: {"r_name": r[0].r_name, "n_name": r[1].n_name})


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def op_join_inner(c):
    return c.query("orders").join(c.query("customer")).on(lambda o, k: (o.o_custkey == k.c_custkey) & (k.c_acctbal > 0)).map(lambda r: {"o_orderkey": r[0].o_orderkey, "c_name": r[1].c_name})


@query("SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def op_join_monadic(c):
    pairs = c.query("supplier").flat_map(lambda s: c.query("nation").filter(lambda n: n.n_nationkey == s.s_nationkey))
    return pairs.join(c.query("region")).on(lambda p, r: p[1].n_regionkey == r.r_regionkey).map(lambda r: {"s_name": r[0][0].s_name, "n_name": r[0][1].n_name, "r_name": r[1].r_name})


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND b.p_retailprice BETWEEN a.p_retailprice AND a.p_retailprice + 5")
def op_join_theta(c):
    near = lambda a, b: (a.p_brand == b.p_brand) & (a.p_size < b.p_size) & P.between(b.p_retailprice, a.p_retailprice, a.p_retailprice + 5)
    return c.query("part").join(c.query("part")).on_range(lambda b: b.p_retailprice, lambda a: a.p_retailprice, lambda a: a.p_retailprice + 5, 1.25, near).map(lambda r: {"a": r[0].p_partkey, "b": r[1].p_partkey})


@query("SELECT o_orderkey, l_partkey, l_orderkey IS NOT NULL AS has FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
def op_join_left(c):
    return c.query("orders").join_left(c.query("lineitem").filter(lambda r: r.l_quantity > 45)).on(lambda o, l: o.o_orderkey == l.l_orderkey).map(lambda r: {"o_orderkey": r[0].o_orderkey, "l_partkey": r[1].l_partkey, "has": r[1].is_defined})


@query("SELECT l_partkey, o_orderkey, l_orderkey IS NULL AS missing FROM (SELECT * FROM lineitem WHERE l_quantity > 45) RIGHT JOIN orders ON o_orderkey = l_orderkey")
def op_join_right(c):
    return c.query("lineitem").filter(lambda r: r.l_quantity > 45).join_right(c.query("orders")).on(lambda l, o: o.o_orderkey == l.l_orderkey).map(lambda r: {"l_partkey": r[0].l_partkey, "o_orderkey": r[1].o_orderkey, "missing": r[0].is_empty})


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey < 80) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey > 20) ON c_custkey = s_suppkey")
def op_join_full(c):
    return c.query("customer").filter(lambda r: r.c_custkey < 80).join_full(c.query("supplier").filter(lambda r: r.s_suppkey > 20)).on(lambda a, b: a.c_custkey == b.s_suppkey).map(lambda r: {"c_custkey": r[0].c_custkey, "s_suppkey": r[1].s_suppkey})


@query("SELECT r_name, s_suppkey FROM region LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 0) ON TRUE")
def op_join_outer_all(c):
    return c.query("region").join_left(c.query("supplier").filter(lambda r: r.s_suppkey < 0)).map(lambda r: {"r_name": r[0].r_name, "s_suppkey": r[1].s_suppkey})


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def op_self_join(c):
    return c.query("nation").join(c.query("nation")).on(lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey)).map(lambda r: {"a": r[0].n_name, "b": r[1].n_name})


@query("SELECT n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def op_fk_nav(c):
    return Supplier.follow(c.query(Supplier).filter(lambda s: s.s_acctbal > 0), "nation", c.df("nation"), Nation)


@query("SELECT n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_suppkey = n_nationkey")
def op_fk_intersection(c):
    return Supplier.follow_both(c.query(Supplier), "nation", "same", c.df("nation"), Nation)


@query("SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 48")
def op_join_nway(c):
    q = c.query("lineitem").filter(lambda l: l.l_quantity > 48).join(c.query("orders")).on(lambda l, o: l.l_orderkey == o.o_orderkey)
    q = q.join(c.query("customer")).on(lambda p, k: p[1].o_custkey == k.c_custkey).join(c.query("nation")).on(lambda p, n: p[1].c_nationkey == n.n_nationkey)
    return q.map(lambda r: {"l_orderkey": r[0][0][0].l_orderkey, "l_linenumber": r[0][0][0].l_linenumber, "c_name": r[0][1].c_name, "n_name": r[1].n_name})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def op_semi_join(c):
    return c.query("orders").is_in(lambda o: o.o_orderkey, c.query("lineitem").filter(lambda l: l.l_quantity > 49).map(lambda l: l.l_orderkey)).map(lambda o: {"o_orderkey": o.o_orderkey})


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def op_anti_join(c):
    return c.query("orders").not_exists(c.query("lineitem"), lambda o, l: o.o_orderkey == l.l_orderkey).map(lambda o: {"o_orderkey": o.o_orderkey})


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def op_anti_by_outer_join(c):
    return c.query("orders").join_left(c.query("lineitem")).on(lambda o, l: o.o_orderkey == l.l_orderkey).filter(lambda r: r[1].is_empty).map(lambda r: {"o_orderkey": r[0].o_orderkey})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000 + c_acctbal)")
def op_exists(c):
    return c.query("customer").exists(c.query("orders"), lambda k, o: (o.o_custkey == k.c_custkey) & (o.o_totalprice > 400000 + k.c_acctbal)).map(lambda k: {"c_custkey": k.c_custkey, "c_name": k.c_name})


@query("SELECT p_partkey FROM part WHERE (p_brand, p_size) IN (SELECT p_brand, p_size FROM part WHERE p_retailprice > 999)")
def op_in_subquery(c):
    return c.query("part").is_in(lambda p: (p.p_brand, p.p_size), c.query("part").filter(lambda p: p.p_retailprice > 999).map(lambda p: (p.p_brand, p.p_size))).map(lambda p: {"p_partkey": p.p_partkey})


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def op_not_in(c):
    return c.query("supplier").is_not_in(lambda s: s.s_nationkey, c.query("nation").filter(lambda n: n.n_regionkey < 3).map(lambda n: n.n_nationkey)).map(lambda s: {"s_suppkey": s.s_suppkey})


# ---------------------------------------------------------------- zips

_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY {0}) AS i FROM {1})"


@query(f"SELECT a.n_name AS nation, b.r_name AS region FROM {_NUMBERED.format('n_nationkey', 'nation')} a JOIN {_NUMBERED.format('r_regionkey', 'region')} b ON a.i = b.i")
def op_zip(c):
    return c.query("nation").sort_by(lambda n: n.n_nationkey).zip(c.query("region").sort_by(lambda r: r.r_regionkey)).map(lambda r: {"nation": r[0].n_name, "region": r[1].r_name})


@query(f"SELECT a.s_name || '-' || b.n_name AS both FROM {_NUMBERED.format('s_suppkey', 'supplier')} a JOIN {_NUMBERED.format('n_name DESC', 'nation')} b ON a.i = b.i")
def op_zip_with(c):
    return c.query("supplier").sort_by(lambda s: s.s_suppkey).zip_with(c.query("nation").sort_by(lambda n: desc(n.n_name)), lambda a, b: {"both": S.concat(a.s_name, F.lit("-"), b.n_name)})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders")
def op_zip_with_index(c):
    return c.query("orders").sort_by(lambda o: (desc(o.o_totalprice), o.o_orderkey)).zip_with_index().map(lambda r: {"o_orderkey": r[0].o_orderkey, "i": r[1]})


# ---------------------------------------------------------------- aggregation


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2")
def op_group_by(c):
    return c.query("lineitem").group_by(lambda r: (r.l_returnflag, r.l_linestatus)).map(lambda k, g: {"l_returnflag": k[0], "l_linestatus": k[1], "n": g.length, "total": g.map(lambda r: money(r.l_extendedprice)).sum.cast("double")})


@query("SELECT count(*) AS value FROM lineitem WHERE l_quantity > 25")
def op_count(c):
    return c.query("lineitem").filter(lambda r: r.l_quantity > 25).length().map(lambda r: {"value": r.value})


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY 1")
def op_count_distinct(c):
    return c.query("orders").group_by(lambda r: r.o_orderstatus).map(lambda k, g: {"o_orderstatus": k, "customers": g.map(lambda r: r.o_custkey).count_distinct, "pairs": g.map(lambda r: (r.o_custkey, r.o_orderpriority)).count_distinct})


@query("SELECT event_type, count(CASE WHEN value > 50 THEN value END) AS defined, count(*) AS n FROM events GROUP BY 1")
def op_count_defined(c):
    return c.query("events").group_by(lambda r: r.event_type).map(lambda k, g: {"event_type": k, "defined": g.map(lambda r: F.when(r.value > 50, r.value)).count_defined, "n": g.length})


@query("SELECT o_orderpriority, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderstatus) AS status, max(o_totalprice) AS most FROM orders GROUP BY 1")
def op_min_max(c):
    return c.query("orders").group_by(lambda r: r.o_orderpriority).map(lambda k, g: {"o_orderpriority": k, "first": g.map(lambda r: r.o_orderdate).min, "last": g.map(lambda r: r.o_orderdate).max, "status": g.map(lambda r: r.o_orderstatus).min, "most": g.map(lambda r: r.o_totalprice).max})


@query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def op_sum(c):
    return c.query("lineitem").group_by(lambda r: r.l_suppkey).map(lambda k, g: {"l_suppkey": k, "lines": g.map(lambda r: r.l_linenumber).sum, "total": g.map(lambda r: money(r.l_extendedprice) + money(r.l_tax)).sum.cast("double")})


@query("SELECT p_brand, avg(p_size) AS size FROM part GROUP BY 1")
def op_avg(c):
    return c.query("part").group_by(lambda r: r.p_brand).map(lambda k, g: {"p_brand": k, "size": g.map(lambda r: r.p_size).avg})


@query("SELECT count(*) AS n, max(l_shipdate) AS last, CAST(sum(CASE WHEN l_quantity > 100 THEN l_linenumber END) AS BIGINT) AS nothing FROM lineitem")
def op_agg_global(c):
    return c.query("lineitem").aggregate(lambda g: {"n": g.length, "last": g.map(lambda r: r.l_shipdate).max, "nothing": g.filter(lambda r: r.l_quantity > 100).map(lambda r: r.l_linenumber).sum})


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600")
def op_having(c):
    return c.query("lineitem").group_by(lambda r: r.l_suppkey).map(lambda k, g: {"l_suppkey": k, "n": g.length}).filter(lambda r: r.n > 600)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000) AS DOUBLE) AS total, max(o_custkey) FILTER (o_orderstatus = '?') AS none FROM orders GROUP BY 1")
def op_filtered_agg(c):
    return c.query("orders").group_by(lambda r: r.o_orderpriority).map(
        lambda k, g: {
            "o_orderpriority": k,
            "f": g.filter(lambda r: r.o_orderstatus == "F").length,
            "total": g.filter(lambda r: r.o_orderstatus == "F").filter(lambda r: r.o_totalprice > 1000).map(lambda r: money(r.o_totalprice)).sum.cast("double"),
            "none": g.filter(lambda r: r.o_orderstatus == "?").map(lambda r: r.o_custkey).max,
        }
    )


@query("SELECT 'all' AS k, count(*) AS n FROM orders")
def op_group_by_constant(c):
    return c.query("orders").group_by(lambda r: F.lit("all")).map(lambda k, g: {"k": k, "n": g.length})


@query("SELECT n_regionkey, n_name, n_nationkey, count(*) AS n FROM nation GROUP BY ALL")
def op_group_by_row(c):
    return c.query("nation").group_by(lambda r: r).map(lambda k, g: {"n_regionkey": k.n_regionkey, "n_name": k.n_name, "n_nationkey": k.n_nationkey, "n": g.length})


@query("SELECT l_returnflag, count(*) AS n, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def op_group_by_outer(c):
    return c.query("orders").join_left(c.query("lineitem")).on(lambda o, l: o.o_orderkey == l.l_orderkey).group_by(lambda r: r[1].l_returnflag).map(lambda k, g: {"l_returnflag": k, "n": g.length, "lines": g.map(lambda r: r[1].l_orderkey).count_defined})


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey)")
def op_corr_max(c):
    last = lambda o: c.query("orders").filter(lambda p: p.o_custkey == o.o_custkey).aggregate(lambda g: g.map(lambda p: p.o_orderkey).max).as_column()
    return c.query("orders").map(lambda o: {"o_custkey": o.o_custkey, "o_orderkey": o.o_orderkey}).filter_scalar(lambda o, outer: o.o_orderkey == last(outer))


@query("SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM region) AS regions FROM nation")
def op_scalar_aggregate(c):
    per = lambda n: c.query("supplier").filter(lambda s: s.s_nationkey == n.n_nationkey).length().as_column()
    return c.query("nation").map_scalar(lambda n, outer: {"n_name": n.n_name, "suppliers": per(outer), "regions": c.query("region").length().as_column()})


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def op_distinct(c):
    return c.query("orders").map(lambda r: {"o_orderstatus": r.o_orderstatus, "o_orderpriority": r.o_orderpriority}).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1")
def op_distinct_on(c):
    return c.query("orders").map(lambda r: {"o_orderkey": r.o_orderkey, "o_custkey": r.o_custkey, "o_totalprice": r.o_totalprice}).sort_by(lambda r: desc(r.o_totalprice)).distinct_on(lambda r: r.o_custkey)


# ---------------------------------------------------------------- sorting and paging


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS bal FROM supplier ORDER BY bal DESC NULLS FIRST, s_suppkey LIMIT 60")
def op_sort_nulls(c):
    return c.query("supplier").map(lambda s: {"s_suppkey": s.s_suppkey, "bal": F.when(s.s_acctbal > 0, s.s_acctbal)}).sort_by(lambda r: (desc(r.bal).nulls_first(), asc(r.s_suppkey))).take(60)


@query("SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 7")
def op_sort_compose(c):
    return c.query("nation").sort_by(lambda n: n.n_name).sort_by(lambda n: desc(n.n_regionkey)).map(lambda n: {"n_name": n.n_name}).take(7)


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey, r_name")
def op_sort(c):
    return c.query("region").sorted()


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def op_take(c):
    return c.query("customer").sort_by(lambda k: k.c_custkey).take(25).map(lambda k: {"c_custkey": k.c_custkey})


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 7")
def op_drop(c):
    return c.query("supplier").sort_by(lambda s: s.s_suppkey).drop(7).map(lambda s: {"s_suppkey": s.s_suppkey})


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 12 OFFSET 8")
def op_paging(c):
    return c.query("customer").sort_by(lambda k: (k.c_acctbal, k.c_custkey)).drop(3).take(30).drop(5).take(12).map(lambda k: {"c_custkey": k.c_custkey})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def op_top_k(c):
    return c.query("orders").map(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).sort_by(lambda o: (desc(o.o_totalprice), o.o_orderkey)).take(10)


@query("SELECT o_orderkey, l_linenumber FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN lineitem ON o_orderkey = l_orderkey")
def op_nested_paging(c):
    return c.query("orders").sort_by(lambda o: (desc(o.o_totalprice), o.o_orderkey)).take(20).join(c.query("lineitem")).on(lambda o, l: o.o_orderkey == l.l_orderkey).map(lambda r: {"o_orderkey": r[0].o_orderkey, "l_linenumber": r[1].l_linenumber})


# ---------------------------------------------------------------- unions


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def op_union(c):
    return c.query("customer").map(lambda r: {"k": r.c_nationkey}).union(c.query("supplier").map(lambda r: {"k": r.s_nationkey}))


@query("SELECT c_name AS name, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def op_union_all(c):
    return c.query("customer").map(lambda r: {"name": r.c_name, "k": r.c_nationkey}) + c.query("supplier").map(lambda r: {"other": r.s_name, "key": r.s_nationkey})


@query("(SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 3)")
def op_union_limit(c):
    a = c.query("customer").sort_by(lambda r: (desc(r.c_acctbal), r.c_custkey)).take(5).map(lambda r: {"name": r.c_name})
    return a + c.query("supplier").sort_by(lambda r: (r.s_acctbal, r.s_suppkey)).take(3).map(lambda r: {"name": r.s_name})


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < -900)")
def op_union_in(c):
    keys = c.query("customer").filter(lambda r: r.c_acctbal > 9900).map(lambda r: {"k": r.c_nationkey}).union(c.query("supplier").filter(lambda r: r.s_acctbal < -900).map(lambda r: {"k": r.s_nationkey}))
    return c.query("nation").is_in(lambda n: n.n_nationkey, keys).map(lambda n: {"n_name": n.n_name})


# ---------------------------------------------------------------- parameters and plain SQL


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 + 1000")
def op_param_query(c):
    found = Compiled(lambda status, least: c.query("orders").filter(lambda o: (o.o_orderstatus == status) & (o.o_totalprice > least + 1000)))
    return found.map(lambda q: q.map(lambda o: {"o_orderkey": o.o_orderkey}))("O", 200000)


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey = 17")
def op_find_by(c):
    return Supplier.find_by("s_suppkey")(c.df("supplier"), 17).map(lambda s: {"s_suppkey": s.s_suppkey})


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 4")
def op_param_switch(c):
    plan = switch([(lambda n: n == 0, lambda n: c.query("supplier").filter(lambda s: F.lit(False)))], lambda n: c.query("supplier").sort_by(lambda s: s.s_suppkey).take(n))
    return plan(4).map(lambda s: {"s_suppkey": s.s_suppkey})


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'O' GROUP BY o_orderpriority")
def op_plain_sql(c):
    return sql(c.spark, "SELECT o_orderpriority, count(*) AS n FROM {table} WHERE o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderstatus = :status GROUP BY o_orderpriority", splice={"table": "tessera_orders"}, views={"tessera_orders": c.df("orders")}, status="O")


# ---------------------------------------------------------------- data changes


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 9001, 'new', NULL, 0.5")
def op_insert(c):
    return dml.insert_values(c.df("supplier"), [(9001, "new")], ["s_suppkey", "s_name"], {"s_acctbal": 0.5})


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey + 100000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
def op_insert_query(c):
    rows = c.query("customer").filter(lambda r: r.c_acctbal > 9000).map(lambda r: {"s_suppkey": r.c_custkey + 100000, "s_name": r.c_name, "s_nationkey": r.c_nationkey, "s_acctbal": r.c_acctbal})
    return dml.insert(c.df("supplier"), rows.df)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'overdrawn' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def op_update(c):
    return dml.update(c.df("supplier"), F.col("s_acctbal") < 0, {"s_name": "overdrawn", "s_acctbal": 0.0})


@query("SELECT * FROM supplier WHERE NOT coalesce(CASE WHEN s_suppkey > 50 THEN s_acctbal > 0 END, FALSE)")
def op_delete(c):
    return dml.delete(c.df("supplier"), F.when(F.col("s_suppkey") > 50, F.col("s_acctbal") > 0))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey > 10 UNION ALL SELECT s_suppkey, 'again', s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <= 10 UNION ALL SELECT s_suppkey + 100000, 'again', s_nationkey, s_acctbal FROM supplier WHERE s_suppkey BETWEEN 11 AND 20")
def op_upsert(c):
    s = c.df("supplier")
    rows = s.where("s_suppkey <= 20").withColumns({"s_name": F.lit("again"), "s_suppkey": F.when(F.col("s_suppkey") > 10, F.col("s_suppkey") + 100000).otherwise(F.col("s_suppkey"))})
    return dml.upsert(s, rows, ["s_suppkey"])


@query("SELECT n_name, 10 + 5 * (row_number() OVER (ORDER BY n_nationkey) - 1) AS id FROM nation")
def op_sequence(c):
    return dml.Sequence("ids", start=10, inc=5).column(c.df("nation"), "id", [F.col("n_nationkey")]).select("n_name", "id")


class Account(Table):
    """A declared table with a key that counts, a default, and a type of the client."""

    name = "account"
    id = Col("bigint", primary_key=True, auto_inc=True)
    owner = Col("string", length=40)
    state = Col(Mapped("int", {"open": 1, "closed": 0}.get, {1: "open", 0: "closed"}.get), default="open")
    balance = Col("double", default=1.5)


def accounts(c):
    return Account.of_rows(c.spark, [(1, "a", "open", 10.0), (2, "b", "closed", 0.0), (5, "c", "open", 7.25)])


@query("SELECT * FROM (VALUES (1, 'a', 1, 10.0), (2, 'b', 0, 0.0), (5, 'c', 1, 7.25), (6, 'd', 1, 1.5), (7, 'e', 1, 1.5)) AS t(id, owner, state, balance)")
def op_insert_auto_inc(c):
    rows = c.spark.createDataFrame([(90, "d"), (91, "e")], "id bigint, owner string").coalesce(1)
    return dml.insert_into(Account, accounts(c), rows)


@query("SELECT * FROM (VALUES (1, 'a', 1, 10.0), (2, 'b', 0, 0.0), (5, 'c', 1, 7.25), (90, 'd', 1, 1.5), (91, 'e', 1, 1.5)) AS t(id, owner, state, balance)")
def op_force_insert(c):
    return dml.insert_into(Account, accounts(c), c.spark.createDataFrame([(90, "d"), (91, "e")], "id bigint, owner string"), force=True)


@query("SELECT CAST(5 + row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name AS owner FROM nation")
def op_insert_returning(c):
    rows = c.query("nation").sort_by(lambda n: n.n_nationkey).map(lambda n: {"owner": n.n_name}).df
    return dml.insert_into(Account, accounts(c), rows, returning=["id", "owner"])[1]


@query("SELECT id, owner FROM (VALUES (1, 'a'), (5, 'c')) AS t(id, owner)")
def op_mapped_type(c):
    kind = Account.cols()["state"].type
    return Account.query(accounts(c)).filter(lambda a: a.state == kind.lit("open")).map(lambda a: {"id": a.id, "owner": a.owner})


@query("SELECT n_name, c.owner FROM nation JOIN (VALUES (1, 'a'), (2, 'b'), (5, 'c')) AS c(id, owner) ON n_nationkey = c.id")
def op_federated(c):
    return c.query("nation").join(Query.of(accounts(c))).on(lambda n, a: n.n_nationkey == a.id).map(lambda r: {"n_name": r[0].n_name, "owner": r[1].owner})


@query("SELECT CAST(1 AS BIGINT) AS id, 'x' AS name WHERE FALSE")
def op_empty_source(c):
    return Query.empty(c.spark).map(lambda r: {"id": r.id, "name": F.lit("x")})


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def op_head(c):
    return c.query("supplier").sort_by(lambda s: (desc(s.s_acctbal), s.s_suppkey)).map(lambda s: {"s_suppkey": s.s_suppkey, "s_name": s.s_name}).take(1)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, '-') AS status, o_totalprice AS price, CAST(o_custkey AS BIGINT) AS same FROM orders")
def op_if_null(c):
    return c.query("orders").map(lambda o: {"o_orderkey": o.o_orderkey, "status": P.if_null(F.when(o.o_orderstatus != "O", o.o_orderstatus), "-"), "price": O.get(O.some(o.o_totalprice)), "same": S.cast(o.o_custkey, "bigint")})


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) WHERE o_orderstatus = 'F'")
def op_subquery(c):
    return c.query("orders").sort_by(lambda o: (desc(o.o_totalprice), o.o_orderkey)).take(200).subquery().for_update().filter(lambda o: o.o_orderstatus == "F").map(lambda o: {"o_orderkey": o.o_orderkey})


@query("SELECT CAST(1 AS BIGINT) AS n, TRUE AS user_known, TRUE AS database_known, TRUE AS today")
def op_session_functions(c):
    known = lambda f: f.isNotNull() & (F.length(f) > 0)
    return Query.scalar(c.spark, n=F.lit(1).cast("bigint"), user_known=known(S.user()), database_known=known(S.database()), today=(F.datediff(F.current_timestamp(), S.current_date()) == 0) & (S.current_time() >= 0))


@query("SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS both_, o_orderstatus IS NOT DISTINCT FROM 'O' AS is_open, year(o_orderdate + INTERVAL 40 DAY) * 2 AS later, CAST(o_custkey AS BIGINT) << 2 AS moved FROM orders")
def op_infix(c):
    year = N.expression("extract(year from {0}) * 2")
    return c.query("orders").map(
        lambda o: {"o_orderkey": o.o_orderkey, "both_": N.operator("||")(N.operator("||")(o.o_orderstatus, "/"), o.o_orderpriority), "is_open": N.operator("<=>")(o.o_orderstatus, "O"), "later": year(o.o_orderdate + F.expr("INTERVAL 40 DAYS")).cast("bigint"), "moved": N.operator("<<")(o.o_custkey.cast("bigint"), 2)}
    )


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' AND n_name <> 'x'")
def op_compiled_flat_map(c):
    orders = Compiled(lambda status, name: c.query("orders").filter(lambda o: o.o_orderstatus == status))
    named = lambda q: Compiled(lambda status, name: q.join(c.query("customer")).on(lambda o, k: o.o_custkey == k.c_custkey).join(c.query("nation").filter(lambda n: n.n_name != name)).on(lambda r, n: r[1].c_nationkey == n.n_nationkey))
    return orders.flat_map(named)("P", "x").map(lambda r: {"o_orderkey": r[0][0].o_orderkey, "n_name": r[1].n_name})


class Span:
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 8")
def op_set_parameter(c):
    set_parameter(Span, lambda s: list(range(s.low, s.high + 1)))
    return sql(c.spark, "SELECT p_partkey FROM tessera_part WHERE array_contains(CAST(:sizes AS ARRAY<BIGINT>), CAST(p_size AS BIGINT))", views={"tessera_part": c.df("part")}, sizes=Span(3, 8))


@query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 90)")
def op_not_in_empty(c):
    return c.query("supplier").is_not_in(lambda s: s.s_nationkey, c.query("nation").filter(lambda n: n.n_regionkey > 90).map(lambda n: n.n_nationkey))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 2 THEN n_nationkey END FROM nation)")
def op_not_in_null(c):
    return c.query("supplier").is_not_in(lambda s: s.s_nationkey, c.query("nation").map(lambda n: F.when(n.n_nationkey > 2, n.n_nationkey))).map(lambda s: {"s_suppkey": s.s_suppkey})


# ---------------------------------------------------------------- larger queries


@query(
    """SELECT n_name, o_orderpriority, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey WHERE l_discount >= 0.02 GROUP BY 1, 2 HAVING count(*) > 5 ORDER BY revenue DESC, n_name, o_orderpriority LIMIT 10"""
)
def revenue_by_nation(c):
    q = c.query("lineitem").filter(lambda l: l.l_discount >= 0.02).join(c.query("orders")).on(lambda l, o: l.l_orderkey == o.o_orderkey)
    q = q.join(c.query("customer")).on(lambda p, k: p[1].o_custkey == k.c_custkey).join(c.query("nation")).on(lambda p, n: p[1].c_nationkey == n.n_nationkey)
    grouped = q.group_by(lambda r: (r[1].n_name, r[0][0][1].o_orderpriority)).map(
        lambda k, g: {"n_name": k[0], "o_orderpriority": k[1], "revenue": g.map(lambda r: money(r[0][0][0].l_extendedprice) * (1 - money(r[0][0][0].l_discount))).sum.cast("double"), "n": g.length}
    )
    return grouped.filter(lambda r: r.n > 5).map(lambda r: {"n_name": r.n_name, "o_orderpriority": r.o_orderpriority, "revenue": r.revenue}).sort_by(lambda r: (desc(r.revenue), r.n_name, r.o_orderpriority)).take(10)


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, avg(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 1 AND 15 GROUP BY 1")
def brands_by_suppliers(c):
    q = c.query("lineitem").join(c.query("part").filter(lambda p: P.between(p.p_size, 1, 15))).on(lambda l, p: l.l_partkey == p.p_partkey)
    return q.group_by(lambda r: r[1].p_brand).map(lambda k, g: {"p_brand": k, "suppliers": g.map(lambda r: r[0].l_suppkey).count_distinct, "quantity": g.map(lambda r: r[0].l_quantity).avg})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["revenue_by_nation"](spark, sf_dir)

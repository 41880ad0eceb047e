"""The query type on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.query import Query, asc, desc
from tessera.plans.compiled import Compiled
from tessera.streaming.cursor import chunks, stream


@pytest.fixture(scope="module")
def tables(spark):
    def q(rows, schema):
        return Query.of(spark.createDataFrame(rows, schema))

    return {
        "suppliers": q([(101, "Acme, Inc.", "Groundsville"), (49, "Superior Coffee", "Mendocino"), (150, "The High Ground", "Meadows")], "id int, name string, city string"),
        "coffees": q([("Colombian", 101, 799, 1, 0), ("French_Roast", 49, 799, 2, 0), ("Espresso", 150, 999, 3, 0), ("Colombian_Decaf", 101, 849, 4, 0), ("French_Roast_Decaf", 49, 999, 5, 0)], "name string, sup_id int, price int, sales int, total int"),
        "fusion": q([(1, "a", "a"), (2, "a", "b"), (3, "c", "b")], "id int, a string, b string"),
        "t3": q([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 5), (3, 1), (3, 9)], "a int, b int"),
        "t2": q([(1, 1), (1, 3), (1, None)], "a int, b int"),
        "u": q([(1,), (2,), (3,), (4,)], "id int"),
        "xs": q([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")], "a int, b string"),
        "ys": q([(1, "a"), (2, "b"), (3, "b"), (4, "d"), (5, "d")], "a int, b string"),
        "ids": q([(i,) for i in range(1, 11)], "id int"),
        "managers": q([(1, "Peter", "HR"), (2, "Amy", "IT"), (3, "Steve", "IT")], "id int, name string, department string"),
        "employees": q([(4, "Jennifer", 1), (5, "Tom", 1), (6, "Leonard", 2), (7, "Ben", 2), (8, "Greg", 3)], "id int, name2 string, manager int"),
        "opt": q([(1, "1", 1), (2, "2", 2), (3, "3", None)], "a int, b string, c int"),
    }


def values(query):
    return [tuple(r) for r in query.result()]


def test_join_filter_sort(tables):
    q = tables["coffees"].join(tables["suppliers"]).on(lambda c, s: c.sup_id == s.id).filter(lambda r: r[0].price < 900).sort_by(lambda r: r[0].name).map(lambda r: (r[0].name, r[1].city))
    assert values(q) == [("Colombian", "Groundsville"), ("Colombian_Decaf", "Groundsville"), ("French_Roast", "Mendocino")]


def test_range_join_is_the_join(spark):
    inf, nan = float("inf"), float("nan")
    prices = [0.0, -0.0, 5.0, 4.999999999999999, 5.000000000000001, 1.25, -1.25, -3.75, 900.1, 905.1, 905.1000000000001, 1e15, 1e15 + 5, 1e300, inf, -inf, nan, None]
    rows = [(7 * i + n, brand, size, p) for i, p in enumerate(prices) for n, (brand, size) in enumerate([("x", 1), ("x", 2), ("x", 2), ("y", 3), ("y", None), (None, 1), (None, 2)])]
    parts = Query.of(spark.createDataFrame(rows, "key int, brand string, size int, price double"))

    def p(a, b):
        return (a.brand == b.brand) & (a.size < b.size) & b.price.between(a.price, a.price + 5)

    pairs = parts.join(parts)
    plain = sorted(values(pairs.on(p).map(lambda r: (r[0].key, r[1].key))))
    assert len(plain) > 50
    for width in (0.3, 1.25, 5, 1000):
        q = pairs.on_range(lambda b: b.price, lambda a: a.price, lambda a: a.price + 5, width, p)
        assert q.columns == ["_1", "_2"]
        assert sorted(values(q.map(lambda r: (r[0].key, r[1].key)))) == plain


def test_range_join_of_whole_numbers(tables):
    q = tables["ids"].join(tables["t3"])

    def p(i, t):
        return t.b.between(i.id - 1, i.id + 1)

    found = q.on_range(lambda t: t.b, lambda i: i.id - 1, lambda i: i.id + 1, 2, p)
    assert sorted(values(found.map(lambda r: (r[0].id, r[1].a, r[1].b)))) == sorted(values(q.on(p).map(lambda r: (r[0].id, r[1].a, r[1].b))))
    # a range whose end is before its start has nothing
    assert q.on_range(lambda t: t.b, lambda i: i.id + 1, lambda i: i.id - 1, 2, lambda i, t: t.b.between(i.id + 1, i.id - 1)).result() == []


def test_range_join_asks_for_an_inner_join_and_a_width(tables):
    for q, width in ((tables["t3"].join_left(tables["t2"]), 1), (tables["t3"].join(tables["t2"]), 0), (tables["t3"].join(tables["t2"]), float("nan"))):
        with pytest.raises(ValueError):
            q.on_range(lambda b: b.b, lambda a: a.b, lambda a: a.b + 1, width, lambda a, b: b.b.between(a.b, a.b + 1))


def test_sorts_compose(tables):
    assert values(tables["fusion"].sort_by(lambda r: r.b).sort_by(lambda r: desc(r.a)).map(lambda r: r.id)) == [(3,), (1,), (2,)]
    # the earlier key still breaks ties after a projection that drops it
    assert values(tables["fusion"].sort_by(lambda r: desc(r.id)).map(lambda r: {"b": r.b, "id": r.id}).sort_by(lambda r: r.b)) == [("a", 1), ("b", 3), ("b", 2)]


def test_paging_folds(tables):
    q = tables["ids"].sort_by(lambda r: r.id)

    def got(p):
        return [r.id for r in p.result()]

    assert got(q.take(5)) == [1, 2, 3, 4, 5]
    assert got(q.take(5).take(3).drop(1)) == [2, 3]
    assert got(q.take(5).drop(1).take(3)) == [2, 3, 4]
    assert got(q.drop(7)) == [8, 9, 10]
    assert got(q.take(6).drop(2).filter(lambda r: r.id != 5)) == [3, 4, 6]
    assert got(q.take(0)) == []
    assert got(q.take(3).drop(5)) == []
    assert got(q.take(4).sort_by(lambda r: desc(r.id)).take(2)) == [4, 3]


def test_nulls_are_last_both_ways(tables):
    q = tables["opt"]
    assert [r.c for r in q.sort_by(lambda r: r.c).result()] == [1, 2, None]
    assert [r.c for r in q.sort_by(lambda r: desc(r.c)).result()] == [2, 1, None]
    assert [r.c for r in q.sort_by(lambda r: asc(r.c).nulls_first()).result()] == [None, 1, 2]
    assert [r.c for r in q.sort_by(lambda r: asc(r.c).reverse().nulls_first().nulls_default()).result()] == [2, 1, None]


def test_zip_with_index_and_zip(tables):
    q = tables["fusion"].sort_by(lambda r: r.id)
    assert [(r[0].id, r[1]) for r in q.zip_with_index().take(2).result()] == [(1, 0), (2, 1)]
    pairs = q.zip(tables["ids"].sort_by(lambda r: desc(r.id))).map(lambda r: (r[0].id, r[1].id))
    assert values(pairs) == [(1, 10), (2, 9), (3, 8)]
    assert values(q.zip_with(tables["u"].sort_by(lambda r: r.id).drop(2), lambda a, b: a.id + b.id)) == [(4,), (6,)]


def test_zip_with_index_of_many_partitions(spark):
    rows = Query.of(spark.range(1000).repartition(7)).sort_by(lambda r: desc(r.id)).zip_with_index().result()
    assert [(r[0].id, r[1]) for r in rows] == [(999 - i, i) for i in range(1000)]
    assert Query.of(spark.range(0)).zip_with_index().result() == []


def test_outer_joins(tables):
    xs, ys = tables["xs"], tables["ys"]
    left = xs.join_left(ys).on(lambda x, y: x.b == y.b).sort_by(lambda r: (r[0].a, r[1].a)).map(lambda r: (r[0].a, r[1].a))
    assert values(left) == [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, None), (5, None)]
    right = xs.join_right(ys).on(lambda x, y: x.b == y.b).sort_by(lambda r: (r[1].a, r[0].a)).map(lambda r: (r[0].a, r[1].a))
    assert values(right) == [(1, 1), (2, 2), (3, 2), (2, 3), (3, 3), (None, 4), (None, 5)]
    full = xs.join_full(ys).on(lambda x, y: x.b == y.b)
    assert sorted(values(full.map(lambda r: (r[0].is_defined, r[1].is_defined)).group_by(lambda r: (r[0], r[1])).map(lambda k, g: (k[0], k[1], g.length)))) == [(False, True, 2), (True, False, 2), (True, True, 5)]
    nested = xs.join_left(ys).on(lambda x, y: x.b == y.b).join_left(xs).on(lambda p, x: p[1].a == x.a).filter(lambda r: r[1].is_empty).map(lambda r: r[0][0].a)
    assert sorted(values(nested)) == [(4,), (5,)]


def test_missing_row_is_no_row_of_nulls(tables, spark):
    nulls = Query.of(spark.createDataFrame([(1, None)], "k int, v string").select(F.when(F.col("k") > 0, F.lit(None).cast("int")).alias("x"), "k"))
    q = tables["u"].join_left(nulls).on(lambda u, n: u.id == n.k).sort_by(lambda r: r[0].id).map(lambda r: (r[0].id, r[1].is_defined, r[1].x.isNull()))
    assert values(q)[:2] == [(1, True, True), (2, False, True)]


def test_cross_product_and_outer_join_without_condition(tables):
    assert tables["fusion"].join(tables["fusion"]).length().head().value == 9
    none = tables["u"].filter(lambda r: r.id > 9)
    assert len(tables["fusion"].join_left(none).result()) == 3
    assert tables["fusion"].join(none).length().head().value == 0


def test_dependent_query(tables):
    q = tables["suppliers"].flat_map(lambda s: tables["coffees"].filter(lambda c: c.sup_id == s.id))
    assert sorted(values(q.map(lambda r: (r[0].id, r[1].price)))) == [(49, 799), (49, 999), (101, 799), (101, 849), (150, 999)]


def test_semi_and_anti(tables):
    u, t3 = tables["u"], tables["t3"]
    assert sorted(values(u.is_in(lambda r: r.id, t3.map(lambda r: r.a)))) == [(1,), (2,), (3,)]
    assert values(u.not_exists(t3, lambda a, b: a.id == b.a)) == [(4,)]
    assert values(u.is_not_in(lambda r: r.id, t3.map(lambda r: r.a))) == [(4,)]
    with_null = tables["opt"].map(lambda r: r.c)
    assert values(u.is_not_in(lambda r: r.id, with_null)) == []


def test_aggregates(tables):
    def all_of(q):
        return tuple(q.aggregate(lambda g: {"n": g.length, "d": g.map(lambda r: r.b).count_defined, "sa": g.map(lambda r: r.a).sum, "sb": g.map(lambda r: r.b).sum, "avg": g.map(lambda r: r.b).avg, "min": g.map(lambda r: r.b).min}).head())

    assert all_of(tables["t2"]) == (3, 2, 3, 4, 2.0, 1)
    assert all_of(tables["t2"].filter(lambda r: r.a == 0)) == (0, 0, None, None, None, None)


def test_groups(tables):
    q = tables["t3"].group_by(lambda r: r.a).map(lambda k, g: (k, g.map(lambda r: r.b).sum, g.map(lambda r: r.b).min, g.map(lambda r: r.b).max)).sort_by(lambda r: r[0])
    assert values(q) == [(1, 6, 1, 3), (2, 8, 1, 5), (3, 10, 1, 9)]
    outer = tables["u"].join_left(tables["t3"]).on(lambda u, t: u.id == t.a).group_by(lambda r: r[0].id).map(lambda k, g: (k, g.length, g.map(lambda r: r[1].a).count_defined)).sort_by(lambda r: r[0])
    assert values(outer) == [(1, 3, 3), (2, 3, 3), (3, 2, 2), (4, 1, 0)]
    assert values(tables["t3"].group_by(lambda r: F.lit("x")).map(lambda k, g: (k, g.length))) == [("x", 8)]
    rows = tables["t2"].union_all(tables["t2"]).group_by(lambda r: r).map(lambda k, g: (k.a, k.b, g.length)).sort_by(lambda r: r[1])
    assert values(rows) == [(1, 1, 2), (1, 3, 2), (1, None, 2)]


def test_filtered_aggregates(tables):
    q = tables["t3"].aggregate(lambda g: {"none": g.filter(lambda r: r.b > 100).length, "sum": g.filter(lambda r: r.b > 100).map(lambda r: r.b).sum, "two": g.filter(lambda r: r.b == 2).length, "twice": g.filter(lambda r: r.b > 1).filter(lambda r: r.b < 5).map(lambda r: r.b).sum})
    assert tuple(q.head()) == (0, None, 2, 7)


def test_count_distinct_of_tuples_keeps_nulls(spark):
    q = Query.of(spark.createDataFrame([(1, None), (1, None), (1, 2), (None, None)], "a int, b int"))
    assert tuple(q.aggregate(lambda g: {"one": g.map(lambda r: r.a).count_distinct, "two": g.map(lambda r: (r.a, r.b)).count_distinct}).head()) == (1, 3)


def test_having(tables):
    assert values(tables["t3"].group_by(lambda r: r.a).map(lambda k, g: {"a": k, "n": g.length}).filter(lambda r: r.n < 3)) == [(3, 2)]


def test_distinct_on_takes_whole_rows(tables):
    q = tables["fusion"].sort_by(lambda r: desc(r.id)).distinct_on(lambda r: r.a).sort_by(lambda r: r.id)
    assert values(q) == [(2, "a", "b"), (3, "c", "b")]
    assert sorted(values(tables["fusion"].map(lambda r: r.b).distinct())) == [("a",), ("b",)]


def test_unions(tables):
    names = tables["managers"].map(lambda r: {"id": r.id, "name": r.name}) + tables["employees"].map(lambda r: {"key": r.id, "called": r.name2})
    assert names.length().head().value == 8
    both = tables["managers"].map(lambda r: r.department).union(tables["managers"].map(lambda r: r.department))
    assert sorted(values(both)) == [("HR",), ("IT",)]
    limited = tables["ids"].sort_by(lambda r: r.id).take(2).union_all(tables["ids"].sort_by(lambda r: desc(r.id)).take(1))
    assert sorted(values(limited)) == [(1,), (2,), (10,)]


def test_conditional_filters(tables):
    u = tables["u"]
    assert u.filter_opt(None, lambda r, v: r.id == v).length().head().value == 4
    assert u.filter_opt(2, lambda r, v: r.id == v).length().head().value == 1
    assert u.filter_not_opt(2, lambda r, v: r.id == v).filter_if(False, lambda r: r.id == 9).filter_not_if(True, lambda r: r.id == 1).length().head().value == 2
    assert tables["opt"].filter_not(lambda r: r.c == 1).length().head().value == 1


def test_results(tables, spark):
    q = tables["ids"].sort_by(lambda r: r.id)
    assert q.head().id == 1
    assert q.filter(lambda r: r.id > 99).head_option() is None
    with pytest.raises(LookupError):
        q.filter(lambda r: r.id > 99).head()
    assert [r.id for r in stream(q)] == list(range(1, 11))
    assert [len(c) for c in chunks(q, 4)] == [4, 4, 2]
    assert len(tables["t2"].map(lambda r: r.a).to(set)) == 1
    assert tuple(Query.scalar(spark, a=1, b="x").head()) == (1, "x")
    assert Query.empty(spark).result() == []
    assert "Scan" in q.statement() or "LocalTable" in q.statement()
    assert q.for_update().subquery().length().head().value == 10


def test_compiled(tables):
    by_id = Compiled(lambda n: tables["ids"].filter(lambda r: r.id == n))
    assert values(by_id(3)) == [(3,)]
    assert values(by_id.map(lambda q: q.map(lambda r: r.id * 2))(4)) == [(8,)]
    assert callable(by_id.extract)


def test_unknown_column_is_named(tables):
    with pytest.raises(AttributeError, match="nope"):
        tables["ids"].filter(lambda r: r.nope == 1)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "id * 2 as v", "'x' as unused").write.parquet(str(tmp_path / "t"))
    t = Query.of(spark.read.parquet(str(tmp_path / "t")))
    plan = t.join(t).on(lambda a, b: a.id == b.id).filter(lambda r: r[0].k == 3).map(lambda r: r[1].v).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan
    assert "unused" not in plan
    assert "Python" not in plan


def test_stored_tables_can_be_cleared(spark):
    from tessera.plans import storage

    df = storage.stored(spark.range(5))
    assert df.count() == 5
    path = storage._paths[-1].removeprefix("file://")
    assert storage.clear(spark) >= 1 and not __import__("os").path.exists(path)
    assert storage.clear(spark) == 0

"""Tables, data changes, sequences, actions, plain SQL and metadata."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.query import Query
from tessera.plans import action as A
from tessera.plans import dml
from tessera.sources import meta
from tessera.sources.plainsql import Reader, as_, sql, sqlu
from tessera.sources.table import Catalog, Col, ForeignKey, Index, Mapped, Table, jdbc, violations


class Users(Table):
    name = "users"
    id = Col("int", primary_key=True, auto_inc=True)
    first = Col("string")
    last = Col("string", nullable=True)


class Orders(Table):
    name = "orders"
    user_id = Col("int")
    order_id = Col("int", primary_key=True)
    product = Col("string", default="nothing")
    foreign_keys = {"user": ForeignKey(("user_id",), "users", ("id",)), "same": ForeignKey(("order_id",), "users", ("id",))}
    indexes = {"by_product": Index(("product",), unique=True)}

    @classmethod
    def star(cls, row):
        return {"order_id": row.order_id, "user_id": row.user_id, "label": F.concat(row.product, F.lit("!"))}


USERS = [(1, "Homer", "Simpson"), (2, "Marge", "Simpson"), (3, "Apu", "Nahasapeemapetilon"), (4, "Snowball", None)]


@pytest.fixture(scope="module")
def users(spark):
    return Users.of_rows(spark, USERS)


@pytest.fixture(scope="module")
def orders(spark):
    return Orders.of_rows(spark, [(1, 1, "donut"), (1, 2, "beer"), (2, 3, "hat")])


def test_star_and_catalog(spark, orders, users):
    c = Catalog(spark, frames={"orders": orders, "users": users})
    assert c.query(Orders).columns == ["order_id", "user_id", "label"]
    assert c.query("users").length().head().value == 4
    assert Orders.raw(orders).columns == ["user_id", "order_id", "product"]
    assert Users.primary_key() == ["id"]


def test_foreign_keys(orders, users):
    q = Orders.query(orders)
    assert sorted(r.first for r in Orders.follow(q, "user", users, Users).result()) == ["Homer", "Homer", "Marge"]
    assert [r.first for r in Orders.follow_both(q, "user", "same", users, Users).result()] == ["Homer"]
    assert [r.last for r in Users.find_by("first")(users, "Snowball").result()] == [None]


def test_constraints(spark, users, orders):
    with pytest.raises(ValueError, match="primary key"):
        Users.of_rows(spark, [(1, "a", None), (1, "b", None)])
    bad = spark.createDataFrame([(9, 1, "x"), (1, 2, "x")], Orders.schema())
    found = violations(Orders, bad, {"users": users})
    assert any("unique index" in f for f in found) and any("leads nowhere" in f for f in found)
    assert violations(Orders, orders, {"users": users}) == []


def test_changes(spark, users):
    more = dml.insert_values(users, [(5, "Lenny")], ["id", "first"], {"last": "Leonard"})
    assert more.where("id = 5").first().last == "Leonard"
    table, new = dml.insert_returning(users, spark.createDataFrame([("Carl", "Carlson"), ("Moe", None)], "first string, last string"), "id")
    assert sorted(r.id for r in new.collect()) == [5, 6] and table.count() == 6
    changed = dml.update(users, F.col("last") == "Simpson", {"first": "S"})
    assert sorted(r.first for r in changed.collect()) == ["Apu", "S", "S", "Snowball"]
    # a condition that is NULL changes nothing
    assert dml.delete(users, F.col("last") == "Simpson").count() == 2
    assert dml.affected(users, F.col("last") == "Simpson") == 2
    merged = dml.upsert(users, spark.createDataFrame([(1, "H", None), (7, "Ned", "Flanders")], Users.schema()), ["id"])
    assert {r.id: r.first for r in merged.collect()} == {1: "H", 2: "Marge", 3: "Apu", 4: "Snowball", 7: "Ned"}
    with pytest.raises(ValueError, match="no column"):
        dml.insert(users, spark.createDataFrame([(1,)], "nope int"))


def test_sequences(spark):
    s = dml.Sequence("s", start=200, inc=10)
    assert [s.next(), s.next(), s.curr()] == [200, 210, 210]
    down = dml.Sequence("d", start=3, inc=-1, min=2, max=5, cycle=True)
    assert [down.next() for _ in range(5)] == [3, 2, 5, 4, 3]
    assert [r.n for r in down.column(spark.range(5), "n", [F.col("id")]).orderBy("id").collect()] == [3, 2, 5, 4, 3]
    up = dml.Sequence("u", start=4, inc=2, min=1, max=7, cycle=True)
    want = [up.next() for _ in range(9)]
    assert [r.n for r in up.column(spark.range(9), "n", [F.col("id")]).orderBy("id").collect()] == want
    end = dml.Sequence("e", start=1, max=2)
    assert [end.next(), end.next()] == [1, 2]
    with pytest.raises(OverflowError):
        end.next()
    with pytest.raises(LookupError):
        dml.Sequence("f").curr()


def test_ddl(spark):
    for text in dml.create_statements(Users, if_not_exists=True):
        spark.sql(text)
    assert "users" in meta.tables(spark)
    assert [c[0] for c in meta.columns(spark, "users")] == ["id", "first", "last"]
    assert sqlu(spark, "INSERT INTO users VALUES (:id, 'a', NULL)", id=1) == 0
    assert spark.table("users").count() == 1
    for text in [*dml.truncate_statements(Users), *dml.drop_statements(Users, if_exists=True)]:
        spark.sql(text)
    assert "users" not in meta.tables(spark)
    assert "default" in meta.databases(spark) and "upper" in meta.functions(spark)


def test_plain_sql(spark, users):
    q = sql(spark, "SELECT id, first FROM {t} WHERE last = :last ORDER BY id", splice={"t": "u"}, views={"u": users}, last="Simpson")
    assert [tuple(r) for r in q.result()] == [(1, "Homer"), (2, "Marge")]
    assert as_(q, lambda r: (r.next(), r.next().upper())) == [(1, "HOMER"), (2, "MARGE")]
    assert Reader((1, 2)).next() == 1


def test_model_and_generated_classes(users, orders):
    m = meta.model({"users": users, "order-items": orders}, {"users": ["id"]}, {"order-items": {"user": (("user_id",), "users", ("id",))}})
    assert [t.name for t in m.tables] == ["order-items", "users"]
    names = {}
    exec(meta.source_code(m), names)  # noqa: S102
    assert names["Users"].primary_key() == ["id"]
    assert names["OrderItems"].foreign_keys["user"].target == "users"
    assert names["Users"].query(users).length().head().value == 4
    with pytest.raises(ValueError, match="no column"):
        meta.model({"users": users}, {"users": ["x"]})


def test_actions(spark, users, tmp_path):
    log = []
    note = lambda x: A.lift(lambda: log.append(x) or x)
    assert note(1).and_then(note(2)).zip(note(3)).map(sum).run(spark) == 5
    assert (note(4) >> note(5)).as_("x").run(spark) == "x"
    assert A.successful(3).flat_map(lambda v: A.successful(v + 1)).run(spark) == 4
    assert A.sequence([note(6), note(7)]).run(spark) == [6, 7]
    assert A.fold([A.successful(i) for i in range(4)], 0, lambda a, b: a + b).run(spark) == 6
    assert A.traverse([1, 2], lambda v: A.successful(v * 2)).run(spark) == [2, 4]
    assert A.seq(note(8)).run(spark) is None and A.sequence_option(None).run(spark) is None
    boom = A.failed(KeyError("boom"))
    assert isinstance(boom.failed().run(spark), KeyError)
    assert boom.as_try().run(spark)[0] is False and A.unit.as_try().run(spark) == (True, None)
    with pytest.raises(KeyError):
        boom.and_finally(note("finally")).run(spark)
    with pytest.raises(KeyError):
        boom.clean_up(lambda e: note(type(e).__name__)).run(spark)
    assert log[-2:] == ["finally", "KeyError"]
    with pytest.raises(LookupError):
        A.successful(1).filter(lambda v: v > 1).run(spark)
    assert A.successful(1).collect({1: "one"}).run(spark) == "one"
    assert A.successful(2).zip_with(A.successful(3), lambda a, b: a * b).named("n").transactionally().with_pinned_session().in_pool("p").run(spark) == 6
    path = str(tmp_path / "out")
    wrote = A.write(users, path)
    assert wrote.effects == {"write"}
    assert wrote.and_then(A.raw(lambda s: s.read.parquet(path).count())).run(spark) == 4
    assert len(A.result(Query.of(users)).run(spark)) == 4
    assert A.statements(["CREATE TABLE made (a INT) USING parquet", "DROP TABLE made"]).run(spark) in (None, [])
    with pytest.raises(LookupError):
        A.unit.failed().run(spark)


class Accounts(Table):
    name = "accounts"
    id = Col("bigint", primary_key=True, auto_inc=True)
    owner = Col("string", length=8, unique=True)
    state = Col(Mapped("int", {"open": 1, "closed": 0}.get, {1: "open", 0: "closed"}.get), default="open", nullable=True)
    user = Col("bigint", nullable=True)
    foreign_keys = {"who": ForeignKey(("user",), "users", ("id",))}
    indexes = {"by_state": Index(("state",))}


def test_declared_inserts(spark):
    table = Accounts.of_rows(spark, [(3, "a", "closed", None)])
    rows = spark.createDataFrame([(70, "b"), (71, "c")], "id bigint, owner string").coalesce(1)
    assert [tuple(r) for r in dml.insert_into(Accounts, table, rows).orderBy("id").collect()] == [(3, "a", 0, None), (4, "b", 1, None), (5, "c", 1, None)]
    after, new = dml.insert_into(Accounts, table, rows, force=True, returning=["id", "state"])
    assert after.count() == 3 and sorted(tuple(r) for r in new.collect()) == [(70, 1), (71, 1)]
    assert dml.insert_into(Accounts, table.limit(0), rows).agg({"id": "max"}).first()[0] == 2
    assert Accounts.read(Accounts.query(after).sort_by(lambda r: r.id).take(2)) == [{"id": 3, "owner": "a", "state": "closed", "user": None}, {"id": 70, "owner": "b", "state": "open", "user": None}]


def test_ddl_keeps_defaults_lengths_and_keys(spark):
    spark.sql("DROP TABLE IF EXISTS accounts")
    for text in dml.create_statements(Accounts):
        spark.sql(text)
    spark.sql("INSERT INTO accounts (id, owner) VALUES (1, 'x')")
    assert [tuple(r) for r in spark.table("accounts").collect()] == [(1, "x", 1, None)]
    with pytest.raises(Exception, match="8"):
        spark.sql("INSERT INTO accounts (id, owner) VALUES (2, 'far too long')")
    assert meta.primary_keys(spark, "accounts") == ["id"] and meta.best_row_identifier(spark, "accounts") == ["id"]
    assert meta.imported_keys(spark, "accounts") == [("who", ("user",), "users", ("id",))]
    assert ("accounts", "who", ("user",), ("id",)) in meta.exported_keys(spark, "users")
    assert meta.cross_reference(spark, "users", "accounts") and not meta.cross_reference(spark, "orders", "accounts")
    assert meta.indexes(spark, "accounts") == [("by_state", ("state",), False)]
    assert meta.table_types(spark)["accounts"] == "MANAGED" and meta.catalogs(spark) and meta.procedures(spark) == []
    declared, found = meta.model_of(Accounts), meta.model_of_session(spark, ["accounts"])
    assert found.tables[0].foreign_keys == declared.tables[0].foreign_keys and found.tables[0].indexes == declared.tables[0].indexes
    assert [(c.name, c.type, c.primary_key, c.auto_inc, c.unique, c.default, c.length) for c in found.tables[0].columns] == [(c.name, c.type, c.primary_key, c.auto_inc, c.unique, c.default, c.length) for c in declared.tables[0].columns]
    names = {}
    exec(meta.source_code(found), names)  # noqa: S102
    made = names["Accounts"]
    assert made.cols()["owner"].length == 8 and made.cols()["state"].default == 1 and made.cols()["id"].auto_inc and made.indexes["by_state"].columns == ("state",)
    spark.sql("DROP TABLE accounts")


def test_jdbc_and_federated_source(spark, users):
    """A table of a database (Derby, in memory) joined with a DataFrame; its filter is pushed down."""
    url = "jdbc:derby:memory:tessera"
    rows = spark.createDataFrame([(1, "Moe"), (2, "Duff")], "user_id int, bar string")
    rows.write.format("jdbc").options(url=f"{url};create=true", dbtable="bars").mode("overwrite").save()
    found = jdbc(spark, url, "bars")
    joined = Query.of(users).join(Query.of(found).filter(lambda b: b.user_id > 1)).on(lambda u, b: u.id == b.user_id).map(lambda r: (r[0].first, r[1].bar))
    assert [tuple(r) for r in joined.result()] == [("Marge", "Duff")]
    assert "PushedFilters: [*IsNotNull(USER_ID), *GreaterThan(USER_ID,1)]" in joined.statement() or "GreaterThan" in joined.statement()


def test_no_local_folder_on_a_cluster(monkeypatch):
    from tessera.plans import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())

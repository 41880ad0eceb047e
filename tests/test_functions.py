"""Scalar functions, options and functions by name."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import named as N
from tessera.functions import options as O
from tessera.functions import predicates as P
from tessera.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cases():
    return [
        (S.length(F.lit("foo")), 3),
        (S.concat(F.lit("foo"), F.lit("bar")), "foobar"),
        (S.concat(F.lit("foo"), F.lit(None)), None),
        (S.substring(F.lit("foobar"), 0, 3), "foo"),
        (S.substring(F.lit("foobar"), 3), "bar"),
        (S.substring(F.lit("foobar"), 2, 4), "ob"),
        (S.substring(F.lit("foobar"), 4, 99), "ar"),
        (S.substring(F.lit("foobar"), 4, 2), ""),
        (S.take(F.lit("foobar"), 3), "foo"),
        (S.drop(F.lit("foobar"), 3), "bar"),
        (S.index_of(F.lit("foobar"), "bar"), 3),
        (S.index_of(F.lit("foobar"), "foo"), 0),
        (S.index_of(F.lit("foobar"), "x"), -1),
        (S.replace(F.lit("foofoo"), "o", "u"), "fuufuu"),
        (S.reverse(F.lit("foo")), "oof"),
        (S.repeat(F.lit("ab"), 3), "ababab"),
        (S.upper(F.lit("Foo")), "FOO"),
        (S.lower(F.lit("Foo")), "foo"),
        (S.ltrim(F.lit("  foo  ")), "foo  "),
        (S.rtrim(F.lit("  foo  ")), "  foo"),
        (S.trim(F.lit("  foo\t ")), "foo\t"),
        (S.ceil(F.lit(1.2)), 2.0),
        (S.ceil(F.lit(-1.2)), -1.0),
        (S.floor(F.lit(1.8)), 1.0),
        (S.floor(F.lit(7), "int"), 7),
        (S.sign(F.lit(-3.5)), -1),
        (S.sign(F.lit(0)), 0),
        (S.absolute(F.lit(-17)), 17),
        (S.divide(F.lit(7), 2, "int"), 3),
        (S.divide(F.lit(-7), 2, "int"), -3),
        (S.divide(F.lit(7.0), 2), 3.5),
        (S.modulo(F.lit(-8), 3), -2),
        (S.to_degrees(S.pi()), 180.0),
        (P.like(F.lit("foo%bar"), "foo^%%", "^"), True),
        (P.like(F.lit("foobar"), "foo^%%", "^"), False),
        (P.like(F.lit("foo"), "f_o"), True),
        (P.starts_with(F.lit("foo%"), "foo%"), True),
        (P.starts_with(F.lit("foobar"), "foo%"), False),
        (P.ends_with(F.lit("foo_"), "o_"), True),
        (P.between(F.lit(3), 1, 3), True),
        (P.in_set(F.lit(None), []), False),
        (P.in_set(F.lit(3), [1, 2]), False),
        (P.is_in(F.lit(3), 1, F.lit(3)), True),
        (P.if_null(F.lit(None).cast("int"), 4), 4),
        (P.equal((F.lit(1), F.lit("a")), (1, "a")), True),
        (P.not_equal(F.lit(1), F.lit(None)), None),
        (P.Case.If(F.lit(False)).Then(1).If(F.lit(True)).Then(2).Else(3), 2),
        (P.Case.If(F.lit(False)).Then(1).column, None),
        (O.get_or_else(O.none("int"), 5), 5),
        (O.fold(O.none("int"), "e", lambda v: v.cast("string")), "e"),
        (O.fold(O.some(3), "e", lambda v: v.cast("string")), "3"),
        (O.map_option(O.some(3), lambda v: v + 1), 4),
        (O.flat_map_option(O.some(3), lambda v: O.none("int")), None),
        (O.filter_option(O.some(3), lambda v: v > 5), None),
        (O.is_empty(O.none("int")), True),
        (O.is_defined(O.some(1)), True),
        (O.flatten(O.nest(O.none("int"))), None),
        (O.is_defined(O.nest(O.none("int"))), True),
        (N.function("lpad")(F.lit("x"), 3, "-"), "--x"),
        (N.function("pi")().cast("int"), 3),
        (N.operator("*")(F.lit(3), 4), 12),
        (N.operator("div")(F.lit(7), 2), 3),
        (N.literal("1 + 1"), 2),
    ]


def test_values(spark):
    todo = cases()
    row = spark.range(1).select(*(c.alias(f"x{i}") for i, (c, _) in enumerate(todo))).first()
    assert [(i, v) for i, v in enumerate(row)] == [(i, e) for i, (_, e) in enumerate(todo)]


def test_get_fails_without_value(spark):
    assert value(spark, O.get(O.some(1))) == 1
    with pytest.raises(Exception, match="not defined"):
        value(spark, O.get(O.none("int")))


def test_cast_of_bad_text_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x1",)], "s string").select(S.cast(F.col("s"), "int")).collect()


def test_escape_character_is_checked():
    with pytest.raises(ValueError, match="escape"):
        P.like(F.lit("a"), "a", "%")


def test_template_and_session_functions(spark):
    row = spark.createDataFrame([(5,)], "a int").select(N.expression("{0} * 2")("a").alias("x"), S.user().alias("u"), S.database().alias("d"), S.current_date().alias("t"), S.current_time().alias("m")).first()
    assert row.x == 10 and row.u and row.d == "default" and row.t is not None and 0 <= row.m < 86_400_000_000

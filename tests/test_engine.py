"""Plans, expressions, recursion and readers against plain versions."""

import base64
import math
import struct

import pytest
from pyspark.sql import functions as F

from quernel.functions.expressions import Compiler
from quernel.model import PlanError, RelationKey, Schema
from quernel.operators import relational as rel
from quernel.operators.iterate import CountFilter, DupElim, KeepMinValue, SimpleAppender, fixpoint
from quernel.plans import scenarios, suite
from quernel.plans.program import Engine, validate
from quernel.plans.server import serve
from quernel.plans.suite import const, emit, one, three, two
from quernel.sources import formats, generated


def test_schema_and_keys():
    s = Schema(("INT_TYPE", "STRING_TYPE"), ("a", "b"))
    assert s.merge(Schema(("LONG_TYPE",), ("a",))).names == ("a_1", "b", "a_2") and Schema(("INT_TYPE",)).names == ("col0",)
    for bad in (("a", "a"), ("1a", "b")):
        with pytest.raises(PlanError):
            Schema(("INT_TYPE", "INT_TYPE"), bad)
    with pytest.raises(PlanError):
        RelationKey("a b", "c", "d")
    assert str(RelationKey.parse("u:p:r")) == "u:p:r"


def value(spark, e):
    df = spark.range(1)
    return df.select(Compiler(df)(e).alias("v")).first().v


def test_expressions(spark):
    i, lo, d, s = (lambda k: lambda v: const(k, v))("INT_TYPE"), (lambda k: lambda v: const(k, v))("LONG_TYPE"), (lambda k: lambda v: const(k, v))("DOUBLE_TYPE"), (lambda k: lambda v: const(k, v))("STRING_TYPE")
    kind = lambda t: {"type": "TYPE", "outputType": t}
    blob = lambda b: const("BLOB_TYPE", base64.b64encode(b).decode())
    assert value(spark, two("IDIVIDE", i(-7), i(2))) == -3 and value(spark, two("MODULO", i(-7), i(2))) == -1
    assert value(spark, two("IDIVIDE", lo(9007199254740993), lo(1))) == 9007199254740993
    assert value(spark, two("DIVIDE", i(1), i(0))) == math.inf and value(spark, two("DIVIDE", i(1), i(4))) == 0.25
    assert value(spark, two("LIKE", s("a_Bc"), s("A_%"))) and not value(spark, two("LIKE", s("axbc"), s("a_%")))
    assert value(spark, two("SPLIT", s("a,b,,"), s(","))) == ["a", "b"] and value(spark, two("NGRAM", s("abc"), lo(2))) == ["ab", "bc"]
    assert value(spark, one("SEQUENCE", lo(0))) == [] and value(spark, one("SEQUENCE", lo(3))) == [0, 1, 2]
    assert value(spark, one("BITSET", blob(b"\x05"))) == [True, False, True] + [False] * 5
    assert bytes(value(spark, three("BYTERANGE", blob(b"abcd"), i(1), i(3)))) == b"bc"
    assert value(spark, two("CAST", blob(b"\xff\xff\xff\xfe"), kind("INT_TYPE"))) == -2
    assert value(spark, two("CAST", d(-2.7), kind("LONG_TYPE"))) == -2
    import hashlib

    assert value(spark, one("HASH_MD5", s("abc"))) == struct.unpack("<q", hashlib.md5(b"abc").digest()[:8])[0]
    assert value(spark, one("HASH_MD5", lo(5))) == struct.unpack("<q", hashlib.md5(struct.pack("<q", 5)).digest()[:8])[0]
    for bad in (two("PLUS", i(2**31 - 1), i(1)), two("CAST", s(" 12 "), kind("INT_TYPE")), two("CAST", d(1e300), kind("FLOAT_TYPE")), three("SUBSTR", s("abc"), i(2), i(9))):
        with pytest.raises(Exception):  # noqa: B017
            value(spark, bad)
    with pytest.raises(PlanError):
        value(spark, {"type": "NOPE"})


def test_operators(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert rel.counting_join(df, df, ["k"], ["k"]).first()[0] == 5 and rel.counting_join(df, df.where("false"), ["k"], ["k"]).first()[0] == 0
    assert rel.join(df, df, ["k"], ["k"]).columns == ["k_1", "v_1", "k_2", "v_2"]
    with pytest.raises(PlanError):
        rel.join(df, df, ["k"], ["v"])
    with pytest.raises(Exception):  # noqa: B017
        rel.cross_with_singleton(df, df).collect()
    assert rel.counter(df, "i", ["k", "v"]).orderBy("i").select("i", "v").collect() == [(0, "a"), (1, "b"), (2, "c")]
    count = [{"type": "Primitive", "column": 0, "aggOps": ["COUNT"]}]
    assert rel.aggregate(df.where("false"), [], count, True).first()[0] == 0
    assert rel.aggregate(df.where("false"), [], [{"type": "Primitive", "column": 0, "aggOps": ["SUM"]}], True).count() == 0
    with pytest.raises(PlanError):
        rel.aggregate(df, [], [{"type": "Primitive", "column": 1, "aggOps": ["SUM"]}])
    got = rel.sampling_distribution(spark.createDataFrame([(1, 10), (2, 30)], "w int, c int"), percent=50.0).collect()
    assert sum(r.SampleSize for r in got) == 20
    assert rel.hypercube(df, [2, 3], {0: "k"}).count() == 9
    assert rel.shares([100] * 3, [{0, 1}, {1, 2}, {2, 0}], 64) == [4, 4, 4] and rel.shares([10**6, 10], [{0, 1}, {1, 2}], 12) == [1, 12, 1]
    assert rel.sample_exact(df, 2).count() == 2 and rel.sample_with_replacement(df, 7).count() == 7
    kept, size = rel.reservoir(df.repartition(2), 1)
    assert kept.count() == size.count() and size.agg({"PartitionSize": "sum"}).first()[0] == 3


def closure(edges):
    out = set(edges)
    while new := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= new
    return out


def test_fixpoints(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 5)]
    e = spark.createDataFrame(pairs, "a long, b long")
    step = lambda held, delta: {"t": rel.join(delta["t"], e, ["b"], ["a"], ["a"], ["b"], ["a", "b"])}
    assert {tuple(r) for r in fixpoint({"t": e}, {"t": DupElim()}, step)["t"].collect()} == closure(pairs)
    with pytest.raises(PlanError):
        fixpoint({"t": e}, {"t": SimpleAppender()}, step, most=3)
    # who goes if three friends go: organisers first, then what the count filter lets pass
    friends = [(x, p) for x in (10, 11) for p in (1, 2, 3)] + [(12, 1), (12, 10), (12, 11), (13, 1), (13, 2)]
    f = spark.createDataFrame(friends, "x long, p long")
    start = f.where("p in (1, 2, 3)").select("x", "p")
    step = lambda held, delta: {"c": rel.join(f, delta["c"], ["p"], ["x"], ["x", "p"], [], ["x", "p"])}
    state = CountFilter(("x",), 3)
    assert {r.x for r in state.passed(fixpoint({"c": start}, {"c": state}, step)["c"]).collect()} == {10, 11, 12}
    held, delta = KeepMinValue(("a",), ("b",)).merge(spark.createDataFrame([(1, 5), (2, 5)], "a long, b long"), spark.createDataFrame([(1, 7), (2, 3), (3, 9), (3, 8)], "a long, b long"))
    assert sorted(map(tuple, held.collect())) == [(1, 5), (2, 3), (3, 8)] and sorted(map(tuple, delta.collect())) == [(2, 3), (3, 8)]


def key(name):
    return {"userName": "public", "programName": "test", "relationName": name}


def sub(*ops):
    return {"type": "SubQuery", "fragments": [{"operators": list(ops)}]}


def test_plans(spark):
    e = Engine(spark)
    schema = {"columnTypes": ["LONG_TYPE", "LONG_TYPE"], "columnNames": ["a", "b"]}
    lines = base64.b64encode(b"1,2\n2,3\n3,1\n4,5\n").decode()
    assert e.ingest(key("e"), {"readerType": "CSV", "schema": schema}, {"dataType": "Bytes", "bytes": lines}) == 4
    tc = {"rawQuery": "tc", "logicalRa": "", "fragments": [
        {"operators": [{"opType": "TableScan", "opId": 1, "relationKey": key("e")}, {"opType": "ShuffleProducer", "opId": 2, "argChild": 1, "distributeFunction": {"type": "Hash", "indexes": [0]}}]},
        {"operators": [{"opType": "ShuffleConsumer", "opId": 3, "argOperatorId": 2}, {"opType": "IDBController", "opId": 4, "argInitialInput": 3, "argIterationInput": 9, "argEosControllerInput": 10, "argState": {"type": "DupElim"}, "relationKey": key("tc")}, {"opType": "LocalMultiwayProducer", "opId": 5, "argChild": 4}]},
        {"operators": [{"opType": "LocalMultiwayConsumer", "opId": 6, "argOperatorId": 5}, {"opType": "TableScan", "opId": 7, "relationKey": key("e")}, {"opType": "SymmetricHashJoin", "opId": 8, "argChild1": 6, "argChild2": 7, "argColumns1": [1], "argColumns2": [0], "argSelect1": [0], "argSelect2": [1]}, {"opType": "ShuffleProducer", "opId": 11, "argChild": 8}]},
        {"operators": [{"opType": "ShuffleConsumer", "opId": 9, "argOperatorId": 11}, {"opType": "EmptySink", "opId": 12, "argChild": 9}]},
        {"operators": [{"opType": "LocalMultiwayConsumer", "opId": 10, "argOperatorId": 5}, {"opType": "EOSController", "opId": 13, "argChild": 10}]},
    ]}
    n = e.run(tc)
    assert e.status(n)["status"] == "SUCCESS"
    assert {tuple(r) for r in e.read(key("tc")).collect()} == closure([(1, 2), (2, 3), (3, 1), (4, 5)])
    assert list(e.export(key("e"), "csv"))[0] == "a,b" and len(e.list("tc")) == 1 and e.describe(key("e"))["count"] == 4

    col = lambda i: {"type": "VARIABLE", "columnIdx": i}
    start = sub({"opType": "Singleton", "opId": 1}, {"opType": "Apply", "opId": 2, "argChild": 1, "emitExpressions": emit(v=const("LONG_TYPE", 1))}, {"opType": "TempInsert", "opId": 3, "argChild": 2, "table": "x"})
    body = sub({"opType": "TempTableScan", "opId": 1, "table": "x"}, {"opType": "Apply", "opId": 2, "argChild": 1, "emitExpressions": emit(v=two("TIMES", col(0), const("LONG_TYPE", 2)))}, {"opType": "TempInsert", "opId": 3, "argChild": 2, "table": "x"}, {"opType": "Apply", "opId": 4, "argChild": 2, "emitExpressions": emit(c=two("LT", col(0), const("LONG_TYPE", 100)))}, {"opType": "TempInsert", "opId": 5, "argChild": 4, "table": "c"})
    end = sub({"opType": "TempTableScan", "opId": 1, "table": "x"}, {"opType": "SetGlobal", "opId": 2, "argChild": 1, "key": "last"})
    n = e.run({"rawQuery": "pow", "logicalRa": "", "plan": {"type": "Sequence", "plans": [start, {"type": "DoWhile", "body": [body], "condition": "c"}, end]}})
    assert e.status(n)["globals"] == {"last": 128} and len(e.queries("pow")) == 1

    good = {"rawQuery": "", "logicalRa": "", **sub({"opType": "Singleton", "opId": 1}, {"opType": "EmptySink", "opId": 2, "argChild": 1})}
    good.pop("type")
    validate(good)
    for bad in ({}, {"rawQuery": "", "logicalRa": ""}, good | {"plan": {}}):
        with pytest.raises(PlanError):
            validate(bad)
    for ops in ([{"opType": "Nope", "opId": 1}], [{"opType": "Singleton", "opId": 1}], [{"opType": "Singleton", "opId": 1}, {"opType": "EmptySink", "opId": 1, "argChild": 1}], [{"opType": "EmptySink", "opId": 1, "argChild": 7}], [{"opType": "EmptySink", "opId": 1}]):
        with pytest.raises(PlanError):
            validate({"rawQuery": "", "logicalRa": "", "fragments": [{"operators": ops}]})
    with pytest.raises(PlanError):
        e.read(key("none"))
    e.drop(key("e"))
    assert "public:test:e" not in e.list()


def test_recursion_that_reads_its_relation_twice(spark):
    e = Engine(spark)
    schema = {"columnTypes": ["LONG_TYPE", "LONG_TYPE"], "columnNames": ["a", "b"]}
    pairs = [(i, i + 1) for i in range(6)]
    e.ingest(key("chain"), {"readerType": "CSV", "schema": schema}, {"dataType": "Bytes", "bytes": base64.b64encode("".join(f"{a},{b}\n" for a, b in pairs).encode()).decode()})
    join = {"opType": "SymmetricHashJoin", "opId": 5, "argChild1": 3, "argChild2": 4, "argColumns1": [1], "argColumns2": [0], "argSelect1": [0], "argSelect2": [1]}
    reads = [{"opType": "LocalMultiwayConsumer", "opId": i, "argOperatorId": 2} for i in (3, 4)]
    plan = lambda state, more=(): sub({"opType": "TableScan", "opId": 0, "relationKey": key("chain")}, {"opType": "IDBController", "opId": 1, "argInitialInput": 0, "argIterationInput": 5, "argEosControllerInput": 6, "argState": state}, {"opType": "LocalMultiwayProducer", "opId": 2, "argChild": 1}, *reads, join, *more, {"opType": "LocalMultiwayConsumer", "opId": 6, "argOperatorId": 2}, {"opType": "EOSController", "opId": 7, "argChild": 6}, {"opType": "TempInsert", "opId": 8, "argChild": 1, "table": "t"})
    run = lambda *x: sorted(map(tuple, e.status(e.run({"rawQuery": "tc", "logicalRa": "", "plan": plan(*x)}))["temp"]["t"].collect()))
    assert run({"type": "DupElim"}) == sorted(closure(pairs)) and len(closure(pairs)) == 21
    # with an appender each way of making a path comes once: a path of n edges is made in Catalan(n - 1) ways
    ways = {n: math.comb(2 * n - 2, n - 1) // n for n in range(1, 7)}
    assert run({"type": "SimpleAppender"}) == sorted(p for p in closure(pairs) for _ in range(ways[p[1] - p[0]]))


def test_keys_have_tables_of_their_own(spark):
    keys = [("a__b", "c", "d"), ("a", "b__c", "d"), ("R", "x", "y"), ("r", "x", "y"), ("a_", "_b", "c"), ("a", "__b", "c"), ("a_0", "b", "c"), ("aé1", "b", "c"), ("a_1233z1", "b", "c")]
    tables = [RelationKey(*k).table for k in keys]
    assert len({t.lower() for t in tables}) == len(keys) and [RelationKey.of_table(t) for t in tables] == [RelationKey(*k) for k in keys]
    e = Engine(spark)
    for i, k in enumerate(keys[:4]):
        e.write(RelationKey(*k), spark.range(i + 1), True)
    assert [e.read(RelationKey(*k)).count() for k in keys[:4]] == [1, 2, 3, 4]


def test_a_catalog_outlives_its_engine(spark, tmp_path):
    e = Engine(spark, folder=f"file://{tmp_path}/catalog")
    by = {"type": "Hash", "indexes": [0]}
    e.write(key("kept"), spark.range(50).selectExpr("id k", "id % 3 v"), True, by)
    e.write(key("kept"), spark.range(50, 60).selectExpr("id k", "id % 3 v"))
    e.create_index(key("kept"), [{"index": 1}])
    e.register_function("plus_two", "(x BIGINT) RETURNS BIGINT RETURN x + 2", "long")
    n = e.run({"rawQuery": "look", "logicalRa": "", "fragments": sub({"opType": "TableScan", "opId": 1, "relationKey": key("kept")}, {"opType": "EmptySink", "opId": 2, "argChild": 1})["fragments"]})
    assert e.describe(key("kept"))["count"] == 60
    again = Engine(spark, folder=f"file://{tmp_path}/catalog")
    assert again.list() == e.list() and again.describe(key("kept"))["distribution"] == by and again.describe(key("kept"))["count"] == 60
    assert again.indexes["public:test:kept"] == [[{"index": 1}]] and "plus_two" in again.functions and again.status(n)["rawQuery"] == "look" and next(again.ids) == n + 1
    # stored by the hash of its key: a join on it needs no exchange
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = again.read(key("kept")).join(again.read(key("kept")).withColumnRenamed("v", "w"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again.drop(key("kept"))
    assert Engine(spark, folder=f"file://{tmp_path}/catalog").list() == []


def test_states_keep_their_types(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("x", 1, "b", big), ("x", 2, "a", 5), ("y", 1, "c", None)], "g string, i int, t string, k long")
    s, v = (lambda i: {"type": "STATE", "columnIdx": i}), (lambda i: {"type": "VARIABLE", "columnIdx": i})
    kind = {"type": "TYPE", "outputType": "STRING_TYPE"}
    first = emit(k=const("LONG_TYPE", 0), t=const("STRING_TYPE", ""), n=const("INT_TYPE", 7))
    step = emit(k=three("CONDITION", two("GT", v(3), s(0)), v(3), s(0)), t=two("CONCAT", s(1), two("CONCAT", v(2), two("CAST", v(1), kind))), n=two("IDIVIDE", two("PLUS", s(2), v(1)), const("INT_TYPE", 2)))
    spec = {"type": "UserDefined", "initializers": first, "updaters": step, "emitters": emit(k=two("GREATER", s(0), const("LONG_TYPE", 1)), t=s(1), h=one("HASH_MD5", s(0)), n=s(2))}
    md5 = lambda k: struct.unpack("<q", __import__("hashlib").md5(struct.pack("<q", k)).digest()[:8])[0]
    want = {("x", big, "b1a2", md5(big), 3), ("y", 1, "c1", md5(0), 4)}
    assert {tuple(r) for r in rel.aggregate(df, ["g"], [spec]).collect()} == want
    # the scan through sorted rows gives the same at each key's last row
    out = rel.stateful_apply(df, ["g"], ["i"], first, step, emit(g=v(0), i=v(1), k=two("GREATER", s(0), const("LONG_TYPE", 1)), t=s(1), h=one("HASH_MD5", s(0)), n=s(2)))
    assert {(r.g, r.k, r.t, r.h, r.n) for r in out.collect() if (r.g, r.i) != ("x", 1)} == want and dict(out.dtypes)["k"] == "bigint"


def test_trees_on_rows_equal_columns(spark):
    from quernel.functions.rows import Rows

    df = spark.createDataFrame([(5, -3, 2.5, -0.5, "aXb", True), (-7, 2, 1e10, 3.0, "", False), (0, 9, -4.75, 0.0, "é😀x", True), (None, None, None, None, None, None)], "i int, l long, d double, e double, s string, b boolean")
    v = lambda n: {"type": "VARIABLE", "columnIdx": df.columns.index(n)}
    kind = lambda t: {"type": "TYPE", "outputType": t}
    seven, x = const("INT_TYPE", 7), const("STRING_TYPE", "%x%")
    trees = [two("PLUS", v("i"), v("l")), two("MINUS", v("d"), v("i")), two("TIMES", v("l"), v("l")), two("DIVIDE", v("i"), v("e")), two("IDIVIDE", v("i"), seven), two("MODULO", v("i"), seven), two("MODULO", v("d"), v("l")), one("NEG", v("i")), one("ABS", v("d")), one("CEIL", v("d")), one("FLOOR", v("e")), one("SIN", v("d")), one("TAN", v("e")), one("LOG", v("l")), two("POW", v("d"), const("DOUBLE_TYPE", 2)), two("GREATER", v("i"), v("d")), two("LESSER", v("l"), v("i")), two("EQ", v("i"), v("l")), two("LTEQ", v("d"), v("e")), two("AND", v("b"), two("GT", v("i"), v("l"))), two("OR", v("b"), two("GT", v("i"), v("l"))), one("NOT", v("b")), three("CONDITION", v("b"), v("i"), v("d")), two("CAST", v("d"), kind("LONG_TYPE")), two("CAST", v("i"), kind("STRING_TYPE")), two("CAST", v("i"), kind("FLOAT_TYPE")), two("CAST", v("l"), kind("BOOLEAN_TYPE")), two("CONCAT", v("s"), v("s")), one("LEN", v("s")), one("UPPER", v("s")), two("LIKE", v("s"), x), two("LIKE", v("s"), v("s")), one("HASH_MD5", v("s")), one("HASH_MD5", v("i")), one("SQRT", v("l"))]
    compiler = Compiler(df)
    columns = df.select(*[compiler(t).alias(f"c{i}") for i, t in enumerate(trees)]).collect()
    for row, want in zip(df.collect(), columns, strict=True):
        for t, w in zip(trees, want, strict=True):
            got = Rows(compiler)(t)(tuple(row), ())
            assert got == w or got is None and w is None or isinstance(w, float) and (math.isnan(w) and math.isnan(got) or math.isclose(got, w, rel_tol=1e-12)), (t, row, got, w)
    for bad in (two("PLUS", const("INT_TYPE", 2**31 - 1), seven), two("CAST", const("STRING_TYPE", "1x"), kind("INT_TYPE"))):
        with pytest.raises((OverflowError, ValueError)):
            Rows(compiler)(bad)((), ())


def test_a_scan_is_linear_in_its_rows(spark):
    """A million rows of one partition, by a state that no running aggregate gives, against SQL."""
    import time

    df = spark.range(1_000_000).selectExpr("id", "id * 7919 % 1000003 as x")
    s = {"type": "STATE", "columnIdx": 0}
    step = three("CONDITION", two("EQ", two("MODULO", {"type": "VARIABLE", "columnIdx": 1}, const("LONG_TYPE", 100)), const("LONG_TYPE", 0)), const("LONG_TYPE", 0), two("PLUS", s, const("LONG_TYPE", 1)))
    began = time.time()
    got = rel.stateful_apply(df, [], ["id"], emit(n=const("LONG_TYPE", 0)), emit(n=step), emit(n=s)).agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert time.time() - began < 60
    import duckdb

    want = duckdb.sql("select sum(n), max(n), count(*) from (select i + 1 - max(case when x % 100 = 0 then i + 1 else 0 end) over (order by i) as n from (select i, i * 7919 % 1000003 as x from range(1000000) t(i)))").fetchall()[0]
    assert tuple(got) == tuple(map(int, want))


def test_delimited_text_in_every_way(spark, tmp_path):
    e, s = Engine(spark), Schema(("INT_TYPE", "STRING_TYPE"), ("i", "s"))
    text = "h\n1,'a|'b'\n2,'x\u2028y\x0cz'\n"
    want = [(1, "a'b"), (2, "x\u2028y\x0cz")]
    for skip in (1, 2, 3):
        p = tmp_path / f"{skip}.csv"
        p.write_text("h\n" * (skip - 1) + text)
        assert sorted(map(tuple, formats.read_csv(spark, str(p), s, quote="'", escape="|", skip=skip).collect())) == want
        reader = {"readerType": "CSV", "schema": {"columnTypes": s.types, "columnNames": s.names}, "quote": "'", "escape": "|", "skip": skip}
        source = {"dataType": "Bytes", "bytes": base64.b64encode(p.read_bytes()).decode()}
        assert sorted(map(tuple, e.source(reader, source).collect())) == want
    lines = {"dataType": "Bytes", "bytes": base64.b64encode(b'1,"a\nb"\r\n2,"c ""d""\n"\n').decode()}
    assert formats.records('1,"a\nb"\r\n2,c\n\n3,d') == ['1,"a\nb"', "2,c", "", "3,d"]
    assert sorted(map(tuple, e.source({"readerType": "CSV", "schema": {"columnTypes": s.types, "columnNames": s.names}, "escape": '"'}, lines).collect())) == [(1, "a\nb"), (2, 'c "d"\n')]
    with pytest.raises(Exception):  # noqa: B017
        e.source({"readerType": "CSV", "schema": {"columnTypes": s.types}}, {"dataType": "Bytes", "bytes": base64.b64encode(b"1,a,2").decode()}).collect()


def test_sinks_in_memory_and_profiles(spark):
    e = Engine(spark)
    data = {"dataType": "Bytes", "bytes": base64.b64encode(b"1\n2\n").decode()}
    scan = {"opType": "TupleSource", "opId": 1, "reader": {"readerType": "CSV", "schema": {"columnTypes": ["INT_TYPE"], "columnNames": ["a"]}}, "source": data}
    for kind in ("Bytes", "Pipe"):
        n = e.run({"rawQuery": "sink", "logicalRa": "", "profilingMode": ["QUERY"], "fragments": sub(scan, {"opType": "TupleSink", "opId": 2, "argChild": 1, "dataSink": {"dataType": kind}, "tupleWriter": {"writerType": "CSV"}})["fragments"]})
        q = e.status(n)
        assert (q["bytes"].decode().split() if kind == "Bytes" else list(q["pipe"])) == ["a", "1", "2"]
    assert e.span(n).count() == 1 and e.contribution(n).first().nanoTime > 0 and [r.opId for r in e.operator_log(n).collect()] == ["2"] and e.operator_log(n, least=10**15).count() == 0
    for ops in ([{"opType": "DbCreateView", "opId": 1, "viewName": "bad name", "viewDefinition": "SELECT 1"}], [{"opType": "DbCreateFunction", "opId": 1, "name": "f", "outputType": "INT_TYPE", "binary": "x"}]):
        with pytest.raises(PlanError):
            e.run({"rawQuery": "", "logicalRa": "", "fragments": [{"operators": ops}]})


def test_samples_of_workers(spark):
    df = spark.range(100).repartition(2).selectExpr("id % 2 as x")
    shares = lambda *rows: spark.createDataFrame([(*r, "WithoutReplacement") for r in rows], "WorkerID int, StreamSize int, SampleSize int, SampleType string")
    assert rel.sample_workers(df, shares((1, 50, 3), (2, 50, 0))).count() == 3
    again = shares((1, 50, 70), (2, 50, 1)).withColumn("SampleType", F.lit("WithReplacement"))
    assert rel.sample_workers(df, again).count() == 71
    for bad in (shares((1, 50, 60), (2, 50, 1)), shares((1, 50, 1), (1, 50, 1)), shares((0, 50, 1)), shares((9, 50, 1))):
        with pytest.raises(PlanError):
            rel.sample_workers(df, bad).count()
    with pytest.raises(PlanError):
        rel.sampling_distribution(spark.createDataFrame([(1, 4), (1, 6)], "w int, c long"), 3)
    # equal rows are drawn one by one
    drawn = [rel.sample_exact(spark.range(40).selectExpr("id % 2 as x"), 10, seed).agg(F.sum("x")).first()[0] for seed in range(6)]
    assert len(set(drawn)) > 1 and all(0 < n < 10 for n in drawn)


def test_readers_in_ranges(spark, tmp_path, monkeypatch):
    import os

    import numpy as np

    assert formats.NCHILADA.count(",") == 29 and [x.split()[0] for x in formats.NCHILADA.split(", ")][:14] == "iord igasord ESNRate FeMassFrac FeMassFracDot GasDensity HI HeI HeII Metalsdot OxMassFrac OxMassFracdot coolontime den".split()
    (tmp_path / "ints").write_text("7\n" + "\n".join(str(10 * i) for i in range(7)))
    assert formats.integers(str(tmp_path / "ints"), 2, 3).tolist() == [20, 30, 40] and formats.integers(str(tmp_path / "ints"), 6, 1).tolist() == [60]
    with pytest.raises(ValueError):
        formats.integers(str(tmp_path / "ints"), 5, 3)
    monkeypatch.setattr(formats, "RANGE", 3)
    assert [(p.start, p.n, p.before) for p in formats.ranges("p", "k", 7, 10)] == [(0, 3, 10), (3, 3, 13), (6, 1, 16)]
    for kind in ("gas", "star"):
        os.makedirs(tmp_path / "n" / kind)
    head = struct.pack(">idiiii", formats.MAGIC, 0.0, 0, 2, 1, formats.INT_CODE) + bytes(8)
    (tmp_path / "n" / "gas" / "iord").write_bytes(head + np.array([4, 5], ">i4").tobytes())
    (tmp_path / "g").write_text("2\n1\n1\n")
    assert [r.iord for r in formats.nchilada(spark, str(tmp_path / "n"), str(tmp_path / "g")).collect()] == [4, 5]
    (tmp_path / "n" / "gas" / "den").write_bytes(struct.pack(">idiiii", formats.MAGIC, 0.0, 0, 1, 1, formats.FLOAT_CODE) + bytes(12))
    with pytest.raises(Exception):  # noqa: B017
        formats.nchilada(spark, str(tmp_path / "n"), str(tmp_path / "g")).collect()
    (tmp_path / "b").write_bytes(b"\x00" * 7)
    with pytest.raises(Exception):  # noqa: B017
        formats.binary_rows(spark, str(tmp_path / "b"), Schema(("INT_TYPE",))).collect()


def test_readers(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("h1\nh2\n1,a\n2,b\n")
    s = Schema(("INT_TYPE", "STRING_TYPE"), ("i", "s"))
    assert [tuple(r) for r in formats.read_csv(spark, str(p), s, skip=2).collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception):  # noqa: B017
        formats.read_csv(spark, str(p), s).collect()
    b = tmp_path / "x.bin"
    b.write_bytes(struct.pack(">iH2s", 7, 2, b"hi") + struct.pack(">iH1s", 8, 1, b"x"))
    assert [tuple(r) for r in formats.binary_rows(spark, str(b), s).collect()] == [(7, "hi"), (8, "x")]
    f = tmp_path / "f.evt"
    f.write_bytes(struct.pack("<i", 1) + struct.pack("<i10H", 10, *range(10)))
    assert tuple(formats.seaflow(spark, str(f)).first()) == tuple(range(10))
    t = tmp_path / "t.bin"
    t.write_bytes(struct.pack(">diiiiii", 1.0, 3, 3, 1, 1, 1, 0) + struct.pack(">12f", *range(12)) + struct.pack(">9f", *range(9)) + struct.pack(">11f", *range(11)))
    for n in ("o", "g"):
        (tmp_path / n).write_text("3\n5\n6\n7\n")
    rows = formats.tipsy(spark, str(t), str(tmp_path / "o"), str(tmp_path / "g")).collect()
    assert [r.type for r in rows] == ["gas", "dark", "star"] and rows[0].phi == 11 and rows[1].eps == 7 and rows[1].rho == 0 and rows[2].metals == 7
    f.write_bytes(b"\x02\x00\x00\x00")
    with pytest.raises(Exception):  # noqa: B017
        formats.seaflow(spark, str(f)).collect()


def test_sessions(spark):
    from quernel.streaming import windows

    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,i * i,0) as ts, 1 as u from range(5) t(i)")
    assert sorted(r.n for r in windows.sessions(df, "ts", "4 minutes", ["u"], n=F.count("*")).collect()) == [1, 1, 3]


@pytest.mark.parametrize("name", [*suite.QUERIES, *scenarios.QUERIES])
def test_suite_matches_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = (suite.QUERIES | scenarios.QUERIES)[name](spark, sf)
    cols = sorted(df.columns)
    r = c.sql((suite.ORACLES | scenarios.ORACLES)[name])
    at = [list(r.columns).index(x) for x in cols]
    norm = lambda rows: sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert norm(df.select(*[f"`{x}`" for x in cols]).collect()) == norm(tuple(x[i] for i in at) for x in r.fetchall())


def test_algebraic_aggregates_equal_folds(spark):
    df = spark.sql("select id % 3 as g, id as x from range(20) t(id)")
    s, x = (lambda i: {"type": "STATE", "columnIdx": i}), {"type": "VARIABLE", "columnIdx": 1}
    zero = const("LONG_TYPE", 0)
    plain = {"type": "UserDefined", "initializers": emit(n=zero, q=zero, m=zero, l=const("LONG_TYPE", 5)), "updaters": emit(n=two("PLUS", s(0), const("LONG_TYPE", 1)), q=two("PLUS", two("TIMES", x, x), s(1)), m=two("GREATER", s(2), x), l=two("LESSER", s(3), x)), "emitters": emit(n=s(0), q=s(1), m=s(2), l=s(3))}
    fold = plain | {"initializers": plain["initializers"] + emit(p=zero), "updaters": plain["updaters"] + emit(p=two("PLUS", two("PLUS", s(4), s(0)), zero))}
    a, b = (rel.aggregate(df, ["g"], [spec]) for spec in (plain, fold))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [(0, 7, 819, 18, 0), (1, 7, 952, 19, 1), (2, 6, 699, 17, 2)]
    assert "collect_list" not in a._jdf.queryExecution().toString() and "collect_list" in b._jdf.queryExecution().toString()
    assert tuple(rel.aggregate(df.where("false"), [], [plain]).first()) == (0, 0, 0, 5)


def test_sampling_distribution_of_many_rows(spark):
    df = spark.createDataFrame([(1, 3 * 10**12), (2, 10**12), (3, 0)], "w int, c long")
    for replace in (False, True):
        rows = rel.sampling_distribution(df.select("w", "c", F.lit(1)), 4 * 10**6, replace=replace).collect()
        assert sum(r.SampleSize for r in rows) == 4 * 10**6 and abs(rows[0].SampleSize - 3 * 10**6) < 10**4 and rows[2].SampleSize == 0
    few = spark.createDataFrame([(1, 4), (2, 6)], "w int, c long")
    assert [r.SampleSize for r in rel.sampling_distribution(few, 10).collect()] == [4, 6]
    with pytest.raises(PlanError):
        rel.sampling_distribution(few, 11)


def test_download_blob(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(b"\x00\xff")
    (tmp_path / "out").write_bytes(b"no")
    df = spark.createDataFrame([(f"file://{tmp_path}/in/x",), (f"{tmp_path}/in/../out",), (f"{tmp_path}/in/none",), ("ftp://x",)], "u string")
    e = emit(b={"type": "DOWNLOADBLOB", "operand": {"type": "VARIABLE", "columnIdx": 0}})
    spark.conf.set("quernel.blobFolders", f"{tmp_path}/in")
    try:
        assert [r.b for r in rel.apply(df, e).collect()] == [b"\x00\xff", None, None, None]
    finally:
        spark.conf.unset("quernel.blobFolders")


def test_binary_copy_files(spark, tmp_path):
    df = spark.sql("select 7 as i, 8L as l, 'é' as s, true as b, cast(null as double) as d, timestamp'2000-01-01 00:00:01' as t")
    for _ in range(2):  # the second replaces the first
        formats.write_copy(df.coalesce(1), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").iterdir()
    want = b"PGCOPY\n\xff\r\n\x00" + struct.pack(">ii", 0, 0) + struct.pack(">h", 6) + struct.pack(">iiiq", 4, 7, 8, 8) + struct.pack(">i", 2) + "é".encode() + struct.pack(">i?iiq", 1, True, -1, 8, 10**6) + struct.pack(">h", -1)
    assert file.name.startswith("part-") and file.read_bytes() == want


def test_database_tables(spark):
    url = "jdbc:derby:memory:quernel;create=true"
    e = Engine(spark)
    e.write("public:test:j", spark.range(10).selectExpr("id as A", "cast(id as string) as B"), True)
    e.export_jdbc("public:test:j", url, "J", True)
    e.ingest_jdbc("public:test:k", url, "J", split=("A", 0, 10, 3))
    assert sorted(map(tuple, e.read("public:test:k").collect())) == [(i, str(i)) for i in range(10)]


def test_server(spark):
    import json
    import threading
    import time
    import urllib.error
    import urllib.request

    server = serve(Engine(spark), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body else None, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as x:
            return x.code, x.read().decode()

    def ask(*args):
        return json.loads(call(*args)[1])

    try:
        schema = {"columnTypes": ["LONG_TYPE"], "columnNames": ["a"]}
        data = {"reader": {"readerType": "CSV", "schema": schema}, "source": {"dataType": "Bytes", "bytes": base64.b64encode(b"1\n2\n").decode()}}
        assert call("POST", "/dataset", {"relationKey": key("srv"), "overwrite": True, **data})[0] == 201
        at = "/dataset/user-public/program-test/relation-srv"
        assert ask("GET", at)["count"] == 2 and sorted(call("GET", at + "/data?format=csv")[1].split()) == ["1", "2", "a"]
        assert sorted(r["a"] for r in ask("GET", at + "/data?format=json")) == [1, 2]
        plan = {"rawQuery": "copy", "logicalRa": "", "profilingMode": ["QUERY"], "fragments": sub({"opType": "TableScan", "opId": 1, "relationKey": key("srv")}, {"opType": "TempInsert", "opId": 2, "argChild": 1, "table": "t"})["fragments"]}
        status, text = call("POST", "/query", plan)
        n = json.loads(text)["id"]
        for _ in range(120):
            if (state := ask("GET", f"/query/query-{n}"))["status"] not in ("ACCEPTED", "RUNNING"):
                break
            time.sleep(0.5)
        assert status == 202 and state["status"] == "SUCCESS"
        assert "Parsed Logical Plan" in ask("GET", f"/query/query-{n}/subquery-1")[0]
        assert [r["numTuples"] for r in ask("GET", f"/logs/profiling?queryId={n}")] == [2] and ask("GET", f"/logs/histogram?queryId={n}")
        assert ask("GET", f"/logs/range?queryId={n}") and ask("GET", f"/logs/contribution?queryId={n}")[0]["opId"] == "2" and ask("GET", f"/logs/operators?queryId={n}")
        assert call("GET", "/function/none")[0] == 400 and call("GET", "/workers")[0] == 200 and call("POST", at + "/persist", {"path": "/tmp/quernel_x"})[0] == 400
        assert [q["id"] for q in ask("GET", "/query?q=copy&limit=1")] == [n] and call("GET", "/query/query-99")[0] == 404
        assert call("POST", "/query/validate", {"rawQuery": 1})[0] == 400 and call("GET", "/nothing")[0] == 404 and call("POST", "/function", {"name": "f", "binary": "x"})[0] == 400
        assert call("DELETE", at)[0] == 200 and "public:test:srv" not in ask("GET", "/dataset")
    finally:
        server.shutdown()
        server.server_close()


def test_streams_to_files(spark, sf, tmp_path):
    from quernel.streaming import windows

    (tmp_path / "in").mkdir()
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in windows.run_to(stream(), str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in windows.run_to(stream(), str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4, 5, 6]
    none = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).where("id < 0")
    assert windows.run_to(none, str(tmp_path / "none")).count() == 0


def test_generated_relations(spark):
    assert [r.x for r in generated.tuple_range(spark, 3, "STRING_TYPE", "x").collect()] == ["0", "1", "2"]
    with pytest.raises(PlanError):
        generated.tuple_range(spark, 3, "BLOB_TYPE")
    one = generated.batch(spark, [(1, "a")], Schema(("INT_TYPE", "STRING_TYPE"), ("i", "s")))
    assert [tuple(r) for r in generated.repeated(one, 2).collect()] == [(1, "a"), (1, "a")] and generated.repeated(one, 0).count() == 0
    assert generated.singleton(spark).collect()[0][0] == 0 and generated.empty(spark, Schema(("INT_TYPE",))).count() == 0


def test_files_of_sources_are_written_by_tasks(spark, sf, tmp_path, monkeypatch):
    """No rows come to the driver, and large tables become several files."""
    for name in ("toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda *a, **k: pytest.fail("rows are sent to the driver"))
    for name in ("source_seaflow", "source_binary", "source_binary_text", "source_tipsy", "source_nchilada"):
        assert scenarios.QUERIES[name](spark, sf).count() > 0
    monkeypatch.setattr(formats, "RANGE", 3)
    df = spark.range(10).coalesce(1).selectExpr("id * 7000 time", "id chl_big")
    path = formats.write_seaflow(df, str(tmp_path / "s"))
    assert path.count(",") == 3 and sorted((r.time, r.D1, r.chl_big) for r in formats.seaflow(spark, path).collect()) == [(7000 * i, 0, i) for i in range(10)]
    assert formats.seaflow(spark, formats.write_seaflow(df.limit(0), str(tmp_path / "none"))).count() == 0
    for bad in ("70000 time", "cast(null as int) time"):
        with pytest.raises(Exception):  # noqa: B017
            formats.write_seaflow(df.selectExpr(bad), str(tmp_path / "bad"))
    rows = spark.range(8).coalesce(1).selectExpr("id + 100 iOrder", "id mass", "float(id) x", "float(id + 1) y", "float(id + 2) z", "id metals", "9 - id grp", "element_at(array('gas', 'dark', 'star'), int(id % 3) + 1) type")
    paths = formats.write_tipsy(rows, str(tmp_path / "t"))
    assert paths[0].count(",") == 2
    assert sorted(tuple(r) for r in formats.tipsy(spark, *paths).select("iOrder", "mass", "z", "metals", "grp", "type").collect()) == [(i + 100, i, i + 2, i * (i % 3 != 1), 9 - i, ("gas", "dark", "star")[i % 3]) for i in range(8)]
    paths = formats.write_nchilada(rows.withColumn("metals", F.expr("float(metals)")), str(tmp_path / "n"), {"gas": ["metals"], "dark": ["x", "y", "z"], "star": ["metals"]})
    assert paths[0].count(",") == 2
    assert sorted(tuple(r) for r in formats.nchilada(spark, *paths).select("grp", "metals", "type").collect()) == [(9 - i, i * (i % 3 != 1), ("gas", "dark", "star")[i % 3]) for i in range(7, -1, -1)]


def test_generations(spark, monkeypatch):
    """Against the rules as they stand, where nodes have several parents; only pairs of parents are written."""
    import random

    from quernel.operators import iterate

    for seed, piece in ((1, 1000), (2, 2)):
        monkeypatch.setattr(iterate, "PIECE", piece)
        draw = random.Random(seed)
        arcs = {(draw.randrange(level * 6, level * 6 + 6), draw.randrange(level * 6 + 6, level * 6 + 12)) for level in range(3) for _ in range(9)}
        held, new = set(), {(p, q) for a, p in arcs for b, q in arcs if a == b and p != q}
        while new - held:
            held |= new
            new = {(p, q) for a, p in arcs for b, q in arcs if (a, b) in held}
        found = [tuple(r) for r in iterate.generations(spark.createDataFrame([*arcs, *arcs], "a long, b long")).collect()]
        assert sorted(found) == sorted(held) and any(x == y for x, y in held)
    written = []
    monkeypatch.setattr(iterate, "cut", lambda df, f=iterate.cut: written.append((out := f(df)).count()) or out)
    assert iterate.generations(spark.range(400).selectExpr("id % 2 a", "id + 10 b")).count() == 2 * 200 * 199
    assert sum(written) < 2000


def test_a_cube_does_not_grow_with_the_partitions(spark, sf, monkeypatch):
    """Each row is sent to as many cells, whatever the size of the tables, and is not written before."""
    seen, hypercube, before = [], suite.rel.hypercube, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(suite.rel, "hypercube", lambda df, cube, hashed: seen.append(tuple(cube)) or hypercube(df, cube, hashed))
    monkeypatch.setattr(suite, "cut", lambda df: pytest.fail("the sides are written"))
    try:
        for n in (4, 400):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            suite.QUERIES["hypercube_triangle"](spark, sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(seen)) == 1 and seen[0][0] * seen[0][1] * seen[0][2] <= 64


def test_rounds_broadcast_nothing(spark, sf, monkeypatch):
    """What a round joins does not pass through the driver, however small it is."""
    from quernel.operators import iterate

    plans = []
    monkeypatch.setattr(iterate, "cut", lambda df, f=iterate.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    assert scenarios.QUERIES["mutual_recursion"](spark, sf).count() > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    rows = lambda *v: spark.createDataFrame([(x, 1) for x in v], "a int, b int")
    assert sorted(r.a for r in iterate.DupElim().fresh(rows(1, None), rows(1, 2, 2, 3, None)).collect()) == [2, 3]

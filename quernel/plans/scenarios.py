"""Queries through whole plans, and over sources, sinks, relations, functions and streams, with their SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Schema
from ..operators import relational as rel
from ..operators.iterate import STATES, DupElim, cut, fixpoint, shared
from ..sources import formats, generated
from ..streaming import windows
from . import suite
from .program import Engine
from .suite import PARENTS, const, emit, one, parents, read, three, two, var

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(suite.query, queries=QUERIES, oracles=ORACLES)


def col(i: int) -> dict:
    return {"type": "VARIABLE", "columnIdx": i}


def op(kind: str, at: int, **fields) -> dict:
    return {"opType": kind, "opId": at, **fields}


def sub(*fragments: list[dict]) -> dict:
    return {"type": "SubQuery", "fragments": [{"operators": f} for f in fragments]}


def scan(spark, d, at: int, name: str, sql: str, /, **columns: str) -> dict:
    """A query over a table of the input."""
    read(spark, d, name).createOrReplaceTempView(name)
    return op("DbQueryScan", at, schema={"columnTypes": list(columns.values()), "columnNames": list(columns)}, sql=sql)


def ran(spark: SparkSession, text: str, plan: dict, engine: Engine | None = None) -> dict[str, DataFrame]:
    """The temporary relations that a plan leaves."""
    engine = engine or Engine(spark)
    return engine.status(engine.run({"rawQuery": text, "logicalRa": "", "plan": plan}))["temp"]


def key(name: str) -> dict:
    """A relation of a run of its own, since a warehouse may outlive the catalog of its tables."""
    return {"userName": "public", "programName": f"suite_{uuid.uuid4().hex}", "relationName": name}


# plans


@query("SELECT c_mktsegment AS segment, count(*) AS count_price, max(o_totalprice) AS max_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment")
def plan_join_aggregate(spark, d):
    orders = scan(spark, d, 1, "orders", "SELECT o_custkey, o_totalprice FROM orders", k="LONG_TYPE", price="DOUBLE_TYPE")
    customers = scan(spark, d, 3, "customer", "SELECT c_custkey, c_mktsegment FROM customer", k="LONG_TYPE", segment="STRING_TYPE")
    by_key = {"type": "Hash", "indexes": [0]}
    plan = sub(
        [orders, op("ShuffleProducer", 2, argChild=1, distributeFunction=by_key)],
        [customers, op("ShuffleProducer", 4, argChild=3, distributeFunction=by_key)],
        [
            op("ShuffleConsumer", 5, argOperatorId=2),
            op("ShuffleConsumer", 6, argOperatorId=4),
            op("SymmetricHashJoin", 7, argChild1=5, argChild2=6, argColumns1=[0], argColumns2=[0], argSelect1=[1], argSelect2=[1]),
            op("Filter", 8, argChild=7, argPredicate={"rootExpressionOperator": two("GT", col(0), const("DOUBLE_TYPE", 1000))}),
            op("Aggregate", 9, argChild=8, argGroupFields=[1], aggregators=[{"type": "Primitive", "column": 0, "aggOps": ["COUNT", "MAX"]}]),
            op("TempInsert", 10, argChild=9, table="out"),
        ],
    )
    return ran(spark, "join and aggregate", plan)["out"]


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM " + PARENTS + "), tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def plan_recursion(spark, d):
    parents(spark, d).select("a", "b").distinct().createOrReplaceTempView("parents")
    edges = op("DbQueryScan", 1, schema={"columnTypes": ["LONG_TYPE", "LONG_TYPE"], "columnNames": ["a", "b"]}, sql="SELECT a, b FROM parents")
    plan = sub(
        [edges, op("LocalMultiwayProducer", 2, argChild=1)],
        [
            op("LocalMultiwayConsumer", 3, argOperatorId=2),
            op("IDBController", 4, argInitialInput=3, argIterationInput=9, argEosControllerInput=10, argState={"type": "DupElim"}),
            op("LocalMultiwayProducer", 5, argChild=4),
        ],
        [
            op("LocalMultiwayConsumer", 6, argOperatorId=5),
            op("LocalMultiwayConsumer", 7, argOperatorId=2),
            op("SymmetricHashJoin", 8, argChild1=6, argChild2=7, argColumns1=[1], argColumns2=[0], argSelect1=[0], argSelect2=[1], argColumnNames=["a", "b"]),
            op("ShuffleProducer", 11, argChild=8, distributeFunction={"type": "Hash", "indexes": [0]}),
        ],
        [op("ShuffleConsumer", 9, argOperatorId=11), op("TempInsert", 12, argChild=4, table="out")],
        [op("LocalMultiwayConsumer", 10, argOperatorId=5), op("EOSController", 13, argChild=10)],
    )
    return ran(spark, "recursion", plan)["out"]


@query("WITH m AS (SELECT max(c_custkey) + 1 AS top FROM customer), h AS (SELECT min(i) AS i FROM generate_series(1, 60) t(i), m WHERE top >> i::BIGINT <= 100) SELECT c_custkey AS k, (c_custkey + 1) >> i::BIGINT AS v FROM customer, h")
def plan_do_while(spark, d):
    """Halves all values until the largest is at most 100."""
    start = sub([scan(spark, d, 1, "customer", "SELECT c_custkey, c_custkey + 1 FROM customer", k="LONG_TYPE", v="LONG_TYPE"), op("TempInsert", 2, argChild=1, table="x")])
    body = sub(
        [
            op("TempTableScan", 1, table="x"),
            op("Apply", 2, argChild=1, emitExpressions=emit(k=col(0), v=two("IDIVIDE", col(1), const("LONG_TYPE", 2)))),
            op("TempInsert", 3, argChild=2, table="x"),
            op("Aggregate", 4, argChild=2, argGroupFields=[], aggregators=[{"type": "Primitive", "column": 1, "aggOps": ["MAX"]}]),
            op("Apply", 5, argChild=4, emitExpressions=emit(more=two("GT", col(0), const("LONG_TYPE", 100)))),
            op("TempInsert", 6, argChild=5, table="more"),
        ]
    )
    return ran(spark, "halve", {"type": "Sequence", "plans": [start, {"type": "DoWhile", "body": [body], "condition": "more"}]})["x"]


@query("SELECT n_name AS nation, r_name AS region, s_name AS supplier FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def plan_multiway_join(spark, d):
    plan = sub(
        [
            scan(spark, d, 1, "nation", "SELECT n_nationkey, n_regionkey, n_name FROM nation", n="INT_TYPE", r="INT_TYPE", name="STRING_TYPE"),
            scan(spark, d, 2, "region", "SELECT r_regionkey, r_name FROM region", r="INT_TYPE", name="STRING_TYPE"),
            scan(spark, d, 3, "supplier", "SELECT s_nationkey, s_name FROM supplier", n="INT_TYPE", name="STRING_TYPE"),
            op("LeapFrogJoin", 4, argChildren=[1, 2, 3], joinFieldMapping=[[[0, 1], [1, 0]], [[0, 0], [2, 0]]], outputFieldMapping=[[0, 2], [1, 1], [2, 1]], argColumnNames=["nation", "region", "supplier"]),
            op("TempInsert", 5, argChild=4, table="out"),
        ]
    )
    return ran(spark, "multiway join", plan)["out"]


@query("SELECT column_index::INTEGER - 1 AS col_index, column_name AS col_name, column_name = 'r_regionkey' AS is_indexed FROM duckdb_columns() WHERE table_name = 'region'")
def plan_catalog_scan(spark, d):
    """The columns of a relation, one of them indexed by a plan, as the catalog has them."""
    e, regions = Engine(spark), key("regions")
    e.write(regions, read(spark, d, "region"), overwrite=True)
    names = ["col_index", "col_name", "is_indexed"]
    index = sub([op("DbCreateIndex", 1, relationKey=regions, indexes=[[{"index": 0}]])])
    look = op("CatalogScan", 1, schema={"columnTypes": ["INT_TYPE", "STRING_TYPE", "BOOLEAN_TYPE"], "columnNames": names}, sql=f"SELECT {', '.join(names)} FROM relation_schema WHERE relation_name = 'regions'")
    return ran(spark, "catalog", {"type": "Sequence", "plans": [index, sub([look, op("TempInsert", 2, argChild=1, table="out")])]}, e)["out"]


@query("SELECT c_custkey AS k, c_nationkey * c_nationkey AS square FROM customer WHERE c_acctbal < 0")
def plan_view_and_function(spark, d):
    """A view and a function that a plan makes, and a statement, used by the next."""
    read(spark, d, "customer").createOrReplaceTempView("customer")
    make = sub([
        op("DbCreateView", 1, viewName="owing", viewDefinition="SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0"),
        op("DbCreateFunction", 2, name="times_itself", outputType="INT_TYPE", sql="(x INT) RETURNS INT RETURN x * x"),
        op("DbExecute", 3, sqlQuery="CREATE OR REPLACE TEMPORARY VIEW owing_now AS SELECT * FROM owing"),
    ])
    look = op("DbQueryScan", 1, schema={"columnTypes": ["LONG_TYPE", "INT_TYPE"], "columnNames": ["k", "n"]}, sql="SELECT c_custkey, c_nationkey FROM owing_now")
    call = op("Apply", 2, argChild=1, emitExpressions=emit(k=col(0), square={"type": "PYUDF", "name": "times_itself", "children": [col(1)]}))
    return ran(spark, "view", {"type": "Sequence", "plans": [make, sub([look, call, op("TempInsert", 3, argChild=2, table="out")])]})["out"]


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM " + PARENTS + "), tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def plan_recursion_nonlinear(spark, d):
    """Paths made of two paths: a rule that reads its relation twice."""
    parents(spark, d).select("a", "b").distinct().createOrReplaceTempView("parents")
    edges = op("DbQueryScan", 1, schema={"columnTypes": ["LONG_TYPE", "LONG_TYPE"], "columnNames": ["a", "b"]}, sql="SELECT a, b FROM parents")
    plan = sub(
        [edges, op("IDBController", 4, argInitialInput=1, argIterationInput=8, argEosControllerInput=10, argState={"type": "DupElim"}), op("LocalMultiwayProducer", 5, argChild=4)],
        [
            op("LocalMultiwayConsumer", 6, argOperatorId=5),
            op("LocalMultiwayConsumer", 7, argOperatorId=5),
            op("SymmetricHashJoin", 8, argChild1=6, argChild2=7, argColumns1=[1], argColumns2=[0], argSelect1=[0], argSelect2=[1], argColumnNames=["a", "b"]),
            op("TempInsert", 12, argChild=4, table="out"),
        ],
        [op("LocalMultiwayConsumer", 10, argOperatorId=5), op("EOSController", 13, argChild=10)],
    )
    return ran(spark, "recursion", plan)["out"]


@query("SELECT 300::BIGINT AS n, 300::BIGINT AS known, true AS fair FROM (SELECT count(*) FROM customer)")
def plan_sample(spark, d):
    """Three hundred customers of reservoirs of two hundred a worker, each worker giving its share."""
    read(spark, d, "customer").repartition(4).createOrReplaceTempView("dealt")
    held = sub([op("DbQueryScan", 1, schema={"columnTypes": ["LONG_TYPE", "STRING_TYPE"], "columnNames": ["k", "name"]}, sql="SELECT c_custkey, c_name FROM dealt"), op("SampledDbInsertTemp", 2, argChild=1, sampleSize=300, sampleTable="rows", countTable="sizes", randomSeed=5)])
    shares = sub([op("TempTableScan", 1, table="sizes"), op("SamplingDistribution", 2, argChild=1, sampleSize=300, sampleType="WithoutReplacement", randomSeed=6), op("TempInsert", 3, argChild=2, table="shares")])
    draw = sub([op("TempTableScan", 1, table="shares"), op("TempTableScan", 2, table="rows"), op("Sample", 3, argChild1=1, argChild2=2, randomSeed=7), op("TempInsert", 4, argChild=3, table="out")])
    temp = ran(spark, "sample", {"type": "Sequence", "plans": [held, shares, draw]})
    known = temp["out"].distinct().join(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k", "name"], "left_semi").agg(F.count("*").alias("known"))
    fair = temp["shares"].agg(((F.min("SampleSize") > 0) & (F.sum("SampleSize") == 300) & (F.count("*") > 1)).alias("fair"))
    return temp["out"].agg(F.count("*").alias("n")).join(known, F.lit(True)).join(fair, F.lit(True))


# sources and sinks


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def sink_and_source_csv(spark, d):
    """Written as delimited text by one plan and read by the next."""
    path = shared(spark)
    columns = {"c_custkey": "LONG_TYPE", "c_name": "STRING_TYPE", "c_acctbal": "DOUBLE_TYPE", "c_mktsegment": "STRING_TYPE"}
    out = sub([scan(spark, d, 1, "customer", f"SELECT {', '.join(columns)} FROM customer", **columns), op("TupleSink", 2, argChild=1, tupleWriter={"writerType": "CSV"}, dataSink={"dataType": "Uri", "uri": path})])
    reader = {"readerType": "CSV", "skip": 1, "schema": {"columnTypes": list(columns.values()), "columnNames": list(columns)}}
    back = sub([op("TupleSource", 1, reader=reader, source={"dataType": "URI", "uri": path}), op("TempInsert", 2, argChild=1, table="out")])
    return ran(spark, "text files", {"type": "Sequence", "plans": [out, back]})["out"]


@query("SELECT i::VARCHAR AS v FROM generate_series(0, 999) t(i) UNION ALL SELECT n_name FROM nation, generate_series(1, 3)  UNION ALL SELECT '0'")
def generated_sources(spark, d):
    """A range, repeated rows, one row and none."""
    names = read(spark, d, "nation").select(F.col("n_name").alias("v"))
    one_row = generated.singleton(spark).select(F.col("privateSingletonColumn").cast("string").alias("v"))
    return rel.union_all(generated.tuple_range(spark, 1000, "STRING_TYPE", "v"), generated.repeated(names, 3), one_row, generated.empty(spark, Schema(("STRING_TYPE",), ("v",))))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def relation_append(spark, d):
    e, parties = Engine(spark), key("parties")
    e.write(parties, read(spark, d, "customer").selectExpr("c_custkey k", "c_name name"), overwrite=True)
    e.write(parties, read(spark, d, "supplier").selectExpr("s_suppkey k", "s_name name"))
    return e.read(parties)


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey")
def relation_view(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("customer")
    Engine(spark).create_view("debtors", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0")
    return rel.aggregate(spark.table("debtors"), ["c_nationkey"], [{"type": "CountAll"}]).withColumnRenamed("count_all", "n")


@query("SELECT count(*) AS n, true AS full_, true AS own FROM customer")
def sampled_insert_counts(spark, d):
    """Seven rows a partition, or all if there are fewer, and the partitions' sizes."""
    plan = sub([scan(spark, d, 1, "customer", "SELECT c_custkey FROM customer", k="LONG_TYPE"), op("SampledDbInsertTemp", 2, argChild=1, sampleSize=7, sampleTable="rows", countTable="sizes", randomSeed=5)])
    temp = ran(spark, "sample", plan)
    sizes = temp["sizes"].agg(F.sum("PartitionSize").alias("n"), F.sum("PartitionSampleSize").alias("kept"), F.expr("every(PartitionSampleSize = least(PartitionSize, 7))").alias("full_"))
    rows = temp["rows"].distinct().join(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", "left_semi").agg(F.count("*").alias("m"))
    return sizes.join(rows, F.lit(True)).select("n", "full_", (F.col("kept") == F.col("m")).alias("own"))


@query("SELECT c_custkey, c_acctbal, c_nationkey, c_nationkey % 2 = 0 AS even FROM customer")
def source_binary(spark, d):
    """Rows of fixed size, read in ranges."""
    path = formats.write_binary(read(spark, d, "customer").selectExpr("c_custkey", "c_acctbal", "c_nationkey", "c_nationkey % 2 = 0"), shared(spark))
    return formats.binary_rows(spark, path, Schema(("LONG_TYPE", "DOUBLE_TYPE", "INT_TYPE", "BOOLEAN_TYPE"), ("c_custkey", "c_acctbal", "c_nationkey", "even")))


@query("SELECT p_partkey, p_name FROM part")
def source_binary_text(spark, d):
    path = formats.write_binary(read(spark, d, "part").select("p_partkey", "p_name"), shared(spark), little=True)
    return formats.binary_rows(spark, path, Schema(("LONG_TYPE", "STRING_TYPE"), ("p_partkey", "p_name")), little=True)


@query("""SELECT row_number() OVER (ORDER BY t, k) + 1000 AS "iOrder", k::FLOAT AS mass, CASE WHEN t = 0 THEN 8 ELSE 0 END::FLOAT AS rho, CASE WHEN t = 2 THEN 9 ELSE 0 END::FLOAT AS tform, CASE WHEN t > 0 THEN 10 ELSE 0 END::FLOAT AS eps, 11::FLOAT AS phi, (k % 7)::INTEGER AS grp, ['gas', 'dark', 'star'][t + 1] AS type
FROM (SELECT (c_nationkey % 3)::INTEGER AS t, c_custkey AS k FROM customer)""")
def source_tipsy(spark, d):
    """Particles of three kinds, with their order and group files."""
    rows = rel.counter(read(spark, d, "customer").selectExpr("c_nationkey % 3 t", "c_custkey k"), "i", ["t", "k"])
    kinds = rows.selectExpr("i + 1001 iOrder", "k mass", "if(t = 0, 8, 0) rho", "if(t = 2, 9, 0) tform", "if(t > 0, 10, 0) eps", "11 phi", "k % 7 grp", "element_at(array('gas', 'dark', 'star'), t + 1) type")
    return formats.tipsy(spark, *formats.write_tipsy(kinds, shared(spark))).select("iOrder", "mass", "rho", "tform", "eps", "phi", "grp", "type")


@query('SELECT o_custkey % 60000 AS time, (o_orderkey % 60000)::INTEGER AS "D1", (o_custkey % 7)::INTEGER AS chl_big FROM orders'.replace("o_custkey % 60000 AS time", "(o_custkey % 60000)::INTEGER AS time"))
def source_seaflow(spark, d):
    path = formats.write_seaflow(read(spark, d, "orders").selectExpr("o_custkey % 60000 time", "o_orderkey % 60000 D1", "o_custkey % 7 chl_big"), shared(spark))
    return formats.seaflow(spark, path).select("time", "D1", "chl_big")


@query("""SELECT i AS iord, CASE WHEN t = 'gas' THEN 5 ELSE 0 END AS igasord, CASE WHEN t = 'gas' THEN k ELSE 0 END::FLOAT AS "GasDensity", CASE WHEN t = 'star' THEN k ELSE 0 END::FLOAT AS massform, k::FLOAT AS x, (k + 1)::FLOAT AS y, (k + 2)::FLOAT AS z, (k % 5)::INTEGER AS grp, t AS type
FROM (SELECT s_suppkey AS k, s_suppkey::INTEGER AS i, CASE WHEN s_suppkey % 2 = 0 THEN 'gas' ELSE 'star' END AS t FROM supplier)""")
def source_nchilada(spark, d):
    """Particles by folder and attribute; dark ones have none."""
    rows = read(spark, d, "supplier").selectExpr("s_suppkey k", "s_suppkey % 2 = 0 gas").selectExpr(
        "k iord", "5L igasord", "float(k) GasDensity", "float(k) massform", "float(k) x", "float(k + 1) y", "float(k + 2) z", "k % 5 grp", "if(gas, 'gas', 'star') type"
    )
    xyz = ["iord", "x", "y", "z"]
    path, groups = formats.write_nchilada(rows, shared(spark), {"gas": [*xyz, "igasord", "GasDensity"], "star": [*xyz, "massform"]})
    return formats.nchilada(spark, path, groups).select("iord", "igasord", "GasDensity", "massform", "x", "y", "z", "grp", "type")


# expressions and functions


@query("SELECT n_nationkey, ((ord(n_name[j + 1]) >> i) & 1) = 1 AS bit FROM nation, generate_series(0, 40) t(j), generate_series(0, 7) s(i) WHERE j < length(n_name)")
def flatmap_bits(spark, d):
    df = read(spark, d, "nation").withColumn("blob", F.col("n_name").cast("binary"))
    return rel.apply(df, emit(n_nationkey=var(df, "n_nationkey"), bit=one("BITSET", var(df, "blob"))))


@query("SELECT n_nationkey, upper(hex(substr(n_name, 2, 2))) AS bytes FROM nation")
def apply_byte_range(spark, d):
    df = read(spark, d, "nation").withColumn("blob", F.col("n_name").cast("binary"))
    out = rel.apply(df, emit(n_nationkey=var(df, "n_nationkey"), b=three("BYTERANGE", var(df, "blob"), const("INT_TYPE", 1), const("INT_TYPE", 3))))
    return out.select("n_nationkey", F.hex("b").alias("bytes"))


@query("SELECT count(*) AS n, true AS good FROM orders")
def apply_random_worker(spark, d):
    df = read(spark, d, "orders")
    out = rel.apply(df, emit(r={"type": "RANDOM"}, w={"type": "WORKERID"}))
    return out.agg(F.count("*").alias("n"), F.expr("every(r >= 0 and r < 1 and w >= 1)").alias("good"))


@query("SELECT p_partkey, upper(p_brand[1:1]) || p_type[-1:] AS ends, p_size * p_size AS square FROM part")
def functions_of_users(spark, d):
    """A Python function, in Arrow batches, and one in SQL."""
    e = Engine(spark)
    e.register_function("ends", lambda brand, kind: brand[:1].upper() + kind[-1:], "string")
    e.register_function("squared", "(x INT) RETURNS INT RETURN x * x", "int")
    df = read(spark, d, "part")
    call = lambda name, *cs: {"type": "PYUDF", "name": name, "children": [var(df, c) for c in cs]}
    return rel.apply(df, emit(p_partkey=var(df, "p_partkey"), ends=call("ends", "p_brand", "p_type"), square=call("squared", "p_size")), functions=e.functions)


# aggregates and states


@query("SELECT p_brand, p_retailprice AS best, p_partkey AS which FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) WHERE i = 1")
def uda_argmax(spark, d):
    """The dearest part of a brand, by a state that no plain aggregate gives."""
    df = read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    price, state = var(df, "p_retailprice"), lambda i: {"type": "STATE", "columnIdx": i}
    more = two("GT", price, state(0))
    spec = {
        "type": "UserDefined",
        "initializers": emit(best=const("DOUBLE_TYPE", -1), which=const("LONG_TYPE", -1)),
        "updaters": emit(best=two("GREATER", state(0), price), which=three("CONDITION", more, var(df, "p_partkey"), state(1))),
        "emitters": emit(best=state(0), which=state(1)),
    }
    return rel.aggregate(df, ["p_brand"], [spec])


@query("SELECT p_brand, max(p_partkey + 9007199254740993) AS which, max(p_name) AS name, count(*) AS n FROM part GROUP BY p_brand")
def uda_argmax_text(spark, d):
    """Keys beyond 2^53 and texts as states, which keep their types."""
    df = read(spark, d, "part").selectExpr("p_partkey + 9007199254740993 k", "p_brand", "p_name")
    k, name, s = var(df, "k"), var(df, "p_name"), lambda i: {"type": "STATE", "columnIdx": i}
    first = const("LONG_TYPE", -1)
    spec = {
        "type": "UserDefined",
        "initializers": emit(k=first, name=const("STRING_TYPE", ""), n=const("INT_TYPE", 0)),
        "updaters": emit(k=three("CONDITION", two("GT", k, s(0)), k, s(0)), name=three("CONDITION", two("GT", name, s(1)), name, s(1)), n=two("IDIVIDE", two("PLUS", two("TIMES", s(2), const("INT_TYPE", 2)), const("INT_TYPE", 2)), const("INT_TYPE", 2))),
        "emitters": emit(which=two("GREATER", s(0), first), name=s(1), n=two("CAST", s(2), {"type": "TYPE", "outputType": "LONG_TYPE"})),
    }
    return rel.aggregate(df, ["p_brand"], [spec])


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price FROM orders GROUP BY o_custkey")
def uda_python(spark, d):
    """A Python aggregate, which gets a group's column as a series."""
    e = Engine(spark)
    e.register_function("middle", lambda x: float(x.median()), "double", kind="aggregate")
    df = read(spark, d, "orders").select("o_custkey", "o_totalprice")
    return suite.rounded(rel.aggregate(df, ["o_custkey"], [{"type": "Python", "function": "middle", "columns": [1], "outputName": "median_price"}], functions=e.functions))


@query("SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_custkey) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i FROM orders) WHERE i = 1")
def keep_min_sorted(spark, d):
    """The cheapest order of a customer, after a merge of two halves, in the order of the prices."""
    o = read(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    state = STATES["KeepAndSortOnMinValue"](("o_custkey",), ("o_totalprice",))
    held, _ = state.merge(cut(state.first(o.where("o_orderkey % 2 = 0"))), o.where("o_orderkey % 2 = 1"))
    return rel.counter(held.withColumn("at", F.monotonically_increasing_id()), "place", ["at"]).drop("at")


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM " + PARENTS + "), s(node, odd) AS (SELECT 0::BIGINT, false UNION SELECT e.b, NOT s.odd FROM s JOIN e ON s.node = e.a) SELECT node, odd FROM s")
def mutual_recursion(spark, d):
    """Nodes reached by an even and by an odd number of steps: two relations, each made from the other."""
    e = cut(parents(spark, d).select("a", "b").distinct())
    start = {"even": spark.range(1).selectExpr("id node"), "odd": spark.range(0).selectExpr("id node")}
    next_ = lambda df: rel.join(df, e, ["node"], ["a"], [], ["b"], ["node"], hint="merge")
    held = fixpoint(start, {"even": DupElim(), "odd": DupElim()}, lambda held, delta: {"even": next_(delta["odd"]), "odd": next_(delta["even"])})
    return held["even"].withColumn("odd", F.lit(False)).union(held["odd"].withColumn("odd", F.lit(True)))


# samples, limits and distribution


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS known FROM (SELECT count(*) FROM orders)")
def limit_rows(spark, d):
    """Any hundred rows, all of them of the table."""
    o = read(spark, d, "orders")
    some = cut(rel.limit(o, 100))
    known = some.distinct().join(o, o.columns, "left_semi").agg(F.count("*").alias("known"))
    return some.agg(F.count("*").alias("n")).join(known, F.lit(True))


@query("SELECT count(*) AS stream, 50::BIGINT AS sample FROM customer")
def sampling_shares(spark, d):
    """Fifty rows allotted to the nations by their customers."""
    counts = read(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).alias("WorkerID")).agg(F.count("*").cast("int").alias("n"))
    return rel.sampling_distribution(counts, size=50, seed=9).agg(F.sum("StreamSize").alias("stream"), F.sum("SampleSize").alias("sample"))


@query("SELECT n_regionkey AS place, count(*) AS n FROM nation GROUP BY n_regionkey")
def distribute_identity(spark, d):
    df = read(spark, d, "nation").withColumn("worker", F.col("n_regionkey") + 1)
    return rel.distribute(df, "Identity", 5, ["worker"]).groupBy(F.spark_partition_id().alias("place")).agg(F.count("*").alias("n"))


@query("SELECT 7::BIGINT AS places, count(*) AS n FROM orders")
def distribute_round_robin(spark, d):
    sizes = rel.distribute(read(spark, d, "orders"), "RoundRobin", 7).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("places"), F.sum("n").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def set_filter(spark, d):
    return rel.join(read(spark, d, "part"), read(spark, d, "lineitem"), ["p_partkey"], ["l_partkey"], ["p_partkey", "p_name"], [], how="left_semi")


# time


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark, d):
    """The events as a stream, counted by day in a state that outlives a failure."""
    stream = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    counts = windows.tumbling(stream, "ts", "1 day", ["event_type"], n=F.count("*"))
    return windows.run_to(counts, shared(spark), "complete").select(F.col("start").alias("day"), "event_type", "n")


@query("""
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN gap <= INTERVAL 6 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e)
SELECT user_id, min(ts) AS first_, count(*) AS n FROM s GROUP BY user_id, i
""")
def session_gaps(spark, d):
    return windows.sessions(read(spark, d, "events"), "ts", "6 hours", ["user_id"], n=F.count("*")).select("user_id", F.col("start").alias("first_"), "n")

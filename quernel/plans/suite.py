"""The queries that exercise each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators.iterate import CountFilter, DupElim, KeepMinValue, cut, do_while, fixpoint, generations
from ..streaming import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def put(f):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'2001-09-02'")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 4).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


# expressions as data


def var(df: DataFrame, name: str) -> dict:
    return {"type": "VARIABLE", "columnIdx": df.columns.index(name)}


def const(kind: str, value) -> dict:
    return {"type": "CONSTANT", "valueType": kind, "value": str(value)}


def two(op: str, a: dict, b: dict) -> dict:
    return {"type": op, "left": a, "right": b}


def one(op: str, a: dict) -> dict:
    return {"type": op, "operand": a}


def three(op: str, a: dict, b: dict, c: dict) -> dict:
    return {"type": op, "children": [a, b, c]}


def emit(**expressions: dict) -> list[dict]:
    return [{"outputName": n, "rootExpressionOperator": e} for n, e in expressions.items()]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# rows


@query("SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_returnflag = 'R'")
def filter_range(spark, d):
    df = read(spark, d, "lineitem")
    q = var(df, "l_quantity")
    test = two("AND", two("AND", two("GTEQ", q, const("DOUBLE_TYPE", 10)), two("LT", q, const("DOUBLE_TYPE", 12))), two("EQ", var(df, "l_returnflag"), const("STRING_TYPE", "R")))
    return rel.filter_rows(df, test).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query("""
SELECT o_orderkey, o_custkey + 7 AS plus_, o_orderkey - o_custkey AS minus_, o_custkey * 3 AS times_,
       round(o_orderkey::DOUBLE / (o_custkey + 7), 4) AS divide_, trunc((o_custkey - 500)::DOUBLE / 7)::BIGINT AS idivide_,
       ((o_custkey - 500) % 7)::BIGINT AS modulo_, abs(o_custkey - 500) AS abs_, -o_custkey AS neg_
FROM orders
""")
def apply_arith(spark, d):
    df = read(spark, d, "orders")
    k, c = var(df, "o_orderkey"), var(df, "o_custkey")
    less = two("MINUS", c, const("LONG_TYPE", 500))
    seven = const("LONG_TYPE", 7)
    return rounded(rel.apply(df, emit(o_orderkey=k, plus_=two("PLUS", c, seven), minus_=two("MINUS", k, c), times_=two("TIMES", c, const("LONG_TYPE", 3)), divide_=two("DIVIDE", k, two("PLUS", c, seven)), idivide_=two("IDIVIDE", less, seven), modulo_=two("MODULO", less, seven), abs_=one("ABS", less), neg_=one("NEG", c))))


@query("""
SELECT p_partkey, concat(p_brand, p_type) AS both_, substr(p_name, 2, 3) AS sub_, length(p_name)::INTEGER AS len_, upper(p_name) AS up_,
       regexp_matches(lower(p_type), '^.*e.*$') AS like_ FROM part
""")
def apply_strings(spark, d):
    df = read(spark, d, "part")
    n = var(df, "p_name")
    return rel.apply(df, emit(p_partkey=var(df, "p_partkey"), both_=two("CONCAT", var(df, "p_brand"), var(df, "p_type")), sub_=three("SUBSTR", n, const("INT_TYPE", 1), const("INT_TYPE", 4)), len_=one("LEN", n), up_=one("UPPER", n), like_=two("LIKE", var(df, "p_type"), const("STRING_TYPE", "%E%"))))


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_, greatest(p_size, 20) AS more_, least(p_size, 20) AS less_,
       trunc(p_retailprice)::BIGINT AS long_, p_size::DOUBLE AS double_, p_size::VARCHAR AS text_, p_size <> 0 AS bool_ FROM part
""")
def apply_condition(spark, d):
    df = read(spark, d, "part")
    s, twenty = var(df, "p_size"), const("INT_TYPE", 20)
    kind = lambda t: {"type": "TYPE", "outputType": t}
    return rel.apply(df, emit(p_partkey=var(df, "p_partkey"), size_=three("CONDITION", two("GT", s, const("INT_TYPE", 25)), const("STRING_TYPE", "big"), const("STRING_TYPE", "small")), more_=two("GREATER", s, twenty), less_=two("LESSER", s, twenty), long_=two("CAST", var(df, "p_retailprice"), kind("LONG_TYPE")), double_=two("CAST", s, kind("DOUBLE_TYPE")), text_=two("CAST", s, kind("STRING_TYPE")), bool_=two("CAST", s, kind("BOOLEAN_TYPE"))))


@query("""
SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS sqrt_, round(ln(o_totalprice + 2), 4) AS log_, round(pow(o_custkey, 1.5), 4) AS pow_,
       round(sin(o_custkey), 4) AS sin_, round(cos(o_custkey), 4) AS cos_, ceil(o_totalprice) AS ceil_, floor(o_totalprice) AS floor_ FROM orders
""")
def apply_math(spark, d):
    df = read(spark, d, "orders")
    p, c = var(df, "o_totalprice"), var(df, "o_custkey")
    return rounded(rel.apply(df, emit(o_orderkey=var(df, "o_orderkey"), sqrt_=one("SQRT", p), log_=one("LOG", two("PLUS", p, const("DOUBLE_TYPE", 2))), pow_=two("POW", c, const("DOUBLE_TYPE", 1.5)), sin_=one("SIN", c), cos_=one("COS", c), ceil_=one("CEIL", p), floor_=one("FLOOR", p))))


@query("SELECT p_partkey, ('0x' || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS low FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def apply_md5(spark, d):
    df = read(spark, d, "part")
    out = rel.apply(df, emit(p_partkey=var(df, "p_partkey"), h=one("HASH_MD5", var(df, "p_name"))))
    return out.select("p_partkey", F.col("h").bitwiseAND(F.lit((1 << 56) - 1)).alias("low"))


@query("SELECT p_partkey, unnest(string_split_regex(p_name, '[aeiou]')) AS part FROM (SELECT p_partkey, regexp_replace(p_name, '[aeiou]+$', '') AS p_name FROM part)")
def flatmap_split(spark, d):
    df = read(spark, d, "part")
    return rel.apply(df, emit(p_partkey=var(df, "p_partkey"), part=two("SPLIT", var(df, "p_name"), const("STRING_TYPE", "[aeiou]"))))


@query("SELECT s_suppkey, substr(s_name, i::INTEGER, 3) AS gram FROM supplier, generate_series(1, 100) t(i) WHERE i <= length(s_name) - 2")
def flatmap_ngram(spark, d):
    df = read(spark, d, "supplier")
    return rel.apply(df, emit(s_suppkey=var(df, "s_suppkey"), gram=two("NGRAM", var(df, "s_name"), const("LONG_TYPE", 3))))


@query("SELECT o_orderkey, i AS at_ FROM orders, generate_series(0, 4) t(i) WHERE i < o_orderkey % 5")
def flatmap_sequence(spark, d):
    df = read(spark, d, "orders")
    k = var(df, "o_orderkey")
    return rel.apply(df, emit(o_orderkey=k, at_=one("SEQUENCE", two("MODULO", k, const("LONG_TYPE", 5)))))


@query("SELECT c_custkey, a AS a, b AS b FROM customer, generate_series(0, 3) s(a), generate_series(0, 2) t(b) WHERE a < c_custkey % 4 AND b < c_custkey % 3")
def flatmap_product(spark, d):
    df = read(spark, d, "customer")
    k = var(df, "c_custkey")
    seq = lambda n: one("SEQUENCE", two("MODULO", k, const("LONG_TYPE", n)))
    return rel.apply(df, emit(c_custkey=k, a=seq(4), b=seq(3)))


@query("SELECT p_partkey, substr(p_name, i + 1, 4) AS v, i AS flatmapid FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name) - 3))::INTEGER AS i FROM part WHERE length(p_name) >= 4)")
def flatmap_counter(spark, d):
    df = read(spark, d, "part")
    return rel.apply(df, emit(p_partkey=var(df, "p_partkey"), v=two("NGRAM", var(df, "p_name"), const("LONG_TYPE", 4))), counter=True)


# joins


@query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_inner(spark, d):
    return rel.join(read(spark, d, "orders"), read(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], ["o_orderkey", "o_custkey"], ["l_partkey", "l_quantity"])


@query("SELECT a.o_orderkey AS k1, b.o_orderkey AS k2 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority WHERE a.o_orderkey < b.o_orderkey")
def join_multi_key(spark, d):
    o = read(spark, d, "orders")
    return rel.join(o, o, ["o_custkey", "o_orderpriority"], ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_orderkey"], ["k1", "k2"], residual=lambda l, r: l("o_orderkey") < r("o_orderkey"))  # noqa: E741


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark, d):
    return rel.join(read(spark, d, "customer"), read(spark, d, "nation"), ["c_nationkey"], ["n_nationkey"], ["c_custkey"], ["n_name"], hint="broadcast")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_merge(spark, d):
    return rel.join(read(spark, d, "orders"), read(spark, d, "customer"), ["o_custkey"], ["c_custkey"], ["o_orderkey"], ["c_name"], hint="merge")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_right_hash(spark, d):
    return rel.join(read(spark, d, "orders"), read(spark, d, "customer"), ["o_custkey"], ["c_custkey"], ["o_orderkey"], ["c_mktsegment"], hint="shuffle_hash")


@query("SELECT o_orderkey, c_name FROM orders JOIN (SELECT DISTINCT c_custkey, c_name FROM customer) ON o_custkey = c_custkey")
def join_set_semantics(spark, d):
    c = read(spark, d, "customer")
    return rel.join(read(spark, d, "orders"), c.union(c), ["o_custkey"], ["c_custkey"], ["o_orderkey"], ["c_name"], set_right=True)


@query("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey")
def counting_join(spark, d):
    li = read(spark, d, "lineitem")
    return rel.counting_join(li, li, ["l_partkey"], ["l_partkey"], "n")


TRIANGLE = """FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) r
JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) s ON r.l_partkey = s.l_partkey
JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) t ON s.l_orderkey = t.l_orderkey AND t.l_suppkey = r.l_suppkey"""


def sides(spark, d) -> list[DataFrame]:
    """The three sides of a triangle of suppliers, parts and orders; the first two share the key with the fewest matches."""
    li = read(spark, d, "lineitem")
    return [li.select(a, b).distinct() for a, b in (("l_partkey", "l_orderkey"), ("l_orderkey", "l_suppkey"), ("l_suppkey", "l_partkey"))]


@query("SELECT r.l_suppkey AS x, r.l_partkey AS y, s.l_orderkey AS z " + TRIANGLE)
def multiway_triangle(spark, d):
    return rel.multiway_join(sides(spark, d), [[(0, 1), (1, 0)], [(1, 1), (2, 0)], [(2, 1), (0, 0)]], [(2, 0), (0, 0), (1, 0)], ["x", "y", "z"])


@query("SELECT count(*) AS n " + TRIANGLE)
def hypercube_triangle(spark, d):
    """The triangle count, each cell of a cube joining by itself; the tables' sizes give the cube its dimensions.

    A row goes to as many cells as the cube is long in the dimension that it
    lacks, so the cube has a cell for each core, however many rows there are: the
    joins deal a cell's rows to several tasks.  Repeated rows are left out where
    they have arrived.
    """
    li = read(spark, d, "lineitem")
    names = [("l_suppkey", "l_partkey"), ("l_partkey", "l_orderkey"), ("l_orderkey", "l_suppkey")]
    sizes = li.agg(*[F.approx_count_distinct(F.struct(a, b)) for a, b in names]).first()
    cube = rel.shares([*sizes], [{0, 1}, {1, 2}, {2, 0}], cells(spark))
    r, s, t = (rel.hypercube(li.select(F.col(a).alias(x), F.col(b).alias(y)), cube, {i: x, j: y}) for (a, b), (i, x), (j, y) in zip(names, ((0, "x"), (1, "y"), (2, "z")), ((1, "y"), (2, "z"), (0, "x")), strict=True))
    s, t = (side.repartition("cell", "z").distinct() for side in (s, t))
    r = r.repartition("cell", "x", "y").distinct()
    return s.join(t, ["cell", "z"]).join(r, ["cell", "x", "y"]).agg(F.count("*").alias("n"))


def cells(spark) -> int:
    """Cells of a cube: as many as there are cores, from 8 to 64."""
    return min(max(8, spark.sparkContext.defaultParallelism), 64)


@query("SELECT o_orderkey, round(o_totalprice - m, 2) AS over_ FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m FROM orders)")
def cross_singleton(spark, d):
    o = read(spark, d, "orders")
    return rel.cross_with_singleton(o, o.agg(F.avg("o_totalprice").alias("m"))).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 2).alias("over_"))


# aggregates


@query("SELECT l_returnflag, count(l_quantity) AS count_l_quantity, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity, round(stddev_pop(l_quantity), 4) AS stdev_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def agg_group(spark, d):
    return rounded(rel.aggregate(read(spark, d, "lineitem"), ["l_returnflag"], [{"type": "Primitive", "column": 4, "aggOps": ["COUNT", "SUM", "AVG", "STDEV", "MIN", "MAX"]}]))


@query("SELECT sum(o_custkey)::BIGINT AS sum_o_custkey, round(avg(o_custkey), 4) AS avg_o_custkey FROM orders")
def agg_global(spark, d):
    return rounded(rel.aggregate(read(spark, d, "orders"), [], [{"type": "Primitive", "column": 1, "aggOps": ["SUM", "AVG"]}]))


@query("SELECT o_orderstatus, o_orderpriority, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate, max(o_orderkey) AS max_o_orderkey FROM orders GROUP BY 1, 2")
def agg_multi_key(spark, d):
    return rel.aggregate(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [{"type": "Primitive", "column": 4, "aggOps": ["MIN", "MAX"]}, {"type": "Primitive", "column": 0, "aggOps": ["MAX"]}])


@query("SELECT c_mktsegment, min(c_name) AS min_c_name, max(c_name) AS max_c_name, count(c_name) AS count_c_name FROM customer GROUP BY 1")
def agg_strings(spark, d):
    return rel.aggregate(read(spark, d, "customer"), ["c_mktsegment"], [{"type": "Primitive", "column": 1, "aggOps": ["MIN", "MAX", "COUNT"]}])


@query("SELECT count(*) AS count_o_orderkey FROM orders WHERE false")
def agg_empty_count(spark, d):
    return rel.aggregate(read(spark, d, "orders").where("false"), [], [{"type": "Primitive", "column": 0, "aggOps": ["COUNT"]}], empty_compat=True)


@query("SELECT l_suppkey, count(*) AS n, sum(l_partkey * l_partkey)::BIGINT AS squares FROM lineitem GROUP BY 1")
def uda_sum_squares(spark, d):
    df = read(spark, d, "lineitem")
    k, s = two("CAST", var(df, "l_partkey"), {"type": "TYPE", "outputType": "LONG_TYPE"}), lambda i: {"type": "STATE", "columnIdx": i}
    zero = const("LONG_TYPE", 0)
    return rel.aggregate(df, ["l_suppkey"], [{"type": "UserDefined", "initializers": emit(n=zero, q=zero), "updaters": emit(n=two("PLUS", s(0), const("LONG_TYPE", 1)), q=two("PLUS", s(1), two("TIMES", k, k))), "emitters": emit(n=s(0), squares=s(1))}])


# sets and order


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return rel.union_all(read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT l_partkey FROM lineitem")
def difference(spark, d):
    """Order keys, each once, that are no part's."""
    li = read(spark, d, "lineitem")
    return rel.difference(li.select(F.col("l_orderkey").alias("k")), li.select("l_partkey"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark, d):
    return rel.distinct(read(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(spark, d):
    return rel.limit(rel.order_by(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [1, 0], [False, True]), 25)


@query("SELECT k, row_number() OVER (ORDER BY k) - 1 AS place FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def merge_sorted(spark, d):
    """Both tables in one order, with the place at which each row comes."""
    merged = rel.merge([read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "supplier").select("s_suppkey")], [0])
    return rel.counter(merged.withColumn("at", F.monotonically_increasing_id()), "place", ["at"]).select("k", "place")


# scans with a state


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events")
def counter_ordered(spark, d):
    return rel.counter(read(spark, d, "events").select("ts", "event_id"), "i", ["ts", "event_id"]).select("event_id", "i")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 7) AS mean FROM events")
def running_mean(spark, d):
    df = rel.running(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], mean=F.avg("value"))
    return df.select("event_id", F.round("mean", 7).alias("mean"))


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stateful_scan(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "user_id", "value")
    s = lambda i: {"type": "STATE", "columnIdx": i}
    out = rel.stateful_apply(df, ["user_id"], ["ts", "event_id"], emit(n=const("LONG_TYPE", 0), t=const("DOUBLE_TYPE", 0)), emit(n=two("PLUS", s(0), const("LONG_TYPE", 1)), t=two("PLUS", s(1), var(df, "value"))), emit(event_id=var(df, "event_id"), n=s(0), total=s(1)))
    return rounded(out)


@query("SELECT event_id, i - max(CASE WHEN event_type = 'purchase' THEN i ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS since FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)")
def stateful_since(spark, d):
    """How many events of a user lie after the last purchase: a state that no running aggregate gives."""
    df = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    s = {"type": "STATE", "columnIdx": 0}
    step = three("CONDITION", two("EQ", var(df, "event_type"), const("STRING_TYPE", "purchase")), const("LONG_TYPE", 0), two("PLUS", s, const("LONG_TYPE", 1)))
    return rel.stateful_apply(df, ["user_id"], ["ts", "event_id"], emit(n=const("LONG_TYPE", 0)), emit(n=step), emit(event_id=var(df, "event_id"), since=s))


@query("SELECT event_id, e.user_id, round(value, 4) AS value FROM events e JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) g ON e.user_id = g.user_id WHERE value BETWEEN m - 1.5 * s AND m + 1.5 * s")
def sigma_clip(spark, d):
    e = read(spark, d, "events")
    g = rel.aggregate(e, ["user_id"], [{"type": "Primitive", "column": e.columns.index("value"), "aggOps": ["AVG", "STDEV"]}])
    band = lambda l, r: l("value").between(r("avg_value") - 1.5 * r("stdev_value"), r("avg_value") + 1.5 * r("stdev_value"))  # noqa: E731,E741
    return rounded(rel.join(e, g, ["user_id"], ["user_id"], ["event_id", "user_id", "value"], [], residual=band))


# recursion

PARENTS = "(SELECT (c_custkey + 1) // 10 AS a, c_custkey + 1 AS b, c_nationkey + 1 AS w FROM customer UNION SELECT (c_custkey + 1) // 7, c_custkey + 1, 3 FROM customer)"
BLOCKS = "(SELECT c_custkey AS a, c_custkey - c_custkey % 10 AS b FROM customer UNION SELECT c_custkey, c_custkey - c_custkey % 15 FROM customer)"
PLACES = "(SELECT n_regionkey::BIGINT AS a, n_nationkey::BIGINT + 100 AS b FROM nation UNION SELECT s_nationkey + 100, s_suppkey + 1000 FROM supplier)"


def parents(spark, d) -> DataFrame:
    """Two weighted parents of each customer; paths of different weights meet."""
    c = read(spark, d, "customer").selectExpr("c_custkey + 1 b", "c_nationkey + 1 w")
    return c.selectExpr("b div 10 a", "b", "w").union(c.selectExpr("b div 7", "b", "3")).distinct()


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM " + PARENTS + "), tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def tc_reach(spark, d):
    e = cut(parents(spark, d).select("a", "b").distinct())
    step = lambda held, delta: {"tc": rel.join(delta["tc"], e, ["b"], ["a"], ["a"], ["b"], ["a", "b"], hint="merge")}
    return fixpoint({"tc": e}, {"tc": DupElim()}, step)["tc"]


@query("WITH RECURSIVE e AS (SELECT a, b FROM " + BLOCKS + " UNION SELECT b, a FROM " + BLOCKS + "), tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a AS node, least(a, min(b)) AS label FROM tc GROUP BY a")
def cc_labels(spark, d):
    """Components of a cyclic graph: customers in overlapping blocks of 10 and 15."""
    c = read(spark, d, "customer")
    e = c.selectExpr("c_custkey a", "c_custkey - c_custkey % 10 b").union(c.selectExpr("c_custkey", "c_custkey - c_custkey % 15"))
    e = cut(e.union(e.select("b", "a")).distinct())
    start = e.selectExpr("a node", "a label").distinct()
    step = lambda held, delta: {"cc": rel.join(delta["cc"], e, ["node"], ["a"], ["label"], ["b"], hint="merge").select(F.col("b").alias("node"), "label")}
    return fixpoint({"cc": start}, {"cc": KeepMinValue(("node",), ("label",))}, step)["cc"]


@query("WITH RECURSIVE e AS " + PARENTS + ", s(node, dist) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.b, s.dist + e.w FROM s JOIN e ON s.node = e.a) SELECT node, min(dist) AS dist FROM s GROUP BY node")
def sssp(spark, d):
    e = cut(parents(spark, d))
    start = spark.range(1).selectExpr("id node", "0L dist")
    step = lambda held, delta: {"s": rel.join(delta["s"], e, ["node"], ["a"], ["dist"], ["b", "w"], hint="merge").select(F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))}
    return fixpoint({"s": start}, {"s": KeepMinValue(("node",), ("dist",))}, step)["s"]


@query("WITH RECURSIVE e AS " + PLACES + ", sg(x, y) AS (SELECT p.b, q.b FROM e p JOIN e q ON p.a = q.a WHERE p.b <> q.b UNION SELECT p.b, q.b FROM sg JOIN e p ON p.a = sg.x JOIN e q ON q.a = sg.y) SELECT x, y FROM sg")
def same_generation(spark, d):
    """Nations of a region, and suppliers whose nations are the same or of the same generation."""
    nations = read(spark, d, "nation").selectExpr("cast(n_regionkey as long) a", "cast(n_nationkey as long) + 100 b")
    return generations(nations.union(read(spark, d, "supplier").selectExpr("cast(s_nationkey as long) + 100", "s_suppkey + 1000")))


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT (c_custkey + 1) // 10 AS a, c_custkey + 1 AS b FROM customer UNION SELECT (c_custkey + 1) // 9, c_custkey + 1 FROM customer) WHERE b >= 50), f(b) AS (SELECT b FROM e GROUP BY b HAVING count(*) < 2 UNION SELECT e.b FROM f JOIN e ON f.b = e.a) SELECT i AS x FROM generate_series(0, 49) t(i) UNION ALL SELECT DISTINCT b FROM e WHERE b NOT IN (SELECT b FROM f)")
def count_filter(spark, d):
    """Nodes of which two different parents are in; those under 50 are to begin with."""
    c = read(spark, d, "customer").selectExpr("c_custkey + 1 b")
    e = cut(c.selectExpr("b div 10 a", "b").union(c.selectExpr("b div 9", "b")).distinct().where("b >= 50"))
    start = spark.range(50).selectExpr("id x", "explode(array(-1L, -2L)) p")
    state = CountFilter(("x",), 2)
    held = fixpoint({"in": start}, {"in": state}, lambda held, delta: {"in": rel.join(delta["in"], e, ["x"], ["a"], ["x"], ["b"], ["p", "x"], hint="merge").select("x", "p")})
    return state.passed(held["in"])


@query("WITH RECURSIVE t(n, v) AS (SELECT 1, 2::BIGINT UNION ALL SELECT n + 1, v * 2 FROM t WHERE v * 2 < 5000) SELECT max(v) AS v FROM t")
def do_while_pow2(spark, d):
    start = {"x": spark.range(1).select(F.lit(1).cast("long").alias("v"))}
    return do_while(start, lambda s: {"x": s["x"].select((F.col("v") * 2).alias("v"))}, lambda s: s["x"].select(F.col("v") * 2 < 5000))["x"]


# samples and distribution


@query("SELECT 200::BIGINT AS n, 200::BIGINT AS different, 200::BIGINT AS known, true AS differs FROM (SELECT count(*) FROM orders)")
def sample_without_replacement(spark, d):
    """Two hundred different rows, all of them of the table, and others with another seed."""
    o = read(spark, d, "orders")
    a, b = (cut(rel.sample_exact(o, 200, seed)) for seed in (7, 8))
    found = a.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"))
    known = a.join(o, o.columns, "left_semi").agg(F.count("*").alias("known"))
    other = b.join(a, ["o_orderkey"], "left_anti").agg((F.count("*") > 50).alias("differs"))
    return found.join(known, F.lit(True)).join(other, F.lit(True))


@query("SELECT 3000::BIGINT AS n, 3000::BIGINT AS known, true AS repeated FROM (SELECT count(*) FROM nation)")
def sample_with_replacement(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    drawn = cut(rel.sample_with_replacement(n, 3000, 3))
    known = drawn.join(n, n.columns, "left_semi").agg(F.count("*").alias("known"))
    # 25 rows, of which each is drawn 120 times or about so
    spread = drawn.groupBy("n_nationkey").count().agg(F.sum("count").alias("n"), ((F.min("count") > 60) & (F.max("count") < 180) & (F.count("*") == 25)).alias("repeated"))
    return spread.join(known, F.lit(True))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total, count(DISTINCT o_custkey) AS places, 7::BIGINT AS used FROM orders")
def hash_partition_counts(spark, d):
    """Every key lies in one partition, and all partitions are used."""
    dealt = rel.distribute(read(spark, d, "orders"), "Hash", 7, ["o_custkey"]).select("o_custkey", "o_orderkey", F.spark_partition_id().alias("p"))
    return dealt.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"), F.count_distinct("o_custkey", "p").alias("places"), F.count_distinct("p").alias("used"))


# what Spark offers beyond: outer, semi and anti joins, intersection, cubes, windows in time


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, d):
    return rel.join(read(spark, d, "customer"), read(spark, d, "orders"), ["c_custkey"], ["o_custkey"], ["c_custkey"], ["o_orderkey"], how="left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def join_anti(spark, d):
    return rel.join(read(spark, d, "customer"), read(spark, d, "supplier"), ["c_custkey"], ["s_suppkey"], ["c_custkey"], [], how="left_anti")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_day(spark, d):
    return windows.tumbling(read(spark, d, "events"), "ts", "1 day", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 2)).select(F.col("start").alias("day"), "event_type", "n", "total")

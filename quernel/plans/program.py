"""An engine for JSON plans: validation, loading, control flow, relations, export.

Producers and consumers in a plan collapse to edges, since Spark places its own
exchanges.  The distribute function of a shuffle becomes a repartitioning, and a
broadcast a hint where the size allows it.  A collect, and the copies that a
hypercube shuffle makes for workers that join by themselves, change no result
here and are left to Spark; ``relational.hypercube`` has the latter as an operator.
"""

from __future__ import annotations

import base64
import contextlib
import csv
import io
import itertools
import json
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, PlanError, RelationKey, Schema
from ..operators import relational as rel
from ..operators.iterate import MOST, STATES, Held, cut, fixpoint, single
from ..sources import formats, generated
from .catalog import Catalog, read, shown

#: Bytes that a plan's rows may have as text in memory.
TEXT = 64 << 20

PRODUCERS = {"ShuffleProducer", "BroadcastProducer", "CollectProducer", "LocalMultiwayProducer", "HyperCubeShuffleProducer"}
CONSUMERS = {"ShuffleConsumer", "BroadcastConsumer", "CollectConsumer", "LocalMultiwayConsumer", "HyperCubeShuffleConsumer", "Consumer"}
#: The relation of profiled roots.
PROFILE = "public:logs:Profiling"
PROFILE_SCHEMA = "queryId long, subQueryId int, opId string, opType string, startTime long, endTime long, numTuples long"
#: Roots without a child.
ACTIONS = {"DbCreateIndex": ("relationKey", "indexes"), "DbCreateView": ("viewName", "viewDefinition"), "DbCreateFunction": ("name", "outputType"), "DbExecute": ("sqlQuery",), "DbDelete": ("relationKey",)}
ROOTS = PRODUCERS | set(ACTIONS) | {"DbInsert", "TempInsert", "SampledDbInsertTemp", "TupleSink", "EmptySink", "SetGlobal", "EOSController"}
#: Required fields by operator.
NEEDS = {
    "Aggregate": ("argChild", "argGroupFields", "aggregators"), "Apply": ("argChild", "emitExpressions"), "CatalogScan": ("schema", "sql"),
    "Counter": ("argChild", "columnName"), "CrossWithSingleton": ("argChild1", "argChild2"), "DbInsert": ("argChild", "relationKey"),
    "DbQueryScan": ("schema", "sql"), "Difference": ("argChild1", "argChild2"), "DupElim": ("argChild",), "Empty": ("schema",), "EmptySink": ("argChild",),
    "EOSController": ("argChild",), "Filter": ("argChild", "argPredicate"), "IDBController": ("argInitialInput", "argIterationInput", "argEosControllerInput", "argState"),
    "InMemoryOrderBy": ("argChild", "argSortColumns", "argAscending"), "LeapFrogJoin": ("argChildren", "joinFieldMapping", "outputFieldMapping"), "Limit": ("argChild", "numTuples"),
    "Merge": ("argChildren",), "MergeJoin": ("argChild1", "argChild2", "argColumns1", "argColumns2", "argSelect1", "argSelect2"),
    "NChiladaFileScan": ("nchiladaDirectoryName", "groupFileName"), "RightHashCountingJoin": ("argChild1", "argChild2", "argColumns1", "argColumns2"),
    "RightHashJoin": ("argChild1", "argChild2", "argColumns1", "argColumns2", "argSelect1", "argSelect2"), "Sample": ("argChild1", "argChild2"),
    "SampledDbInsertTemp": ("argChild", "sampleSize", "sampleTable", "countTable"), "SamplingDistribution": ("argChild", "sampleType"), "SeaFlowScan": ("source",),
    "SetGlobal": ("argChild", "key"), "Singleton": (), "StatefulApply": ("argChild", "emitExpressions", "initializerExpressions", "updaterExpressions"),
    "SymmetricHashCountingJoin": ("argChild1", "argChild2", "argColumns1", "argColumns2"), "SymmetricHashJoin": ("argChild1", "argChild2", "argColumns1", "argColumns2", "argSelect1", "argSelect2"),
    "TableScan": ("relationKey",), "TempInsert": ("argChild", "table"), "TempTableScan": ("table",), "TipsyFileScan": ("tipsyFilename", "grpFilename", "iorderFilename"),
    "TupleSink": ("argChild",), "TupleSource": ("reader", "source"), "CSVFragmentTupleSource": ("reader", "source"), "UnionAll": ("argChildren",),
} | ACTIONS | {p: ("argChild",) for p in PRODUCERS} | {c: ("argOperatorId",) for c in CONSUMERS}


def children(op: dict) -> list:
    out = [op[k] for k in ("argChild", "argChild1", "argChild2", "argInitialInput", "argIterationInput", "argOperatorId") if k in op]
    return out + list(op.get("argChildren", []))


def validate(query: dict) -> None:
    """Raises PlanError for what could not run; executes nothing."""
    for k in ("rawQuery", "logicalRa"):
        if not isinstance(query.get(k), str):
            raise PlanError(f"{k} is needed")
    if ("fragments" in query) == ("plan" in query):
        raise PlanError("either fragments or a plan are needed")
    for fragments in sub_queries(plan_of(query)):
        ops: dict = {}
        for fragment in fragments:
            if not fragment.get("operators"):
                raise PlanError("a fragment needs operators")
            if sum(op.get("opType") in ROOTS for op in fragment["operators"]) < 1 and not any(op.get("opType") == "IDBController" for op in fragment["operators"]):
                raise PlanError("a fragment needs a root")
            for op in fragment["operators"]:
                if op.get("opType") not in NEEDS:
                    raise PlanError(f"unknown operator {op.get('opType')!r}")
                if op.get("opId") is None or op["opId"] in ops:
                    raise PlanError(f"missing or repeated opId {op.get('opId')!r}")
                if missing := [k for k in NEEDS[op["opType"]] if k not in op]:
                    raise PlanError(f"{op['opType']} needs {', '.join(missing)}")
                ops[op["opId"]] = op
        for op in ops.values():
            for c in children(op):
                if c not in ops:
                    raise PlanError(f"{op['opId']} reads {c!r}, which is not there")


def plan_of(query: dict) -> dict:
    return query.get("plan") or {"type": "SubQuery", "fragments": query["fragments"]}


def sub_queries(plan: dict) -> Iterator[list]:
    if plan["type"] == "SubQuery":
        yield plan["fragments"]
    elif plan["type"] == "Sequence":
        for p in plan["plans"]:
            yield from sub_queries(p)
    elif plan["type"] == "DoWhile":
        for p in plan["body"] if isinstance(plan["body"], list) else [plan["body"]]:
            yield from sub_queries(p)
    else:
        raise PlanError(f"unknown plan {plan['type']!r}")


class Engine:
    """Relations by key, functions, queries and their states."""

    def __init__(self, spark: SparkSession, database: str = "default", folder: str | None = None):
        """``folder``: where the catalog is kept; what an earlier engine left there is known again."""
        self.spark, self.database, self.store = spark, database, Catalog(spark, folder)
        self.functions: dict = {}
        self.log: dict[int, dict] = {int(n): q | {"plans": q.get("plans", []), "profile": None} for n, q in self.store.all("queries").items()}
        self.relations: dict[str, dict] = {}
        self.indexes: dict[str, list] = {}
        self.ids = itertools.count(max(self.log, default=0) + 1)
        for table, about in self.store.all("relations").items():
            key = RelationKey.of_table(table)
            self.indexes[str(key)] = about.pop("indexes", [])
            if not self.spark.catalog.tableExists(self.name(key)):
                self.spark.catalog.createTable(self.name(key), about["location"], "parquet")
            self.relations[str(key)] = read(about)
        for name, about in self.store.all("functions").items():
            self.register_function(name, about["sql"], about.get("output", ""))

    # relations

    def name(self, key) -> str:
        return f"{self.database}.{RelationKey.parse(key).table}"

    def write(self, key, df: DataFrame, overwrite: bool = False, distribution: dict | None = None, query: int | None = None) -> None:
        """Appends, or replaces through a new table, so that a query may read what it replaces.

        A relation that is distributed by a hash of columns is stored in buckets of
        them, so that joins on these columns need no exchange.
        """
        key = RelationKey.parse(key)
        there = self.spark.catalog.tableExists(self.name(key))
        if overwrite or not there:
            df = cut(df) if overwrite and there else df
            columns = rel.names(df, hashed(distribution))
            out = df.write
            if columns:
                n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                out = df.repartition(n, *map(rel.at, columns)).write.bucketBy(n, *columns)
            out.mode("overwrite").saveAsTable(self.name(key))
        else:
            old = Schema.of(self.spark.table(self.name(key)).schema)
            if not old.compatible(Schema.of(df.schema)):
                raise PlanError(f"{key} has other types")
            distribution = self.relations.get(str(key), {}).get("distribution") or distribution
            columns = rel.names(df, hashed(distribution))
            df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *map(rel.at, columns)) if columns else df
            df.toDF(*old.names).write.insertInto(self.name(key))
        self.noted(key, {"schema": Schema.of(df.schema), "distribution": distribution or {"type": "RoundRobin"}, "query": query, "created": time.time()})

    def noted(self, key, about: dict) -> None:
        key = RelationKey.parse(key)
        self.relations[str(key)] = about
        if self.store.folder:
            where = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(key)}").where("col_name = 'Location'").first()
            self.store.put("relations", key.table, shown(about) | {"indexes": self.indexes.get(str(key), []), "location": where.data_type})

    def read(self, key) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name(key)):
            raise PlanError(f"no relation {RelationKey.parse(key)}")
        return self.spark.table(self.name(key))

    def drop(self, key) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(key)}")
        self.relations.pop(str(RelationKey.parse(key)), None)
        self.store.drop("relations", RelationKey.parse(key).table)

    def register_existing(self, key, schema: Schema | None = None) -> None:
        self.noted(key, {"schema": schema or Schema.of(self.read(key).schema), "distribution": {"type": "Unknown"}, "query": None, "created": time.time()})

    def describe(self, key) -> dict:
        """What is known of a relation; its rows are counted once after each change."""
        key = RelationKey.parse(key)
        about = self.relations.get(str(key), {"schema": Schema.of(self.read(key).schema)})
        if "count" not in about:
            about["count"] = self.read(key).count()
            if str(key) in self.relations:
                self.noted(key, about)
        return {"key": str(key), **about}

    def list(self, search: str = "", user: str | None = None, program: str | None = None) -> list[str]:
        keys = [RelationKey.parse(k) for k in sorted(self.relations)]
        return [str(k) for k in keys if search in str(k) and user in (None, k.user) and program in (None, k.program)]

    def create_index(self, key, columns: list) -> None:
        self.read(key)
        key = RelationKey.parse(key)
        self.indexes.setdefault(str(key), []).append(columns)
        if str(key) in self.relations:
            self.noted(key, self.relations[str(key)])

    def create_view(self, name: str, sql: str, materialized: bool = False) -> None:
        if not NAME.match(name):
            raise PlanError(f"bad name {name!r} of a view")
        if materialized:
            self.spark.sql(sql).write.mode("overwrite").saveAsTable(f"{self.database}.{name}")
        else:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {sql}")

    def persist(self, key, path: str) -> None:
        self.read(key).write.mode("overwrite").parquet(path)

    def ingest(self, key, reader: dict, source: dict, overwrite: bool = True, distribution: dict | None = None) -> int:
        df = self.source(reader, source)
        if distribution:
            df = self.distributed(df, distribution)
        self.write(key, df, overwrite, distribution)
        return self.describe(key)["count"]

    def export(self, key, fmt: str = "csv") -> Iterator[str]:
        """Lines of csv, tsv or a JSON array; rows stream through the driver."""
        yield from self.lines(self.read(key), fmt)

    def lines(self, df: DataFrame, fmt: str = "csv") -> Iterator[str]:
        if fmt == "json":
            yield "["
            for i, r in enumerate(df.toJSON().toLocalIterator()):
                yield ("," if i else "") + r
            yield "]"
            return
        for r in itertools.chain([df.columns], df.toLocalIterator()):
            out = io.StringIO()
            csv.writer(out, delimiter="\t" if fmt == "tsv" else ",", lineterminator="").writerow(r)
            yield out.getvalue()

    def ingest_jdbc(self, key, url: str, table: str, overwrite: bool = True, split: tuple[str, int, int, int] | None = None, **properties: str) -> None:
        self.write(key, formats.read_jdbc(self.spark, url, table, split, **properties), overwrite)

    def export_jdbc(self, key, url: str, table: str, overwrite: bool = False, **properties: str) -> None:
        formats.write_jdbc(self.read(key), url, table, overwrite, **properties)

    # functions

    def register_function(self, name: str, f, output: str, multi: bool = False, kind: str = "scalar") -> None:
        """A Python callable (never pickled bytes), or SQL text, as a function of columns.

        An aggregate takes a series for each column, and gives the group's value.
        Only those in SQL are kept in the catalog's folder.
        """
        if not NAME.match(name):
            raise PlanError(f"bad name {name!r} of a function")
        if isinstance(f, str):
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{f}")
            self.functions[name] = lambda *cs: F.call_function(name, *cs)
            self.store.put("functions", name, {"sql": f, "output": output})
        elif kind == "aggregate":
            self.functions[name] = F.pandas_udf(f, output, F.PandasUDFType.GROUPED_AGG)
        else:
            self.functions[name] = F.udf(f, f"array<{output}>" if multi else output, useArrow=True)

    # queries

    def validate(self, query: dict) -> None:
        validate(query)

    def run(self, query: dict) -> int:
        """Runs a query to its end and returns its id; a failure is logged and raised."""
        n = self.accept(query)
        self.execute(n, query)
        return n

    def submit(self, query: dict) -> int:
        """Starts a query in a thread of its own and returns its id; a failure is logged."""
        n = self.accept(query)

        def run() -> None:
            with contextlib.suppress(Exception):
                self.execute(n, query)

        threading.Thread(target=run, daemon=True).start()
        return n

    def accept(self, query: dict) -> int:
        validate(query)
        n = next(self.ids)
        self.log[n] = {"id": n, "rawQuery": query["rawQuery"], "status": "ACCEPTED", "globals": {}, "plans": [], "profile": [] if query.get("profilingMode") else None}
        return n

    def execute(self, n: int, query: dict) -> None:
        entry = self.log[n]
        entry |= {"status": "RUNNING", "start": time.time()}
        self.spark.sparkContext.setJobGroup(f"quernel-{n}", query["rawQuery"][:200], True)
        run = Run(self, n, entry)
        try:
            run.plan(plan_of(query))
            if entry["profile"]:
                self.write(PROFILE, self.spark.createDataFrame(entry["profile"], PROFILE_SCHEMA), query=n)
            entry["status"] = "SUCCESS"
        except BaseException as e:
            entry |= {"status": entry["status"] if entry["status"] == "KILLED" else "ERROR", "message": str(e)}
            raise
        finally:
            entry |= {"finish": time.time(), "temp": run.temp}
            self.store.put("queries", str(n), {k: entry.get(k) for k in ("id", "rawQuery", "status", "message", "start", "finish", "globals", "plans")})

    def status(self, n: int) -> dict:
        return self.log[n]

    def queries(self, search: str = "", limit: int | None = None, most: int | None = None) -> list[dict]:
        """The queries whose text holds ``search``, the latest first: up to ``limit``, of ids up to ``most``."""
        found = [q for n, q in sorted(self.log.items(), reverse=True) if search in q["rawQuery"] and (most is None or n <= most)]
        return found[:limit]

    def plan_text(self, n: int, subquery: int) -> list[str]:
        """The plans that a subquery of a query ran."""
        return [p["text"] for p in self.log[n]["plans"] if p["subquery"] == subquery]

    def profile(self, n: int) -> DataFrame:
        """What the roots of a profiled query took, in nanoseconds, and the rows that they kept where those are known."""
        began = int(self.log[n]["start"] * 1e9)  # an engine before this one may have used the number
        return self.read(PROFILE).where((F.col("queryId") == n) & (F.col("startTime") >= began))

    def histogram(self, n: int, step: int) -> DataFrame:
        """(opId, bucket, active): in which spans of ``step`` nanoseconds each root was at work."""
        first = F.floor(F.col("startTime") / step)
        return self.profile(n).select("subQueryId", "opId", F.explode(F.sequence(first, F.floor(F.col("endTime") / step))).alias("bucket")).groupBy("opId", "bucket").agg(F.count("*").alias("active"))

    def span(self, n: int) -> DataFrame:
        """(startTime, endTime) of a profiled query."""
        return self.profile(n).agg(F.min("startTime").alias("startTime"), F.max("endTime").alias("endTime"))

    def contribution(self, n: int) -> DataFrame:
        """(opId, nanoTime): how long each root of a profiled query was at work."""
        return self.profile(n).groupBy("opId").agg(F.sum(F.col("endTime") - F.col("startTime")).alias("nanoTime"))

    def operator_log(self, n: int, start: int = 0, end: int = (1 << 63) - 1, least: int = 0) -> DataFrame:
        """The spans of a profiled query's roots that touch a time and last ``least`` nanoseconds, in order."""
        return self.profile(n).where((F.col("endTime") >= start) & (F.col("startTime") <= end) & (F.col("endTime") - F.col("startTime") >= least)).select("opId", "startTime", "endTime", "numTuples").orderBy("startTime")

    def cancel(self, n: int) -> None:
        self.spark.sparkContext.cancelJobGroup(f"quernel-{n}")
        self.log[n]["status"] = "KILLED"

    def catalog(self) -> None:
        """Views over the catalog, for CatalogScan."""
        put = lambda rows, schema, name: self.spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
        put([(q["id"], q["rawQuery"], q["status"], q.get("start"), q.get("finish"), q.get("message")) for q in self.log.values()], "query_id long, raw_query string, status string, start_time double, finish_time double, message string", "queries")
        put([(n, p["subquery"], p["opType"], p["text"]) for n, q in self.log.items() for p in q["plans"]], "query_id long, subquery_id int, op_type string, plan string", "query_plans")
        relations = [(*k.split(":"), r) for k, r in self.relations.items()]
        put([(u, p, n, json.dumps(r["distribution"]), r.get("query"), r.get("count")) for u, p, n, r in relations], "user_name string, program_name string, relation_name string, how_distributed string, query_id long, num_tuples long", "relations")
        put([(u, p, n, i, c, t, i in places(self.indexes.get(f"{u}:{p}:{n}", []))) for u, p, n, r in relations for i, (c, t) in enumerate(zip(r["schema"].names, r["schema"].types, strict=True))], "user_name string, program_name string, relation_name string, col_index int, col_name string, col_type string, is_indexed boolean", "relation_schema")
        put([(n,) for n in self.functions], "function_name string", "registered_functions")

    # readers

    def source(self, reader: dict, source: dict) -> DataFrame:
        schema = Schema.parse(reader["schema"]) if "schema" in reader else None
        kind = source["dataType"]
        if kind == "Empty":
            return self.spark.createDataFrame([], schema.spark)
        path = source.get("filename") or source.get("uri") or source.get("s3Uri")
        options = (reader.get("delimiter") or ",", reader.get("quote") or '"', reader.get("escape"), reader.get("skip") or 0)
        if kind == "Bytes":
            return formats.csv_bytes(self.spark, base64.b64decode(source["bytes"]), schema, *options)
        path = path.replace("s3://", "s3a://", 1)
        if reader["readerType"] == "CSV":
            return formats.read_csv(self.spark, path, schema, *options)
        if reader["readerType"] == "Binary":
            return formats.binary_rows(self.spark, path, schema, bool(reader.get("isLittleEndian")))
        raise PlanError(f"unknown reader {reader['readerType']!r}")

    def distributed(self, df: DataFrame, f: dict | None) -> DataFrame:
        f = f or {"type": "RoundRobin"}
        columns = f.get("indexes") or f.get("index")
        columns = [columns] if isinstance(columns, int) else columns
        return rel.distribute(df, f["type"], f.get("numPartitions"), columns) if f["type"] in ("Hash", "RoundRobin", "Identity", "Broadcast", "Single") else df


def places(indexes) -> set[int]:
    """The columns that any of the indexes, however nested, has."""
    if isinstance(indexes, list):
        return set().union(*map(places, indexes))
    return {indexes["index"] if isinstance(indexes, dict) else indexes}


def hashed(distribution: dict | None) -> list:
    """The columns that a relation is distributed by a hash of."""
    return list(distribution.get("indexes") or []) if distribution and distribution.get("type") == "Hash" else []


class Occurrence(dict):
    """What a rule reads where it reads a recursive relation for the time ``target``: there what is new.

    At the times before it, the relation with what is new; at those after it,
    without: so each combination of rows is seen once.  What does not read such a
    relation is built once and shared.
    """

    def __init__(self, shared: dict, recursive: set, held, delta: dict, target: int):
        super().__init__()
        self.shared, self.recursive, self.held, self.delta, self.target, self.n = shared, recursive, held, delta, target, -1

    def take(self, k) -> DataFrame:
        self.n += 1
        return self.delta[k] if self.n == self.target else self.held[k] if self.n < self.target else self.held.old[k]


class Run:
    """One run of a query: its temporary relations and globals."""

    def __init__(self, engine: Engine, n: int, entry: dict):
        self.engine, self.n, self.entry, self.temp, self.rounds = engine, n, entry, {}, 0

    def plan(self, plan: dict) -> None:
        if plan["type"] == "SubQuery":
            self.rounds += 1
            if self.rounds > MOST:
                raise PlanError(f"more than {MOST} subqueries")
            self.sub_query(plan["fragments"])
        elif plan["type"] == "Sequence":
            for p in plan["plans"]:
                self.plan(p)
        else:
            while True:
                for p in plan["body"] if isinstance(plan["body"], list) else [plan["body"]]:
                    self.plan(p)
                if not single(self.temp[plan["condition"]]):
                    break

    def sub_query(self, fragments: list[dict]) -> None:
        ops = {op["opId"]: op for f in fragments for op in f["operators"]}
        made: dict = {}
        idbs = [op for op in ops.values() if op["opType"] == "IDBController"]
        if idbs:
            made |= self.recursion(ops, idbs)
        for op in ops.values():
            if op["opType"] in ACTIONS:
                self.action(op)
            elif op["opType"] in ROOTS and op["opType"] not in PRODUCERS and op["opType"] != "EOSController":
                self.root(op, self.build(ops, op["argChild"], made))

    def recursion(self, ops: dict, idbs: list[dict]) -> dict:
        """All recursive relations of a subquery, to their common fix-point.

        A rule is taken once for each time that it reads one of them, with the new
        rows there; a round ends for all at once, with ``sync`` or without, which
        gives the same relations.
        """
        states, initial = {}, {}
        for op in idbs:
            df = initial[op["opId"]] = self.build(ops, op["argInitialInput"], {})
            s = dict(op["argState"])
            kind = s.pop("type")
            by = {k: tuple(rel.names(df, s[k])) for k in ("keyColIndices", "valueColIndices") if k in s}
            if kind == "CountFilter":
                states[op["opId"]] = STATES[kind](by["keyColIndices"], s["threshold"])
            elif "valueColIndices" in by:
                states[op["opId"]] = STATES[kind](by["keyColIndices"], by["valueColIndices"])
            else:
                states[op["opId"]] = STATES[kind]()

        recursive = {k for k in ops if self.times(ops, k, set(initial))}
        shared: dict = {}

        def rules(held, delta):
            now = Held({k: self.seen(ops, k, v) for k, v in held.items()}, {k: self.seen(ops, k, v) for k, v in held.old.items()})
            new = {}
            for op in idbs:
                at = op["argIterationInput"]
                terms = [self.build(ops, at, Occurrence(shared, recursive, now, delta, i)) for i in range(self.times(ops, at, set(initial)))]
                if terms:
                    new[op["opId"]] = rel.union_all(*terms).toDF(*initial[op["opId"]].columns)
            return new

        held = fixpoint(initial, states, rules)
        for op in idbs:
            if "relationKey" in op and op["relationKey"]:
                self.engine.write(op["relationKey"], held[op["opId"]], True, query=self.n)
        return {k: self.seen(ops, k, v) for k, v in held.items()}

    def seen(self, ops: dict, k, df: DataFrame) -> DataFrame:
        """What others see of a relation: of a count filter, the keys that have passed."""
        state = ops[k]["argState"]
        if state["type"] == "CountFilter":
            keys = rel.names(df, state["keyColIndices"])
            return STATES["CountFilter"](tuple(keys), state["threshold"]).passed(df)
        return df

    def times(self, ops: dict, at, idbs: set) -> int:
        """How often an operator reads recursive relations, by any way."""
        if at in idbs:
            return 1
        return sum(self.times(ops, c, idbs) for c in children(ops[at]))

    def action(self, op: dict) -> None:
        e, kind = self.engine, op["opType"]
        self.entry["plans"].append({"subquery": self.rounds, "opType": kind, "text": json.dumps(op, default=str)})
        if kind == "DbCreateIndex":
            e.create_index(op["relationKey"], op["indexes"])
        elif kind == "DbCreateView":
            e.create_view(op["viewName"], op["viewDefinition"], bool(op.get("isMaterialized") or op.get("materialized")))
        elif kind == "DbCreateFunction":
            if "sql" not in op:
                raise PlanError("a function in a plan is SQL; Python functions are registered in the process")
            e.register_function(op["name"], op["sql"], op["outputType"])
        elif kind == "DbDelete":
            e.drop(op["relationKey"])
        else:
            e.spark.sql(op["sqlQuery"])

    def root(self, op: dict, df: DataFrame) -> None:
        kind, began = op["opType"], time.time_ns()
        self.entry["plans"].append({"subquery": self.rounds, "opType": kind, "text": df._jdf.queryExecution().toString()})
        self.write_root(op, kind, df)
        if self.entry["profile"] is not None:
            stored = self.temp.get(op.get("table")) if kind == "TempInsert" else None
            n = stored.count() if stored is not None else self.entry.get("count") if kind == "EmptySink" else None
            self.entry["profile"].append((self.n, self.rounds, str(op["opId"]), kind, began, time.time_ns(), n))

    def write_root(self, op: dict, kind: str, df: DataFrame) -> None:
        if kind == "DbInsert":
            self.engine.write(op["relationKey"], df, bool(op.get("argOverwriteTable")), op.get("distributeFunction"), self.n)
        elif kind == "TempInsert":
            old = self.temp.get(op["table"])
            self.temp[op["table"]] = cut(df if old is None or op.get("argOverwriteTable", True) else old.union(df))
        elif kind == "SampledDbInsertTemp":
            self.temp[op["sampleTable"]], self.temp[op["countTable"]] = rel.reservoir(df, op["sampleSize"], op.get("randomSeed") or 0)
        elif kind == "SetGlobal":
            self.entry["globals"][op["key"]] = single(df)
        elif kind == "EmptySink":
            self.entry["count"] = (df.limit(op["argLimit"]) if op.get("argLimit") else df).count()
        elif kind == "TupleSink":
            sink, writer = op.get("dataSink") or {}, (op.get("tupleWriter") or {}).get("writerType", "CSV").upper()
            fmt = "json" if "JSON" in writer else "tsv" if "TSV" in writer else "csv"
            if sink.get("dataType") == "Bytes":
                self.entry["bytes"] = self.text(df, fmt)
                return
            if sink.get("dataType") == "Pipe":  # read by who asked for it, a row at a time
                self.entry["pipe"] = self.engine.lines(cut(df), fmt)
                return
            path = (sink.get("uri") or sink.get("filename") or "").replace("s3://", "s3a://", 1)
            if not path:
                raise PlanError("a sink needs a path")
            if "POSTGRES" in writer:
                formats.write_copy(df, path)
                return
            out = df.write.mode("overwrite")
            (out.json(path) if fmt == "json" else out.option("header", True).csv(path, sep="\t" if fmt == "tsv" else ","))

    def text(self, df: DataFrame, fmt: str) -> bytes:
        """The rows as text in memory, up to ``TEXT`` bytes; more raise."""
        out = bytearray()
        for line in self.engine.lines(df, fmt):
            out += line.encode() + b"\n"
            if len(out) > TEXT:
                raise PlanError(f"more than {TEXT} bytes; use a path or a pipe")
        return bytes(out)

    def build(self, ops: dict, at, made: dict) -> DataFrame:
        """The DataFrame of an operator; each is built once."""
        if isinstance(made, Occurrence):
            if at in made.delta:
                return made.take(at)
            if at in made.recursive:
                return self.operator(ops, ops[at], made)
            made = made.shared
        if at not in made:
            made[at] = self.operator(ops, ops[at], made)
        return made[at]

    def operator(self, ops: dict, op: dict, made: dict) -> DataFrame:
        e, kind = self.engine, op["opType"]
        get = lambda k: self.build(ops, op[k], made)
        if kind in CONSUMERS:
            return get("argOperatorId")
        if kind in PRODUCERS:
            if kind == "BroadcastProducer":
                return rel.small(get("argChild"))
            return e.distributed(get("argChild"), op["distributeFunction"]) if kind == "ShuffleProducer" and op.get("distributeFunction") else get("argChild")
        if kind == "TableScan":
            return e.read(op["relationKey"])
        if kind == "TempTableScan":
            if op["table"] not in self.temp:
                raise PlanError(f"no temporary relation {op['table']!r}")
            return self.temp[op["table"]]
        if kind in ("DbQueryScan", "CatalogScan"):
            if kind == "CatalogScan":
                e.catalog()
            schema = Schema.parse(op["schema"])
            df = e.spark.sql(op["sql"])
            return df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema.spark, strict=True)])
        if kind == "Empty":
            return generated.empty(e.spark, Schema.parse(op["schema"]))
        if kind == "Singleton":
            return generated.singleton(e.spark)
        if kind in ("TupleSource", "CSVFragmentTupleSource"):
            return e.source(op["reader"], op["source"])
        if kind == "TipsyFileScan":
            return formats.tipsy(e.spark, op["tipsyFilename"], op["iorderFilename"], op["grpFilename"])
        if kind == "NChiladaFileScan":
            return formats.nchilada(e.spark, op["nchiladaDirectoryName"], op["groupFileName"])
        if kind == "SeaFlowScan":
            return formats.seaflow(e.spark, op["source"].get("filename") or op["source"]["uri"])
        if kind == "Filter":
            return rel.filter_rows(get("argChild"), op["argPredicate"], e.functions)
        if kind == "Apply":
            return rel.apply(get("argChild"), op["emitExpressions"], bool(op.get("addCounter")), e.functions)
        if kind == "StatefulApply":
            df = get("argChild")
            order = op.get("argOrderColumns") or list(range(len(df.columns)))
            return rel.stateful_apply(df, op.get("argPartitionColumns") or [], order, op["initializerExpressions"], op["updaterExpressions"], op["emitExpressions"])
        if kind == "Counter":
            return rel.counter(get("argChild"), op["columnName"], op.get("argOrderColumns"))
        if kind == "CrossWithSingleton":
            return rel.cross_with_singleton(get("argChild1"), get("argChild2"))
        if kind == "Limit":
            return rel.limit(get("argChild"), op["numTuples"])
        if kind in ("SymmetricHashJoin", "RightHashJoin", "MergeJoin"):
            hint = {"RightHashJoin": "shuffle_hash", "MergeJoin": "merge"}.get(kind)
            return rel.join(get("argChild1"), get("argChild2"), op["argColumns1"], op["argColumns2"], op["argSelect1"], op["argSelect2"], op.get("argColumnNames"), hint=hint, set_left=bool(op.get("argSetSemanticsLeft")), set_right=bool(op.get("argSetSemanticsRight")))
        if kind in ("SymmetricHashCountingJoin", "RightHashCountingJoin"):
            return rel.counting_join(get("argChild1"), get("argChild2"), op["argColumns1"], op["argColumns2"])
        if kind == "LeapFrogJoin":
            classes = [[tuple(p) for p in c] for c in op["joinFieldMapping"]]
            return rel.multiway_join([self.build(ops, c, made) for c in op["argChildren"]], classes, [tuple(p) for p in op["outputFieldMapping"]], op.get("argColumnNames"))
        if kind == "Aggregate":
            return rel.aggregate(get("argChild"), op["argGroupFields"], op["aggregators"], bool(op.get("emptyCompat")), e.functions)
        if kind == "InMemoryOrderBy":
            return rel.order_by(get("argChild"), op["argSortColumns"], op["argAscending"])
        if kind == "Merge":
            dfs = [self.build(ops, c, made) for c in op["argChildren"]]
            return rel.merge(dfs, op["argSortColumns"], op.get("argAscending")) if op.get("argSortColumns") else rel.union_all(*dfs)
        if kind == "UnionAll":
            return rel.union_all(*[self.build(ops, c, made) for c in op["argChildren"]])
        if kind == "Difference":
            return rel.difference(get("argChild1"), get("argChild2"))
        if kind == "DupElim":
            return rel.distinct(get("argChild"))
        if kind == "SamplingDistribution":
            return rel.sampling_distribution(get("argChild"), op.get("sampleSize"), op.get("samplePercentage"), op["sampleType"] == "WithReplacement", op.get("randomSeed") or 0)
        if kind == "Sample":
            return rel.sample_workers(get("argChild2"), get("argChild1"), op.get("randomSeed") or 0)
        raise PlanError(f"{kind} can't stand here")


"""Integrity, lineage and comparison of append-only experiment tables."""

from __future__ import annotations

import datetime
import math
import posixpath
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import hashing
from ..functions.hashing import object_hash

TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def format_value(value: object) -> str:
    """A field as stored: NA for what is missing, 1 or 0, ten significant digits, escaped breaks."""
    if value is None or value == "" or isinstance(value, float) and math.isnan(value):
        return schemas.MISSING
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.10g}"
    text = str(value).replace("\r\n", "\n").replace("\r", "\n")
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def rows(spark: SparkSession, table: str, values: list[dict], now: str | None = None) -> DataFrame:
    """Validated rows of a table, ready to append."""
    now = now or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = []
    for v in values:
        v = ({"ts_utc": now} if "ts_utc" in schemas.TABLES[table] else {}) | v
        schemas.check_row(table, v)
        out.append(tuple(format_value(v.get(c)) for c in schemas.TABLES[table]))
    return spark.createDataFrame(out, schemas.text_schema(table))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_missing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't registered yet, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def check_lines(lines: DataFrame, table: str) -> DataFrame:
    """(table, line, rule, detail) of each fault of a TSV table given as (line, text); the first line is the header."""
    columns = schemas.TABLES[table]
    fields = F.split(F.rtrim(F.col("text"), F.lit("\r")), "\t", -1)
    base = lines.withColumn("f", fields)
    body = base.filter("line > 1")

    def fault(df: DataFrame, rule: str, condition: Column, detail: Column | str = "") -> DataFrame:
        return df.filter(condition).select(F.lit(table).alias("table"), "line", F.lit(rule).alias("rule"), (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"))

    out = fault(base, "crlf", F.col("text").endswith("\r"))
    out = out.unionByName(fault(base.filter("line = 1"), "header", F.col("f") != F.array(*map(F.lit, columns)), F.array_join("f", ",")))
    out = out.unionByName(fault(body, "field count", F.size("f") != len(columns), F.size("f")))
    cells = body.filter(F.size("f") == len(columns)).select("line", F.posexplode("f").alias("k", "value")).withColumn("column", F.element_at(F.array(*map(F.lit, columns)), F.col("k") + 1))
    known = F.col("value") != schemas.MISSING
    out = out.unionByName(fault(cells, "blank cell", F.col("value") == "", F.col("column")))
    out = out.unionByName(fault(cells, "sha256", F.col("column").endswith("sha256") & known & ~F.col("value").rlike("^[0-9a-f]{64}$"), F.col("column")))
    out = out.unionByName(fault(cells, "git commit", (F.col("column") == "git_commit") & known & ~F.col("value").rlike("^[0-9a-f]{40}$"), F.col("value")))
    return out.unionByName(fault(cells, "time", (F.col("column") == "ts_utc") & ~F.col("value").rlike(TIME), F.col("value")))


def check_enums(ledger: DataFrame) -> DataFrame:
    """Rows with an unknown phase or status or a malformed run id."""
    rules = F.array_compact(F.array(F.when(~F.col("phase").isin(schemas.PHASES), F.lit("phase")), F.when(~F.col("status").isin(schemas.STATUSES), F.lit("status")), F.when(~F.col("run_id").rlike(RUN_ID), F.lit("run_id"))))
    return ledger.select("run_id", F.explode(rules).alias("rule"))


def dead_runs(ledger: DataFrame, activity: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """Runs that started and neither ended nor showed any activity within the time before ``now``."""
    open_ = ledger.filter("status = 'start'").join(ledger.filter(F.col("status").isin(schemas.TERMINAL)).select("run_id"), "run_id", "left_anti")
    last = open_.groupBy("run_id").agg(F.max(F.to_timestamp("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("started"))
    seen = activity.groupBy("run_id").agg(F.max(F.to_timestamp("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("active"))
    latest = F.greatest("started", "active")
    return last.join(seen, "run_id", "left").filter(latest < F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'") - F.make_dt_interval(mins=F.lit(minutes))).select("run_id")


def duplicates(df: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Rows that repeat a key of an earlier line; keys that are all NA don't count."""
    some = df.filter(~F.array_min(F.array(*(F.col(k) == schemas.MISSING for k in keys))))
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(line))).filter("__n > 1").drop("__n")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return child.filter(F.col(key) != schemas.MISSING).join(parent.select(key), key, "left_anti")


def migrate(old: DataFrame, columns: list[str]) -> DataFrame:
    """The old rows under a header that begins with theirs, padded with NA; anything else raises."""
    if columns[: len(old.columns)] != old.columns:
        raise ValueError("the old header must be the beginning of the new one")
    return old.select(*old.columns, *(F.lit(schemas.MISSING).alias(c) for c in columns[len(old.columns) :]))


def config_diff(a: DataFrame, b: DataFrame, identity: list[str], timing: list[str], allowed: list[str], critical: list[str]) -> DataFrame:
    """Keys whose values differ, with their class; unknown keys are critical, and a side that lacks a key is "unrecorded", not equal."""
    both = a.toDF("key", "value_a").join(b.toDF("key", "value_b"), "key", "full_outer").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))
    kind = F.when(F.col("key").isin(identity), "identity").when(F.col("key").isin(timing), "timing").when(F.col("key").isin(allowed), "allowed").when(F.col("key").isin(critical), "critical").otherwise("unknown")
    recorded = F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), "unrecorded").otherwise("different")
    return both.select("key", "value_a", "value_b", kind.alias("kind"), recorded.alias("status"), kind.isin("critical", "unknown").alias("blocks"))


def clock_probe(server: Column, sent: Column, received: Column, limit_ms: float) -> Column:
    """Struct of midpoint, offset, round trip, and whether the offset is inside the limit (milliseconds)."""
    middle = (sent + received) / 2.0
    return F.struct(middle.alias("midpoint"), (middle - server).alias("offset"), (received - sent).alias("rtt"), (F.abs(middle - server) <= limit_ms).alias("ok"))


def latest_check(checks: DataFrame, now: str, hours: float = 24.0) -> DataFrame:
    """The last successful clock check that is at most so many hours old at ``now``; no row if there is none."""
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now), form)) - F.unix_timestamp(F.try_to_timestamp("ts_utc", F.lit(form)))) / 3600.0
    rows = checks.filter("status = 'ok'").withColumn("age_hours", age).filter(F.col("age_hours").between(0, hours))
    return rows.orderBy("age_hours").limit(1)


def environment_gate(snapshot: dict, registered: DataFrame, keys: list[str]) -> str:
    """The hash of an environment's versions; an environment that isn't registered raises."""
    digest = object_hash({k: snapshot.get(k, schemas.MISSING) for k in keys})
    if registered.filter(F.col("env_sha256") == digest).isEmpty():
        raise ValueError(f"this environment isn't registered: {digest}")
    return digest


def describe_artifact(spark: SparkSession, root: str, path: str, kind: str, ledger: DataFrame, run_id: str = schemas.MISSING, name: str | None = None, locked: str = "final_test", **more: str) -> dict:
    """The row that registers a file or folder below ``root``.

    Refused are kinds that aren't known, paths outside the root or in the locked
    split, what doesn't exist, and runs that the ledger lacks. The id is the hash
    of kind, name, path, content and run.
    """
    if kind not in schemas.KINDS:
        raise ValueError(f"unknown kind {kind!r}: {', '.join(schemas.KINDS)}")
    own = posixpath.normpath(path)
    if own.startswith(("..", "/")):
        raise ValueError("an artifact lies below the root")
    if locked in own.lower().split("/"):
        raise ValueError(f"artifacts of {locked} can't be registered")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{own}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"{root}/{own}")
    if run_id != schemas.MISSING and ledger.filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"the ledger has no run {run_id!r}")
    files = hashing.file_hashes(spark, f"{root}/{own}")
    row = hashing.folder_hash(files).first() if fs.getFileStatus(where).isDirectory() else files.first()
    identity = {"kind": kind, "name": name or own.rpartition("/")[2], "path": own, "artifact_sha256": row["sha256"], "run_id": run_id}
    rest = {c: more.get(c, schemas.MISSING) for c in ("model_revision", "tokenizer_version", "manifest_sha256", "note")}
    return {"artifact_id": object_hash(identity), **identity, "size_bytes": row["size_bytes"], **rest}


def new_results(before: DataFrame, after: DataFrame) -> DataFrame:
    """Finished runs that one snapshot has more than the other."""
    return after.exceptAll(before).filter(F.col("status").isin("ok", "fail"))


def update_count(updates: Column, tokens_seen: Column, per_update: int = 32_768) -> Column:
    """Struct of the number of updates and where it is from."""
    return F.struct(F.coalesce(updates, F.floor(tokens_seen / per_update)).alias("n"), F.when(updates.isNotNull(), "ledger").when(tokens_seen.isNotNull(), "derived").alias("source"))


def frozen_problems(runs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(run_id, problem) of each frozen rule that doesn't hold or can't be told; none is a pass."""
    named = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return runs.select("run_id", F.explode(named).alias("problem"))


@contextmanager
def run(spark: SparkSession, path: str, phase: str, config: dict, run_id: str | None = None):
    """A run's lifecycle: a start row, ``log`` for metric rows, and an ok or fail row."""
    run_id = run_id or f"{phase}-{uuid.uuid4().hex[:12]}"
    base = {"run_id": run_id, "phase": phase, "config_sha256": object_hash(config)}
    put = lambda table, row: append(rows(spark, table, [row]), f"{path}/{table}")

    def log(table: str, **row) -> None:
        if table not in schemas.METRICS:
            raise ValueError(f"{table} isn't a metric table")
        put(table, {"run_id": run_id, "config_sha256": base["config_sha256"]} | row)

    put("ledger", base | {"status": "start"})
    try:
        yield log
    except BaseException as e:
        put("ledger", base | {"status": "fail", "note": str(e)[:200]})
        raise
    put("ledger", base | {"status": "ok"})

"""Reading and writing of feeds, catalogues, ledgers and reports (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "schemaVersion int, events array<struct<roadName:string,prefecture:string,title:string,startDate:string,endDate:string,publishedAt:string,url:string,status:string>>"


def read_feed(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """SRC-01: events of versioned JSON files; a wrong version or malformed JSON fails the read. Empty text is null."""
    raw = spark.read.schema(EVENT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.assert_true(F.coalesce(F.col("schemaVersion") == version, F.lit(False)) & F.col("events").isNotNull(), F.lit("unexpected feed version"))
    rows = raw.withColumn("_ok", ok).filter("_ok is null").select(F.inline("events"))  # the check runs on every file
    rows = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    return rows.withColumns({c: F.try_to_date(c, "yyyy-MM-dd") for c in ("startDate", "endDate", "publishedAt")})


def read_prefixed(spark: SparkSession, path: str, prefix: str, schema: str, list_field: str) -> DataFrame:
    """SRC-02: one JSON value behind a script prefix such as `window.DATA=`; whole files, one row for each list entry."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", "^\\s*" + prefix, ""), ";\\s*$", "")
    return raw.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("v")).select(F.explode(f"v.{list_field}").alias("r")).select("r.*")


def master_problems(rows: DataFrame, declared: int) -> DataFrame:
    """SRC-02: checks of a station master: declared count, unique ids, complete identity."""
    blank = F.col("id").isNull() | (F.coalesce(F.col("name"), F.lit("")) == "") | (F.coalesce(F.col("prefecture"), F.lit("")) == "")
    return rows.agg((F.count("*") == declared).alias("count_ok"), (F.count("id") == F.countDistinct("id")).alias("unique_ok"), (F.count_if(blank) == 0).alias("identity_ok"))


def read_relaxed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-03: a catalogue with unquoted names and comments, whole files."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema}>>", {"allowUnquotedFieldNames": "true", "allowComments": "true", "allowSingleQuotes": "true"}).alias("v")).select(F.inline("v"))


def with_precedence(local: DataFrame, remote: DataFrame, id: str = "id") -> DataFrame:
    """SRC-03: local rows and those remote rows whose id is not local."""
    return local.unionByName(remote.join(local.select(id), id, "left_anti"), allowMissingColumns=True)


def read_pages(spark: SparkSession, path: str, most: int = 2_000_000) -> DataFrame:
    """SRC-04: fetched pages that are not larger than `most` characters."""
    return spark.read.parquet(path).filter(F.length("html") <= most)


def positioned(lines: DataFrame, band: float = 6.0) -> DataFrame:
    """SRC-05: text lines in reading order: bands of y, then x."""
    return lines.withColumn("band", F.round(F.col("y") / band).cast("int")).orderBy("page", "band", "x")


def rule_problems(rules: DataFrame) -> DataFrame:
    """SRC-06: (id, problem) of source rules that break a demand; valid rules give no rows."""
    copies = rules.groupBy("id").agg(F.count("*").alias("_n"))
    r = rules.join(copies, "id", "left")
    checks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("road_name"), F.lit("")) == "", "missing_name"),
            F.when(F.col("_n") > 1, "duplicate_id"),
            F.when(~F.col("listing_url").startswith("https://"), "unsafe_listing"),
            F.when(~F.col("budget").between(1, 20), "budget_out_of_range"),
            F.when((F.col("mode") == "listing") & (F.size("hosts") == 0), "listing_without_hosts"),
        )
    )
    return r.select("id", F.explode(checks).alias("problem"))


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: the previous run's table; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ledger_problems(rows: DataFrame) -> DataFrame:
    """SRC-08: (key, problem) of review ledger rows outside the allowed decisions, links, dates and evidence."""
    n = rows.groupBy("url", "title").agg(F.count("*").alias("_n"))
    r = rows.join(n, ["url", "title"])
    checks = F.array_compact(
        F.array(
            F.when(~F.col("decision").isin("scheduled", "cancelled"), "decision"),
            F.when(~F.col("url").startswith("https://"), "link"),
            F.when(F.col("start_date").isNull() | (F.col("end_date") < F.col("start_date")), "dates"),
            F.when(F.coalesce(F.col("evidence"), F.lit("")) == "", "evidence"),
            F.when(F.col("_n") > 1, "duplicate"),
        )
    )
    return r.select("event_id", F.explode(checks).alias("problem"))


def overlay(summaries: Column) -> Column:
    """SRC-09: a {name: summary} map as rows (name, summary), to be used in a select."""
    return F.explode(summaries).alias("name", "summary")


def nested_report(rows: DataFrame, keys: list[str], child: list[str]) -> DataFrame:
    """SNK-02: one struct for each key with its child rows as a sorted array, ready for write.json."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*child))).alias("rows"))


def route_text(stops: DataFrame, key: str, order: str, vias: int = 6, header: str = "ROUTE/1") -> DataFrame:
    """SNK-03: a header and the lines of each route: START, VIA and, for the route's own last place, GOAL; quoted names,
    seven decimals. A route of more than `vias` places between, or one without coordinates, fails the job.
    """
    name = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(F.col("name"), F.lit("")), '"', '""'), r"[\r\n]+", " "), F.lit('"'))
    line = F.concat(name, F.format_string(",%.7f,%.7f", "lat", "lng"))
    got = stops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("_all"), F.bool_and(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("_good"))
    n = F.size("_all")
    got = got.filter(F.assert_true((n <= vias + 2) & F.col("_good"), F.lit("a route has too many places or one without coordinates")).isNull())
    role = lambda i: F.when(i == 0, "START,").when(i == n - 1, "GOAL,").otherwise("VIA,")
    return got.select(key, F.concat(F.lit(header + "\n"), F.array_join(F.transform("_all", lambda x, i: F.concat(role(i), x["line"])), "\n")).alias("route"))


def scratch(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder. Where none is set and everything runs in one process, as in
    tests, one is made."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="waystone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/waystone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

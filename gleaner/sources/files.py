"""Files as tables: PDF files, saved reputation and pacing, environment settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import pdf as P
from gleaner.functions import text as T

# Defaults of the settings; names are those of this library's own variables.
PREFIX = "GLEANER_"
DEFAULTS = {"cdp_host": "http://127.0.0.1:9222", "reputation_ttl_secs": 86_400, "serve_host": "127.0.0.1", "serve_port": 9080}


def pdf_files(spark: SparkSession, path: str, max_bytes: int = P.MAX_BYTES) -> DataFrame:
    """Records of the PDF files under a folder: path, length and the fields of :data:`pdf.RECORD`.

    A file over ``max_bytes`` is told by its length alone, its bytes are never read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    names = [p.split()[0] for p in P.RECORD.split(", ")]
    read = files.where(F.col("length") <= max_bytes).select("path", "length", P.record_udf()(F.col("content")).alias("r")).select("path", "length", *[f"r.{n}" for n in names])
    large = files.where(F.col("length") > max_bytes).select("path", "length")
    return read.unionByName(large.withColumn("error", F.lit("Http")), allowMissingColumns=True)


def reputation_files(spark: SparkSession, path: str, now: float, ttl_s: int = DEFAULTS["reputation_ttl_secs"]) -> DataFrame:
    """Saved records, a file a domain: domain, hits, flags and last_seen.

    Files last written more than ``ttl_s`` seconds before ``now`` are passed over, as
    are files that don't parse.
    """
    schema = "last_flags array<string>, hit_count long, last_seen string, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    rows = rows.select("*", F.url_decode(name).alias("domain"), F.col("_metadata.file_modification_time").alias("written"))
    live = rows.where(F.col("_corrupt_record").isNull() & F.col("hit_count").isNotNull() & (F.unix_seconds("written") >= F.lit(int(now - ttl_s))))
    return live.select("domain", F.col("hit_count").alias("hits"), F.coalesce("last_flags", F.array().cast("array<string>")).alias("flags"), "last_seen")


def pacing_file(spark: SparkSession, path: str) -> DataFrame:
    """Saved pacing: engine, last_call_ms, cooldown_until_ms and the paid calls made; no rows without a readable file."""
    schema = "last_calls map<string, long>, cooldowns map<string, long>, api_quota_spend long, _corrupt_record string"
    try:
        rows = spark.read.schema(schema).option("multiLine", "true").json(f"{path}/pacing.json").where("_corrupt_record IS NULL")
    except AnalysisException:  # no such file: nothing is saved yet
        rows = spark.createDataFrame([], schema)
    empty = F.create_map().cast("map<string, long>")
    calls, cooling = F.coalesce("last_calls", empty), F.coalesce("cooldowns", empty)
    engines = F.array_union(F.map_keys(calls), F.map_keys(cooling))
    told = rows.select(F.explode(engines).alias("engine"), calls.alias("c"), cooling.alias("u"), F.coalesce("api_quota_spend", F.lit(0)).alias("api_quota_spend"))
    return told.select("engine", F.col("c")[F.col("engine")].alias("last_call_ms"), F.col("u")[F.col("engine")].alias("cooldown_until_ms"), "api_quota_spend")


def settings(entries: DataFrame) -> DataFrame:
    """Settings of each run from its environment (run, at, key, value), the last usable value of each variable.

    cdp_host, user_agent, update_disabled, reputation_dir, reputation_ttl_secs,
    serve_bind and command_timeouts (lower-case command to seconds).  A port alone
    counts only where no bind address is given; numbers that don't parse are passed over.
    """
    key, value = F.col("key"), F.col("value")
    named = lambda name: key == f"{PREFIX}{name}"
    whole = value.rlike(r"^\+?[0-9]{1,18}$")
    last = lambda when, what=value: F.max_by(F.when(when, what), F.when(when, F.col("at")))
    port = named("SERVE_PORT") & whole & (value.try_cast("long") <= 65535)
    command = F.lower(F.regexp_extract(key, rf"^{PREFIX}(.+)_TIMEOUT$", 1))
    timed = (command != "") & whole
    runs = entries.groupBy("run").agg(
        F.coalesce(last(named("CDP_HOST")), F.lit(DEFAULTS["cdp_host"])).alias("cdp_host"), last(named("USER_AGENT")).alias("user_agent"),
        F.coalesce(T.parse_bool(last(named("UPDATE_DISABLED"))), F.lit(False)).alias("update_disabled"), last(named("REPUTATION_DIR")).alias("reputation_dir"),
        F.coalesce(last(named("REPUTATION_TTL_SECS") & whole).cast("long"), F.lit(DEFAULTS["reputation_ttl_secs"])).alias("reputation_ttl_secs"),
        F.coalesce(last(named("SERVE_BIND")), F.concat(F.lit(f"{DEFAULTS['serve_host']}:"), F.coalesce(last(port).cast("int"), F.lit(DEFAULTS["serve_port"])))).alias("serve_bind"),
    )
    times = entries.where(timed).groupBy("run", command.alias("command")).agg(F.max_by(value.cast("long"), "at").alias("seconds"))
    times = times.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("command", "seconds")))).alias("command_timeouts"))
    return runs.join(times, "run", "left").withColumn("command_timeouts", F.coalesce("command_timeouts", F.create_map().cast("map<string, bigint>")))

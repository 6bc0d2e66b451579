"""Queries on scalar functions, a signed request, a restored backup, and the twins of event rules on streams."""

from __future__ import annotations

import hashlib
import hmac
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.lineage import shared_folder
from cairnfield.plans.history import FEW, SIX_HOURS_MS
from cairnfield.plans.tables import Tables
from cairnfield.sources.files import backup, restore, signature_valid
from cairnfield.streaming import rules

SECRET = "sample"


def _string(t: Tables) -> DataFrame:
    c = F.col("c_name")
    return t("customer").select("c_custkey", F.lower(c).alias("low"), F.trim(F.concat(F.lit("  "), c, F.lit(" "))).alias("trimmed"), c.startswith("Cust").alias("starts"), F.substring(c, 1, 4).alias("head"), F.left(c, F.lit(8)).alias("lefts"), F.char_length(c).alias("chars"), F.octet_length(c).alias("bytes"), F.concat_ws("/", "c_mktsegment", c).alias("joined"), F.replace(c, F.lit("#"), F.lit("-")).alias("replaced"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"), F.split_part(c, F.lit("#"), F.lit(2)).alias("part"), c.contains("00").alias("has"))


def _regex(t: Tables) -> DataFrame:
    c = F.col("text")
    return t("documents").select("doc_id", c.rlike("[0-9]+ (rows|entries)").alias("hit"), F.regexp_extract(c, "([a-z]+)-([a-z]+)[0-9]+", 1).alias("first"), F.size(F.regexp_extract_all(c, F.lit("[a-z]+-[a-z]+[0-9]+"), 0)).alias("names"), F.sha2(F.regexp_replace(c, "[0-9]+", "0"), 256).alias("hash"))


def _date(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("iso"), (ts > F.timestamp_seconds(F.lit(1_705_000_000))).alias("later"), F.floor(F.unix_seconds(ts) / 3600).alias("hours"))


def _math(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").select("event_id", (F.col("event_id") % 384).alias("mod"), F.round(F.sqrt(v), 6).alias("root"), F.round(v * v, 4).alias("square"), F.round(v / 7, 6).alias("ratio"), F.greatest(v, F.lit(10.0)).alias("most"), F.least(v, F.lit(10.0)).alias("least"))


def _array(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    return t("part").select("p_partkey", F.array_contains(w, "small").alias("has"), F.exists(w, lambda x: F.char_length(x) > 5).alias("long_one"), F.forall(w, lambda x: F.char_length(x) > 3).alias("all_long"), F.filter(w, lambda x: x != "red").alias("kept"), F.transform(w, lambda x: F.upper(x)).alias("upper"), F.slice(w, 1, 1).alias("head"), F.array_sort(w).alias("sorted"), F.array_distinct(F.concat(w, w)).alias("once"), F.array_repeat(F.lit(0), 3).alias("zeros"))


def _map(t: Tables) -> DataFrame:
    m = F.map_concat(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), F.create_map(F.lit("name"), F.col("p_name")))
    return t("part").select("p_partkey", F.element_at(m, "brand").alias("brand"), F.array_sort(F.map_keys(m)).alias("keys"), F.size(F.map_entries(m)).alias("entries"), F.element_at(m, "none").isNull().alias("missing"))


def _json(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.from_json("props", "struct<k:int>")["k"].alias("typed"), F.schema_of_variant(F.parse_json("props")).alias("kind"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("text"))


def _null(t: Tables) -> DataFrame:
    s = F.col("source")
    return t("documents").select("doc_id", F.coalesce(s, F.lit("?")).alias("filled"), F.nullif(F.coalesce("lang", F.lit("")), F.lit("")).alias("emptied"), s.eqNullSafe(F.col("doc_type")).alias("same"), F.coalesce(s == F.col("doc_type"), F.lit(True)).alias("loose"))


def _signed(t: Tables) -> DataFrame:
    """Requests whose signatures are right for two of three."""

    def sign(body: str) -> str:
        return "sha256=" + hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest()

    known = {n: sign(f'{{"k": {n}}}') for n in range(100)}
    signatures = F.create_map(*(F.lit(x) for n, s in known.items() for x in (n, s)))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select("event_id", F.col("props").alias("body"), F.when(F.col("event_id") % 3 == 0, F.lit("sha256=0")).otherwise(signatures[k]).alias("signature"))
    return rows.select("event_id", signature_valid(SECRET).alias("valid"))


def _restored(t: Tables) -> DataFrame:
    """Rows of a backup's tables before and after, with what differs."""
    folder = f"{shared_folder(t.spark)}/backup-{uuid.uuid4().hex}"
    tables = {"users": t("users"), "vaults": t("vaults").select("id", "name", "owner_id", "mergeable", "created_at"), "shares": t("shares")}
    backup(tables, folder)
    again = restore(t.spark, folder, {n: df.schema.simpleString()[7:-1].replace(":", " ") for n, df in tables.items()})
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).crossJoin(again[name].exceptAll(df).agg(F.count("*").alias("changed"))).select(F.lit(name).alias("table_name"), "rows", "changed")
        out = row if out is None else out.unionByName(row)
    return out


def _run(t: Tables, build, mode: str) -> DataFrame:
    """Result of a streaming query over the stored events, written to the shared folder and read back."""
    stored = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stored.repartition(4).write.parquet(f"{base}/in")
    stream = build(t.spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"))
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


def _stream_latest(t: Tables) -> DataFrame:
    def build(e: DataFrame) -> DataFrame:
        return rules.latest_state(e.select((F.col("user_id") % 64).alias("vault_id"), F.col("event_type").alias("path"), F.col("props").alias("state"), "ts", "event_id"))

    rows = _run(t, build, "update")
    return rows.groupBy("vault_id", "path").agg(F.max_by("state", "batch").alias("state"))


def queries() -> dict:
    def q(f):
        return lambda s, d: f(Tables(s, d))

    return {
        "scalar_string": q(_string),
        "scalar_regex": q(_regex),
        "scalar_crypto": q(lambda t: t("customer").select("c_custkey", F.sha2("c_name", 256).alias("hash"))),
        "scalar_date": q(_date),
        "scalar_math": q(_math),
        "scalar_array": q(_array),
        "scalar_map": q(_map),
        "scalar_json": q(_json),
        "scalar_null": q(_null),
        "webhook_verify": q(_signed),
        "restore_roundtrip": q(_restored),
        "stream_rate_limit": q(lambda t: _run(t, lambda e: rules.rate_limit(e, FEW, SIX_HOURS_MS, "40 days"), "append")),
        "stream_latest_state": q(_stream_latest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "scalar_string": """select c_custkey, lower(c_name) as low, trim('  ' || c_name || ' ') as trimmed, starts_with(c_name, 'Cust') as starts, substr(c_name, 1, 4) as head, left(c_name, 8) as lefts, cast(length(c_name) as int) as chars,
            cast(strlen(c_name) as int) as bytes, concat_ws('/', c_mktsegment, c_name) as joined, replace(c_name, '#', '-') as replaced, lpad(cast(c_custkey as varchar), 6, '0') as padded, split_part(c_name, '#', 2) as part, contains(c_name, '00') as has from customer""",
        "scalar_regex": """select doc_id, regexp_matches(text, '[0-9]+ (rows|entries)') as hit, regexp_extract(text, '([a-z]+)-([a-z]+)[0-9]+', 1) as first, cast(len(regexp_extract_all(text, '[a-z]+-[a-z]+[0-9]+')) as int) as names,
            sha256(regexp_replace(text, '[0-9]+', '0', 'g')) as hash from documents""",
        "scalar_crypto": "select c_custkey, sha256(c_name) as hash from customer",
        "scalar_date": "select event_id, cast(floor(epoch_us(ts) / 1000) as bigint) as ms, strftime(ts, '%Y-%m-%d %H:%M:%S') as iso, epoch_us(ts) > 1705000000000000 as later, cast(floor(floor(epoch_us(ts) / 1000000) / 3600) as bigint) as hours from events",
        "scalar_math": 'select event_id, event_id % 384 as mod, round(sqrt(value), 6) as root, round(value * value, 4) as square, round(value / 7, 6) as ratio, greatest(value, 10.0) as most, least(value, 10.0) as "least" from events',
        "scalar_array": """select p_partkey, list_contains(w, 'small') as has, len(list_filter(w, lambda x: length(x) > 5)) > 0 as long_one, len(list_filter(w, lambda x: length(x) <= 3)) = 0 as all_long, list_filter(w, lambda x: x <> 'red') as kept,
            list_transform(w, lambda x: upper(x)) as upper, w[1:1] as head, list_sort(w) as sorted, case when w[1] = w[2] then w[1:1] else w end as once, [0, 0, 0] as zeros from (select p_partkey, string_split(p_name, ' ') as w from part)""",
        "scalar_map": "select p_partkey, p_brand as brand, ['brand', 'name', 'type'] as keys, 3 as entries, true as missing from part",
        "scalar_json": """select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(json_extract_string(props, '$.k') as int) as typed, 'OBJECT<k: BIGINT>' as kind, '{"type":"' || event_type || '"}' as text from events""",
        "scalar_null": "select doc_id, coalesce(source, '?') as filled, nullif(coalesce(lang, ''), '') as emptied, source is not distinct from doc_type as same, coalesce(source = doc_type, true) as loose from documents",
        "webhook_verify": "select event_id, event_id % 3 <> 0 as valid from events",
        "restore_roundtrip": """select 'users' as table_name, count(*) as "rows", 0 as changed from customer union all select 'vaults', count(*), 0 from vaults union all select 'shares', count(*), 0 from part""",
        "stream_latest_state": "select user_id % 64 as vault_id, event_type as path, arg_max(props, (ts, event_id)) as state from events group by all",
    }

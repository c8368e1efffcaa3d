"""The registered queries: every operator of the package run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowferry.functions.compare import values_match
from rowferry.functions.params import parameterised_query
from rowferry.functions.typemap import map_types
from rowferry.model import Endpoint, FieldMapping, JobSpec, ParamDef, ParamOption, Watermark
from rowferry.operators import changes as X
from rowferry.operators import filters, keyless, mapping, merge, paging, quality, relations, schema, shards
from rowferry.plans import jobs, reports
from rowferry.plans.preview import export_job
from rowferry.plans.store import KeyedTable, run_log
from rowferry.session import remove, scratch_path
from rowferry.sources import documents, files
from rowferry.streaming import replicate as R

OR_FILTER = "o_orderstatus = 'P' OR o_totalprice > 200000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans, mappings and filters ---------------------------------------------------------------


def table_scan(spark, d):
    rows = filters.where_all(table(spark, d, "lineitem"), "l_returnflag = 'R'", "l_quantity > 45")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


def filtered_count(spark, d):
    return filters.where_all(table(spark, d, "lineitem"), "l_discount >= 0.05").agg(F.count("*").alias("rows"))


def mapped_copy(spark, d):
    maps = [
        FieldMapping("c_custkey", "id"),
        FieldMapping("c_name", "full_name"),
        FieldMapping("c_acctbal", enabled=False),
        FieldMapping("c_mktsegment"),
    ]
    return mapping.map_columns(table(spark, d, "customer"), maps)


def filtered_copy(spark, d):
    """A whole job: filter, rename, write to a parquet target, read the target back."""
    out = scratch_path(spark, "filtered_copy")
    spec = JobSpec(
        name="orders-copy",
        source=Endpoint("parquet", path=d),
        source_table="orders.parquet",
        target=Endpoint("parquet", path=out),
        target_table="orders",
        mappings=[FieldMapping("o_orderkey", "order_id"), FieldMapping("o_custkey", "customer_id"), FieldMapping("o_orderstatus"), FieldMapping("o_totalprice")],
        filter=OR_FILTER,
        quality=False,
    )
    done(jobs.run_job(spark, spec, out))
    return jobs.read_target(spark, spec.target, "orders")


def done(result):
    if result.status != "success":
        raise RuntimeError(result.error)
    return result


def or_filter_with_watermark(spark, d):
    orders = filters.where_all(table(spark, d, "orders"), OR_FILTER)
    return filters.after_mark(orders, Watermark("o_orderkey", "id"), "700").select("o_orderkey", "o_orderstatus", "o_totalprice")


def incremental_id(spark, d):
    batch, _ = jobs.incremental_batch(table(spark, d, "orders"), Watermark("o_orderkey", "id"), "500", "o_orderpriority LIKE '1%'")
    return batch.select("o_orderkey", "o_custkey", "o_orderdate")


def incremental_ts(spark, d):
    rows = filters.after_mark(table(spark, d, "events"), Watermark("ts", "timestamp"), "2024-01-20T06:00:00+02:00")
    return rows.select("event_id", "ts", "user_id", "event_type")


def incremental_two_runs(spark, d):
    """An incremental job that stops in mid-January and runs again later ends with the whole table."""
    out = scratch_path(spark, "incremental")
    base = dict(
        name="events-by-time",
        source=Endpoint("parquet", path=d),
        source_table="events.parquet",
        target=Endpoint("parquet", path=out),
        target_table="events",
        watermark=Watermark("ts", "timestamp"),
        quality=False,
    )
    done(jobs.run_job(spark, JobSpec(**base, filter="ts < timestamp_ntz'2024-01-15 12:00:00'"), out))
    spec = JobSpec(**base)
    done(jobs.run_job(spark, spec, out))
    return jobs.read_target(spark, spec.target, "events")


def _stopped_once(spark, spec, root):
    """The job fails when a part of its chunks is in, and is run again."""
    failures = []

    def tell(phase, rows, percent):
        if phase == "data" and percent > 30 and not failures:
            failures.append(percent)
            raise RuntimeError("stopped")

    first = jobs.run_job(spark, spec, root, on_progress=tell)
    if first.status != "failed":
        raise RuntimeError("the first run was to fail")
    done(jobs.run_job(spark, spec, root, on_progress=tell))


def resumed_job(spark, d):
    """A filtered copy into plain files that fails in the middle and goes on: no row twice, none lost."""
    out = scratch_path(spark, "resumed")
    spec = JobSpec(
        name="orders-in-chunks", source=Endpoint("parquet", path=d), source_table="orders.parquet", target=Endpoint("parquet", path=out), target_table="orders",
        mappings=[FieldMapping("o_orderkey", "order_id"), FieldMapping("o_custkey"), FieldMapping("o_totalprice")], filter=OR_FILTER, chunks=6, chunk_key="o_orderkey", quality=False,
    )
    _stopped_once(spark, spec, f"{out}/_jobs")
    return jobs.read_target(spark, spec.target, "orders")


def resumed_upsert(spark, d):
    """An incremental copy into a keyed table that fails in the middle and goes on; the mark moves once all is in."""
    out = scratch_path(spark, "resumed")
    spec = JobSpec(
        name="events-in-chunks", source=Endpoint("parquet", path=d), source_table="events.parquet", target=Endpoint("parquet", path=out), target_table="events",
        watermark=Watermark("ts", "timestamp"), write="upsert", keys=["event_id"], buckets=4, chunks=4, quality=False,
    )
    _stopped_once(spark, spec, f"{out}/_jobs")
    return jobs.read_target(spark, spec.target, "events", ["event_id"])


def late_rows(spark, d):
    """Two runs of an append job; rows of the last days before its mark, and ties with it, arrive between them."""
    out = scratch_path(spark, "late")
    events = table(spark, d, "events")
    middle = events.agg(F.percentile_approx("event_id", 0.5).alias("n")).first()["n"]
    early = events.where((F.col("event_id") <= middle) & ((F.col("event_id") % 7 > 0) | (F.col("event_id") < middle - 500)))
    spec = JobSpec(
        name="events-late", source=Endpoint("parquet", path=f"{out}/source"), source_table="events", target=Endpoint("parquet", path=out), target_table="events",
        watermark=Watermark("event_id", "id", overlap=600), quality=False,
    )
    early.write.parquet(f"{out}/source/events")
    done(jobs.run_job(spark, spec, f"{out}/_jobs"))
    events.join(early.select("event_id"), "event_id", "left_anti").select(*events.columns).write.mode("append").parquet(f"{out}/source/events")
    done(jobs.run_job(spark, spec, f"{out}/_jobs"))
    return jobs.read_target(spark, spec.target, "events")


def next_watermark(spark, d):
    return filters.where_all(table(spark, d, "orders"), "o_orderstatus <> 'P'").agg(F.max("o_orderkey").alias("high_water"))


def point_lookup(spark, d):
    return filters.lookup(table(spark, d, "lineitem"), "l_orderkey", range(0, 1500, 15)).select("l_orderkey", "l_partkey", "l_quantity")


def key_bounds(spark, d):
    return shards.key_bounds(filters.where_all(table(spark, d, "lineitem"), "l_returnflag = 'N'"), "l_orderkey")


def shard_counts(spark, d):
    return shards.shard_counts(table(spark, d, "lineitem"), "l_orderkey", shards.MAX_SOURCE_SHARDS)


def _squared_lines(spark, d) -> DataFrame:
    """Lines with a key whose values thin out as they grow, and as a text and a time (of microseconds, which every bigint is)."""
    square = F.col("l_orderkey") * F.col("l_orderkey")
    return table(spark, d, "lineitem").select("*", square.alias("squared"), F.concat(F.lit("k"), square.cast("string")).alias("name"), F.timestamp_micros(square).alias("at"))


def balanced_shards(spark, d):
    """Whether ranges of a number, a text and a time hold like numbers of rows, within 10%, and every row."""
    lines = _squared_lines(spark, d)
    out = None
    for key in ("squared", "name", "at"):
        counts = shards.balanced_counts(lines, key, shards.MAX_SOURCE_SHARDS)
        mean = F.sum("rows") / shards.MAX_SOURCE_SHARDS
        row = counts.agg(
            F.lit(key).alias("key"), F.count("*").alias("shards"), ((F.max("rows") <= mean * 1.1) & (F.min("rows") >= mean * 0.9)).alias("even"), F.sum("rows").alias("rows")
        )
        out = row if out is None else out.unionByName(row)
    return out


def balanced_union(spark, d):
    """A table read by ranges of a text and put together again."""
    return shards.union_of_ranges(_squared_lines(spark, d).select("l_orderkey", "l_linenumber", "name"), "name", 6)


def shard_union(spark, d):
    return shards.union_of_shards(table(spark, d, "labels"), "doc_id", shards.MAX_SOURCE_SHARDS)


def resumed_copy(spark, d):
    """A chunked copy whose later chunks were lost copies just those again."""
    out = scratch_path(spark, "resumed")
    source = table(spark, d, "orders")
    jobs.copy_in_chunks(source, out, "o_orderkey", 4)
    for chunk in (2, 3):
        remove(spark, f"{out}/rows/chunk={chunk}")
    jobs.copy_in_chunks(source, out, "o_orderkey", 4)
    return jobs.read_chunks(spark, out)


# --- writes and merges -------------------------------------------------------------------------


def drifted_orders(orders: DataFrame) -> DataFrame:
    """A target that fell behind: some orders missing, some with another price."""
    price = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 70 == 0, 1).otherwise(0)
    return orders.where("o_orderkey % 50 <> 0").withColumn("o_totalprice", price)


def insert_skip(spark, d):
    orders = table(spark, d, "orders")
    target = drifted_orders(orders)
    return target.unionByName(merge.insert_skip(target, orders, ["o_orderkey"], ["o_orderdate"], null_keys=False))


def upsert(spark, d):
    orders = table(spark, d, "orders")
    target = drifted_orders(orders).withColumn("note", F.concat(F.lit("t"), F.col("o_custkey").cast("string")))
    changed = orders.where("o_orderkey % 3 <> 1").select("o_orderkey", "o_totalprice", F.lower("o_orderstatus").alias("o_orderstatus"))
    return merge.upsert(target, changed, ["o_orderkey"], ["o_totalprice"], null_keys=False)


def upsert_last_wins(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    keys, order = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    target = merge.keep_first(lines, keys, order).withColumn("l_quantity", F.lit(0.0)).where("l_linenumber <= 3")
    return merge.upsert(target, lines, keys, order, null_keys=False)


def upsert_job(spark, d):
    """The upsert as a job on a bucketed table: a first load, then only the touched buckets are rewritten."""
    out = scratch_path(spark, "upsert")
    target = Endpoint("parquet", path=out)
    base = dict(
        name="orders-upsert",
        source=Endpoint("parquet", path=d),
        source_table="orders.parquet",
        target=target,
        target_table="orders",
        keys=["o_orderkey"],
        order_by=["o_custkey"],
        quality=False,
    )
    done(jobs.run_job(spark, JobSpec(**base, filter="o_orderkey % 50 <> 0"), out))
    fixed = [FieldMapping("o_orderkey"), FieldMapping("o_custkey", "o_custkey"), FieldMapping("o_custkey", "o_totalprice")]
    done(jobs.run_job(spark, JobSpec(**base, write="upsert", filter="o_orderkey % 25 = 0", mappings=fixed), out))
    return jobs.read_target(spark, target, "orders", ["o_orderkey"])


def replace_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    fresh = docs.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("v2").alias("revision"))
    return merge.replace_rows(docs.where("doc_id % 6 <> 0"), fresh, ["doc_id"], [])


def duplicate_keys(spark, d):
    lines = table(spark, d, "lineitem")
    return merge.duplicate_keys(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_orderkey", "l_linenumber"])


def append_job(spark, d):
    """A keyed append in two runs: the second adds files and rewrites nothing."""
    out = scratch_path(spark, "append")
    target = Endpoint("parquet", path=out)
    base = dict(
        name="customer-append",
        source=Endpoint("parquet", path=d),
        source_table="customer.parquet",
        target=target,
        target_table="customer",
        keys=["c_custkey"],
        quality=False,
    )
    done(jobs.run_job(spark, JobSpec(**base, filter="c_nationkey < 10"), out))
    done(jobs.run_job(spark, JobSpec(**base, filter="c_nationkey >= 10"), out))
    return jobs.read_target(spark, target, "customer", ["c_custkey"])


def structure_job(spark, d):
    """Structure and data in one job, then the structure again after the target drifted."""
    out = scratch_path(spark, "structure")
    target = Endpoint("parquet", path=out)
    base = dict(
        name="supplier-both",
        source=Endpoint("parquet", path=d),
        source_table="supplier.parquet",
        target=target,
        target_table="supplier",
        keys=["s_suppkey"],
        quality=False,
    )
    maps = [FieldMapping("s_suppkey"), FieldMapping("s_name", "s_label"), FieldMapping("s_nationkey"), FieldMapping("s_acctbal", enabled=False)]
    done(jobs.run_job(spark, JobSpec(**base, kind="both", mappings=maps), out))
    done(jobs.run_job(spark, JobSpec(**base, kind="structure", allow_drop=True), out))
    return jobs.read_target(spark, target, "supplier", ["s_suppkey"])


def export_query(spark, d):
    """A parameterised query exported as CSV and read back as text."""
    out = scratch_path(spark, "export")
    spec = JobSpec(
        name="order counts",
        kind="sql_import",
        source=Endpoint("parquet", path=d),
        source_tables=["orders.parquet"],
        target=Endpoint("csv", path=out),
        sql="SELECT o_custkey, count(*) AS orders, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = {{status}} GROUP BY o_custkey",
        params=[ParamDef("status", required=True)],
    )
    return files.read_csv(spark, export_job(spark, spec, {"status": "F"}))


def csv_round_trip(spark, d):
    """Texts with quotes, commas and newlines go out as CSV and come back as they were."""
    out = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    files.write_csv(docs, out, ["doc_id", "lang", "text"])
    return files.read_csv(spark, out)


# --- structure ---------------------------------------------------------------------------------

RAW_TYPES = ["INT", "tinyint(1)", "VARCHAR(%s)", "DECIMAL(%s,2)", "DATETIME", "TEXT", "DOUBLE", "BLOB", "bigint", "JSON", "ENUM(1)", "char(3)"]


def catalog(spark, d) -> DataFrame:
    """A column catalog of many tables, one column per part: 40 columns a table."""
    kinds = F.array(*[F.lit(k) for k in RAW_TYPES])
    kind = F.element_at(kinds, (F.col("p_size") % len(RAW_TYPES) + 1).cast("int"))
    return table(spark, d, "part").select(
        F.expr("concat('t', p_partkey div 40)").alias("table"),
        (F.col("p_partkey") % 40 + 1).cast("int").alias("ordinal"),
        F.expr("concat(replace(p_name, ' ', '_'), '_', p_partkey % 40)").alias("name"),
        F.replace(kind, F.lit("%s"), F.col("p_size").cast("string")).alias("raw_type"),
        (F.col("p_partkey") % 3 != 0).alias("nullable"),
        F.when(F.col("p_partkey") % 11 == 0, "0").alias("default_val"),
        (F.col("p_partkey") % 40 == 0).alias("is_primary"),
        F.lit("mysql").alias("dialect"),
    )


def drifted_catalog(spark, d) -> DataFrame:
    """The same tables as PostgreSQL holds them, out of step: columns missing, extra, retyped and respelled."""
    there = schema.to_dialect(catalog(spark, d), "postgresql").where("ordinal % 9 <> 0")
    return there.select(
        "table",
        "ordinal",
        F.when(F.col("ordinal") % 10 == 0, F.concat(F.lit("old_"), "name")).when(F.col("ordinal") % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("ordinal") % 7 == 0, "TEXT").when(F.col("ordinal") % 5 == 0, F.lower("raw_type")).otherwise(F.col("raw_type")).alias("raw_type"),
        "nullable",
        "default_val",
        "is_primary",
        "dialect",
    )


def type_map(spark, d):
    both = map_types(map_types(catalog(spark, d), "postgresql", out="pg_type"), "oracle", out="oracle_type")
    return both.select("table", "ordinal", "raw_type", "pg_type", "oracle_type")


def catalog_primary_keys(spark, d):
    cols = catalog(spark, d)
    keys = cols.where("ordinal % 13 = 0").select("table", "name").unionByName(cols.where("ordinal % 26 = 0").select("table", "name"))
    return schema.mark_primary(cols, keys).select("table", "ordinal", "name", "is_primary")


def auto_map(spark, d):
    return mapping.auto_map(catalog(spark, d), drifted_catalog(spark, d)).select("table", "source_field", "target_field", "enabled")


def create_table_ddl(spark, d):
    return schema.create_table_ddl(catalog(spark, d), "postgresql")


def schema_diff(spark, d):
    return schema.schema_diff(catalog(spark, d), drifted_catalog(spark, d), "postgresql").select("table", "action", "name", "raw_type", "position")


def alter_ddl(spark, d):
    return schema.alter_ddl(schema.schema_diff(catalog(spark, d), drifted_catalog(spark, d), "postgresql"), "postgresql")


# --- quality -----------------------------------------------------------------------------------


def _order_pairs(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, c) for c in df.columns]


def quality_counts(spark, d):
    orders = table(spark, d, "orders")
    return quality.row_counts(orders.where("o_orderkey % 10 <> 0"), drifted_orders(orders))


def quality_sample(spark, d):
    orders = table(spark, d, "orders")
    return quality.sample_compare(orders, drifted_orders(orders), ["o_orderkey"], _order_pairs(orders), how="first")


def quality_random_sample(spark, d):
    """The sample picked by key hash, of a target that holds every row as it is: all must match."""
    orders = table(spark, d, "orders")
    return quality.sample_compare(orders, orders, ["o_orderkey"], _order_pairs(orders))


def quality_status(spark, d):
    orders = table(spark, d, "orders")
    target = orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 20 == 0, 1).otherwise(0))
    return quality.check_quality(orders, target, _order_pairs(orders), ["o_orderkey"], how="first")


def _drifted_lines(spark, d):
    lines = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    target = lines.where("l_orderkey % 50 <> 0").select(
        *keys,
        (F.col("l_quantity") + F.when(F.col("l_partkey") % 70 == 0, 1).otherwise(0)).alias("l_quantity"),
        (F.col("l_extendedprice") + F.lit(0.00001)).alias("l_extendedprice"),
        F.when(F.col("l_suppkey") % 9 == 0, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_shipdate",
    )
    return lines, target, keys, [(c, c) for c in ("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")]


def full_compare(spark, d):
    return quality.full_compare(*_drifted_lines(spark, d))


def compare_tables(spark, d):
    """The same comparison by digests first, then fields of the keys that differ."""
    lines, target, keys, pairs = _drifted_lines(spark, d)
    return quality.compare_tables(lines, target.withColumn("l_extendedprice", F.col("l_extendedprice") - 0.00001), keys, pairs)


def differing_keys(spark, d):
    orders = table(spark, d, "orders")
    return quality.differing_keys(orders, drifted_orders(orders), ["o_orderkey"], _order_pairs(orders))


def descend_keys(spark, d):
    """Two nearly equal tables whose differences lie in few key ranges: a dense stretch and one missing row."""
    orders = table(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey").alias("n")).first()["n"]
    changed = F.col("o_orderkey").between(top * 2 // 5, top * 2 // 5 + 20)
    target = orders.where(F.col("o_orderkey") != top // 3).withColumn("o_totalprice", F.col("o_totalprice") + F.when(changed, 1).otherwise(0))
    return quality.descend(orders, target, ["o_orderkey"], _order_pairs(orders), least=500)


def tolerant_match(spark, d):
    """Text forms compared: equal, numerically close, and far values, and texts that only start like a number."""
    lines = table(spark, d, "lineitem")
    a = F.when(F.col("l_linenumber") == 7, F.concat(F.col("l_suppkey").cast("string"), F.lit("abc"))).otherwise(F.col("l_quantity").cast("string"))
    b = F.when(F.col("l_linenumber") == 7, F.concat(F.col("l_suppkey").cast("string"), F.lit("xyz"))).otherwise(
        (F.col("l_quantity") + F.col("l_partkey") % 3 * 0.00004 + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)).cast("string")
    )
    ok = values_match(F.col("a"), F.col("b"), T.StringType(), T.StringType())
    return lines.select("l_returnflag", a.alias("a"), b.alias("b")).groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(ok).alias("matched"))


# --- parameterised SQL and pages ---------------------------------------------------------------

REPORT_SQL = """
SELECT c.c_mktsegment AS segment, concat('since {{since}}') AS label, count(*) AS orders, max(o.o_totalprice) AS top_price
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey -- not {{this}}
WHERE o.o_orderdate >= {{since}} AND o.o_orderstatus = {{status}} AND c.c_nationkey < {{nations}}
GROUP BY c.c_mktsegment;
"""
REPORT_PARAMS = [
    ParamDef("since", "date", required=True, default="1995-03-01"),
    ParamDef("status", "select", options=[ParamOption("F"), ParamOption("O")]),
    ParamDef("nations", "number", required=True),
]


def _report(spark, d) -> DataFrame:
    spec = JobSpec(
        name="segments",
        kind="sql_import",
        source=Endpoint("parquet", path=d),
        source_tables=["orders.parquet", "customer.parquet"],
        target=Endpoint("csv"),
        sql=REPORT_SQL,
        params=REPORT_PARAMS,
    )
    return jobs.query_rows(spark, spec, {"status": "O", "nations": "12"})


def param_query(spark, d):
    return _report(spark, d)


def sql_import(spark, d):
    """A SQL job: the query's rows land in a parquet target under the query's own column names."""
    out = scratch_path(spark, "sql_import")
    spec = JobSpec(
        name="big-customers",
        kind="sql_import",
        source=Endpoint("parquet", path=d),
        source_tables=["orders.parquet", "customer.parquet"],
        target=Endpoint("parquet", path=out),
        target_table="rows",
        sql="SELECT c_custkey, c_name, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > {{floor}} GROUP BY ALL;",
        params=[ParamDef("floor", "number", default="100000")],
    )
    done(jobs.run_job(spark, spec, out))
    return jobs.read_target(spark, spec.target, "rows")


def preview_page(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 20")
    return paging.preview(rows, 3, 500, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).rows


def page_text_rest(spark, d):
    """All that follow a deep position, ordered by nulls, ties and texts."""
    rows = table(spark, d, "documents").select(F.expr("nullif(lang, 'en')").alias("lang"), "source", "text", "doc_id")
    return paging.page(rows, ["lang", "source", "text"], table(spark, d, "documents").count() // 3).select("lang", "source", "doc_id")


def page_ties(spark, d):
    """A page in the middle of rows of which many are equal in all columns."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return paging.deep_page(rows, ["l_linestatus", "l_returnflag"], 5000, rows.count() // 2)


def page_offset(spark, d):
    return paging.page(table(spark, d, "orders"), ["o_orderkey"], 100, 250).select("o_orderkey", "o_totalprice")


def page_deep(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    return paging.deep_page(rows, ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"], 4000, 300, cuts=50)


# --- change feeds ------------------------------------------------------------------------------


def event_feed(spark, d) -> DataFrame:
    """The events as a change feed of a table keyed by user."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    row = F.struct("user_id", "event_type", "value", "ts")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), row.alias("after"))


def user_table(spark, d) -> DataFrame:
    """What the feed's target held before: every third customer id, with a column the feed does not know."""
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("user_id"),
        F.lit("seed").alias("event_type"),
        F.col("c_acctbal").alias("value"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("c_name").alias("home"),
    )


def apply_changes_strict(spark, d):
    return X.apply_changes(user_table(spark, d), event_feed(spark, d), ["user_id"])


def apply_changes_upsert(spark, d):
    return X.apply_changes(user_table(spark, d), event_feed(spark, d), ["user_id"], mode="upsert")


def apply_changes_hot(spark, d):
    """The strict replay in stretches short enough that most keys take several levels."""
    return X.apply_changes(user_table(spark, d), event_feed(spark, d), ["user_id"], level_bits=6)


def apply_changes_one_key(spark, d):
    """The strict replay of a feed of which one key has half of all events."""
    feed = event_feed(spark, d)
    user = F.when(F.col("seq") % 2 == 0, F.lit(3)).otherwise(F.col("after.user_id")).cast("long")
    return X.apply_changes(user_table(spark, d), feed.withColumn("after", F.col("after").withField("user_id", user)), ["user_id"], level_bits=8)


def apply_key_moves(spark, d):
    """Some purchases move their row to another user."""
    moved = F.when((F.col("op") == "U") & (F.col("after.event_type") == "purchase") & (F.col("seq") % 2 == 0), (F.col("after.user_id") * 7 + F.col("seq")) % 150)
    feed = event_feed(spark, d).select(
        "seq",
        "op",
        F.struct(F.col("after.user_id").alias("user_id")).alias("before"),
        F.struct(F.coalesce(moved, F.col("after.user_id")).alias("user_id"), "after.event_type", "after.value", "after.ts").alias("after"),
    )
    return X.apply_changes(user_table(spark, d), feed, ["user_id"])


def apply_unchanged_values(spark, d):
    """Clicks leave ``value`` out; the row keeps the value it had."""
    feed = event_feed(spark, d).withColumn("unchanged", F.when(F.col("after.event_type") == "click", F.array(F.lit("value"))))
    lost = F.col("after").withField("value", F.when(F.col("unchanged").isNull(), F.col("after.value")))
    return X.apply_changes(user_table(spark, d), feed.withColumn("after", lost), ["user_id"])


def apply_keyless(spark, d):
    """No key: signups add rows, errors remove all older rows of the user, updates do not count."""
    e = event_feed(spark, d)
    row = F.struct(F.col("after.user_id").alias("user_id"), F.when(F.col("op") != "D", F.col("after.event_type")).alias("event_type"))
    target = user_table(spark, d).select("user_id", "event_type")
    return X.apply_keyless(target, e.withColumn("after", row))


def mapped_feed(spark, d):
    """A feed whose columns are renamed, kept and dropped on the way."""
    maps = [FieldMapping("event_type", "last_event"), FieldMapping("value", enabled=False)]
    target = user_table(spark, d).select("user_id", F.col("event_type").alias("last_event"), "ts", "home")
    return X.apply_changes(target, event_feed(spark, d), ["user_id"], mode="upsert", mappings=maps)


def feed_rejects(spark, d):
    """The events of a feed that cannot be applied, with the reason."""
    feed = event_feed(spark, d)
    op = F.when(F.col("seq") % 97 == 0, "T").otherwise(F.col("op"))
    after = F.when(F.col("seq") % 89 != 0, F.col("after").withField("user_id", F.when(F.col("seq") % 83 != 0, F.col("after.user_id"))))
    _, bad = X.split_feed(feed.select("seq", op.alias("op"), after.alias("after")), ["user_id"])
    return bad.select("seq", "op", "reason")


def stream_replicate(spark, d):
    """The feed as a stream: four deliveries, a restart before each, and some bad events among them."""
    out = scratch_path(spark, "stream")
    feed = event_feed(spark, d).withColumn("table", F.lit("users")).withColumn("before", F.when(F.col("op") == "D", F.col("after")))
    top = feed.agg(F.max("seq").alias("n")).first()["n"]
    users = KeyedTable(spark, f"{out}/users", ["user_id"], buckets=8)
    users.commit(user_table(spark, d))
    row = feed.schema["after"].dataType
    for part in range(4):
        low, high = (top + 1) * part // 4, (top + 1) * (part + 1) // 4
        chunk = feed.where((F.col("seq") >= low) & (F.col("seq") < high))
        noise = chunk.where("seq % 100 = 0").withColumn("op", F.lit("?"))
        other = chunk.where("seq % 50 = 0").withColumn("table", F.lit("others"))
        chunk.unionByName(noise).unionByName(other).write.mode("append").parquet(f"{out}/feed")
        source = R.read_feed(spark, f"{out}/feed", R.feed_schema(row), "users", fmt="parquet")
        R.replicate(source, users, f"{out}/checkpoint", f"{out}/rejects").awaitTermination()
    return users.read()


def stream_keyless(spark, d):
    """The keyless feed as a stream of four deliveries with a restart before each, some of them bad events."""
    out = scratch_path(spark, "keyless")
    e = event_feed(spark, d)
    row = F.struct(F.col("after.user_id").alias("user_id"), F.when(F.col("op") != "D", F.col("after.event_type")).alias("event_type"))
    feed = e.withColumn("after", row).withColumn("table", F.lit("users")).withColumn("before", F.when(F.col("op") == "D", F.col("after")))
    top = feed.agg(F.max("seq").alias("n")).first()["n"]
    users = R.load_keyless(user_table(spark, d).select("user_id", "event_type"), f"{out}/users", buckets=8)
    for part in range(4):
        chunk = feed.where((F.col("seq") >= (top + 1) * part // 4) & (F.col("seq") < (top + 1) * (part + 1) // 4))
        noise = chunk.where("seq % 100 = 0").withColumn("op", F.lit("?"))
        chunk.unionByName(noise).write.mode("append").parquet(f"{out}/feed")
        source = R.read_feed(spark, f"{out}/feed", R.feed_schema(feed.schema["after"].dataType), "users", fmt="parquet")
        R.replicate_keyless(source, users, f"{out}/checkpoint", f"{out}/rejects").awaitTermination()
    return keyless.from_bag(users.read())


def message_feed(spark, d) -> DataFrame:
    """The events as bare values: the second third of them adds a column, the last one drops one and reorders the rest.

    Every 50th is there a second time, for a relation that no message describes.
    """
    e = table(spark, d, "events")
    third = (e.agg(F.max("event_id").alias("n")).first()["n"] + 1) // 3
    phase = F.when(F.col("event_id") < third, 0).when(F.col("event_id") < 2 * third, 1).otherwise(2)
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")

    def cells(*names: str):
        return F.array(*[F.struct(F.when(F.col(n).isNull(), "n").otherwise("t").alias("kind"), F.col(n).cast("string").alias("value")) for n in names])

    layouts = [("user_id", "event_type", "value"), ("user_id", "event_type", "value", "props"), ("props", "user_id", "event_type")]
    kinds = {"user_id": "int8", "event_type": "text", "value": "float8", "props": "text"}
    values = F.when(phase == 0, cells(*layouts[0])).when(phase == 1, cells(*layouts[1])).otherwise(cells(*layouts[2]))
    none = F.lit(None)
    rows = e.select(
        (F.col("event_id") * 2 + 1).alias("seq"), op.alias("kind"), F.lit(7).cast("long").alias("relation"), none.cast("string").alias("table"),
        none.cast(relations.MESSAGES["columns"].dataType).alias("columns"), F.when(op == "D", values).alias("before"), F.when(op != "D", values).alias("after"),
    )
    told = [(2 * third * n, "R", 7, "public.users", [(c, kinds[c]) for c in names], None, None) for n, names in enumerate(layouts)]
    stray = rows.where("seq % 100 = 1").withColumn("relation", F.lit(99).cast("long"))
    return rows.unionByName(stray).unionByName(spark.createDataFrame(told, relations.MESSAGES))


def apply_schema_messages(spark, d):
    """A feed whose table changes its columns twice, as one batch."""
    target = user_table(spark, d).drop("ts")
    return relations.apply_messages(target, message_feed(spark, d), "public.users", ["user_id"])[0]


def schema_message_rejects(spark, d):
    """What no schema message explains, with the reason."""
    return relations.apply_messages(user_table(spark, d).drop("ts"), message_feed(spark, d), "public.users", ["user_id"])[1]


def stream_schema_messages(spark, d):
    """The same feed as a stream of three deliveries with a restart before each; the cuts do not fall on the changes."""
    out = scratch_path(spark, "messages")
    feed = message_feed(spark, d)
    top = feed.agg(F.max("seq").alias("n")).first()["n"]
    users = KeyedTable(spark, f"{out}/users", ["user_id"], buckets=4)
    users.commit(user_table(spark, d).drop("ts"))
    for part in range(3):
        low, high = ((top + 1) * cut // 100 for cut in ((0, 45), (45, 60), (60, 100))[part])
        feed.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{out}/feed")
        source = spark.readStream.schema(relations.MESSAGES).parquet(f"{out}/feed")
        R.replicate_messages(source, users, "public.users", f"{out}/checkpoint", f"{out}/rejects").awaitTermination()
    return users.read()


# --- documents ---------------------------------------------------------------------------------


def event_documents(spark, d) -> DataFrame:
    """The events as nested documents."""
    props = F.from_json("props", "k long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("_id"),
        "user_id",
        F.struct(F.col("event_type").alias("type"), F.struct(props["k"].alias("k"), F.col("value").alias("amount")).alias("detail")).alias("event"),
        F.array("event_type").alias("tags"),
    )


def flatten_documents(spark, d):
    return documents.flatten(event_documents(spark, d)).drop("tags")


DOCUMENT_FILTER = """{"$or": [{"event.type": "purchase", "event.detail.amount": {"$gte": 15}},
  {"event.detail.k": {"$in": [1, 2, 3]}}, {"tags": "signup", "event.detail.k": {"$gt": 90, "$lte": 95}}],
  "user_id": {"$ne": 7}}"""


def document_filter(spark, d):
    docs = event_documents(spark, d)
    return docs.where(filters.document_predicate(docs.schema, DOCUMENT_FILTER)).select("_id", "user_id")


def document_round_trip(spark, d):
    """Nested documents go out as JSON lines and come back filtered, projected and flattened."""
    out = scratch_path(spark, "documents")
    docs = event_documents(spark, d)
    documents.write_documents(docs, out)
    return documents.read_documents(spark, out, ["_id", "event.detail"], '{"event.type": {"$nin": ["click", "view"]}}', schema=docs.schema)


# --- reports -----------------------------------------------------------------------------------


def event_runs(spark, d) -> DataFrame:
    """The events as a run log, one run per event of the job its user stands for."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("success")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("task_id"),
        F.col("ts").alias("start_time"),
        status.alias("status"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("/exports/"), F.col("event_id").cast("string"), F.lit(".csv"))).alias("file_path"),
    )


def customer_jobs(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") == 3, "running").otherwise("idle").alias("status")
    )


def run_report(spark, d):
    return reports.run_report(event_runs(spark, d), customer_jobs(spark, d), "failed").select("id", "task_id", "status", "task_name")


def _logged_copy(spark, d, out, **more):
    base = dict(
        name="orders-copy", source=Endpoint("parquet", path=d), source_table="orders.parquet", target=Endpoint("parquet", path=out), target_table="orders",
        filter=OR_FILTER, write="upsert", keys=["o_orderkey"], buckets=4, quality=False,
    )
    return JobSpec(**{**base, **more})


def verified_job(spark, d):
    """A filtered copy checked on demand against its whole source; the outcome stands on its newest run."""
    out = scratch_path(spark, "verified")
    spec = _logged_copy(spark, d, out)
    done(jobs.run_job(spark, spec, f"{out}/_jobs"))
    jobs.verify_job(spark, spec, f"{out}/_jobs")
    return run_log(spark, f"{out}/_jobs").latest().select("job", "status", "rows_synced", "source_rows", "target_rows", "sample_total", "quality_status")


def run_log_rows(spark, d):
    """What the run log holds after a copy, one that fails, and one that finds the rows there already."""
    out = scratch_path(spark, "log")
    jobs.run_job(spark, _logged_copy(spark, d, out), f"{out}/_jobs")
    jobs.run_job(spark, _logged_copy(spark, d, out, name="no-table", source_table="none.parquet"), f"{out}/_jobs")
    jobs.run_job(spark, _logged_copy(spark, d, out, name="again", quality=True), f"{out}/_jobs")
    rows = run_log(spark, f"{out}/_jobs").latest()
    return rows.select("job", "status", "rows_synced", (F.col("error_msg") != "").alias("has_error"), F.col("end_time").isNotNull().alias("ended"), "triggered_by", "quality_status")


def latest_runs(spark, d):
    return reports.latest_runs(event_runs(spark, d), customer_jobs(spark, d)).select("id", "task_id", "status", "task_name")


def latest_files(spark, d):
    return reports.latest_files(event_runs(spark, d))


def run_summary(spark, d):
    endpoints = table(spark, d, "supplier")
    return reports.run_summary(endpoints, customer_jobs(spark, d), event_runs(spark, d), "2024-01-15")


# --- null-bearing, repeated, shifted and unfit values --------------------------------------------


def _shifted_lines(spark, d):
    """Rows whose nulls stand in another column on the other side: unlike, but with the same values in the same order."""
    lines = table(spark, d, "orders")
    flag = F.col("o_orderkey") % 4
    left, right = F.when(flag != 1, F.col("o_orderstatus")), F.when(flag != 2, F.col("o_orderstatus"))
    source = lines.select("o_orderkey", left.alias("a"), right.alias("b"))
    target = lines.select("o_orderkey", F.when(flag == 1, right).otherwise(F.when(flag == 2, F.lit(None).cast("string")).otherwise(left)).alias("a"),
                          F.when(flag == 1, F.lit(None).cast("string")).when(flag == 2, left).otherwise(right).alias("b"))
    return source, target, ["o_orderkey"], [("a", "a"), ("b", "b")]


def differing_keys_nulls(spark, d):
    return quality.differing_keys(*_shifted_lines(spark, d))


def compare_tables_nulls(spark, d):
    return quality.compare_tables(*_shifted_lines(spark, d))


def full_compare_repeats(spark, d):
    """A target in which every tenth order stands three times."""
    orders = table(spark, d, "orders")
    more = orders.where("o_orderkey % 10 = 0")
    return quality.full_compare(orders, orders.unionByName(more).unionByName(more), ["o_orderkey"], [("o_totalprice", "o_totalprice")])


def decimal_match(spark, d):
    """Decimals and whole numbers too large for a double: equal, a unit apart, and a hundredth of the tolerance apart."""
    key = F.col("o_orderkey").cast("decimal(20,0)")
    big = (key + F.lit("12345678901234567890").cast("decimal(20,0)")).cast("decimal(30,6)")
    apart = F.when(F.col("o_orderkey") % 3 == 1, F.lit("1").cast("decimal(30,6)")).when(F.col("o_orderkey") % 3 == 2, F.lit("0.000001").cast("decimal(30,6)")).otherwise(F.lit("0").cast("decimal(30,6)"))
    rows = table(spark, d, "orders").select("o_orderstatus", big.alias("a"), (big + apart).cast("decimal(30,6)").alias("b"))
    whole = F.lit(1 << 53) + F.col("o_orderkey")
    rows = rows.withColumn("n", F.lit(1))
    ok = values_match(F.col("a"), F.col("b"), T.DecimalType(30, 6), T.DecimalType(30, 6))
    longs = table(spark, d, "orders").select("o_orderstatus", values_match(whole, whole + F.col("o_orderkey") % 2, T.LongType(), T.LongType()).alias("same"))
    left = rows.groupBy("o_orderstatus").agg(F.count_if(ok).alias("decimals"))
    return left.join(longs.groupBy("o_orderstatus").agg(F.count_if("same").alias("longs")), "o_orderstatus")


def chained_upsert(spark, d):
    """Two jobs in a row: the second reads the keyed table that the first upserted into."""
    out = scratch_path(spark, "chain")
    first = Endpoint("parquet", path=out)
    base = dict(keys=["o_orderkey"], quality=False, write="upsert", buckets=5)
    done(jobs.run_job(spark, JobSpec("load", Endpoint("parquet", path=d), first, source_table="orders.parquet", target_table="orders", **base), out))
    onward = JobSpec("onward", first, Endpoint("parquet", path=f"{out}/next"), source_table="orders", target_table="orders", filter="o_orderkey % 2 = 0", **base)
    done(jobs.run_job(spark, onward, out))
    return jobs.read_endpoint(spark, onward.target, "orders")


def incremental_ltz_whole(spark, d):
    """Instants as marks in a session far from UTC: events below half of the largest id first, all others next; each is copied once."""
    out = scratch_path(spark, "ltz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        events = table(spark, d, "events").select("event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("at"))
        spec = dict(name="ltz", source=Endpoint("parquet", path=f"{out}/src"), source_table="events", target=Endpoint("parquet", path=f"{out}/dst"), target_table="events", watermark=Watermark("at", "timestamp"), quality=False)
        half = F.lit(events.agg(F.max("event_id")).first()[0]) / 2
        later = F.coalesce(F.col("event_id") >= half, F.lit(False))
        for part in (~later, later):
            events.where(part).write.mode("append").parquet(f"{out}/src/events")
            done(jobs.run_job(spark, JobSpec(**spec), out))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.parquet(f"{out}/dst/events").select("event_id", F.unix_seconds("at").alias("seconds"))


def inferred_schema(spark, d):
    """The structure of a collection in which a field appears in few documents and another changes its type."""
    out = scratch_path(spark, "inferred")
    e = table(spark, d, "events")
    rare = F.when(F.col("event_id") % 997 == 996, F.col("value"))
    mixed = F.when(F.col("event_id") % 500 == 499, F.lit("text")).otherwise(F.col("user_id").cast("string"))
    e.select(F.col("event_id").alias("_id"), F.struct(rare.alias("rare"), (F.col("event_id") % 2 == 0).alias("even")).alias("sub"), mixed.alias("mixed")).write.json(out)
    return documents.document_schema(spark, out, "events").select("ordinal", "name", "raw_type", "nullable", "is_primary")


def schema_columns(spark, d):
    """The catalog rows of the given tables."""
    return schema.describe({n: table(spark, d, n) for n in ("nation", "orders", "lineitem")}, "spark", {"nation": ["n_nationkey"], "orders": ["o_orderkey"]}).select("table", "ordinal", "name", "raw_type", "is_primary")


def param_quoted(spark, d):
    """Parameters inside quoted texts, with values that would end the text if they were placed in it."""
    for t in ("orders", "customer"):
        table(spark, d, t).createOrReplaceTempView(t)
    sql = r"SELECT c_mktsegment, concat('<{{sly}}|{{state}}>') AS said, 'it\'s' AS plain, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = '{{state}}' OR c_name = 'x{{sly}}' GROUP BY 1"
    return parameterised_query(spark, sql, (), {"sly": "\\' OR true --", "state": "F"})


def feed_unfit(spark, d):
    """Events whose key or value does not convert to the table's types are told apart, not lost."""
    e = table(spark, d, "events")
    key = F.when(F.col("event_id") % 71 == 0, "abc").otherwise(F.col("user_id").cast("string"))
    value = F.when(F.col("event_id") % 53 == 0, "1,5").otherwise(F.col("value").cast("string"))
    op = F.when(F.col("event_type") == "error", "D").otherwise("U")
    feed = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.struct(key.alias("user_id"), value.alias("value")).alias("after"))
    _, bad = X.split_feed(feed, ["user_id"], T.StructType.fromDDL("user_id long, value double"))
    return bad.select("seq", "op", "reason")


QUERIES = [
    differing_keys_nulls, compare_tables_nulls, full_compare_repeats, decimal_match, chained_upsert, incremental_ltz_whole,
    inferred_schema, schema_columns, param_quoted, feed_unfit,
    table_scan, filtered_count, filtered_copy, mapped_copy, or_filter_with_watermark, incremental_id, incremental_ts,
    incremental_two_runs, next_watermark, point_lookup, key_bounds, shard_counts, shard_union, balanced_shards, balanced_union, resumed_copy, resumed_job, resumed_upsert, late_rows,
    insert_skip, upsert, upsert_last_wins, upsert_job, append_job, replace_docs, duplicate_keys, csv_round_trip,
    type_map, catalog_primary_keys, auto_map, create_table_ddl, schema_diff, alter_ddl, structure_job,
    quality_counts, quality_sample, quality_random_sample, quality_status, full_compare, compare_tables, differing_keys, descend_keys, tolerant_match,
    param_query, export_query, sql_import, preview_page, page_offset, page_deep, page_text_rest, page_ties,
    apply_changes_strict, apply_changes_upsert, apply_changes_hot, apply_changes_one_key, apply_key_moves, apply_unchanged_values, apply_keyless,
    mapped_feed, feed_rejects, stream_replicate, stream_keyless, apply_schema_messages, schema_message_rejects, stream_schema_messages,
    flatten_documents, document_filter, document_round_trip,
    run_report, latest_runs, latest_files, run_summary, verified_job, run_log_rows,
]


def queries():
    return {q.__name__: q for q in QUERIES}

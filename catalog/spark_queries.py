"""The registered queries, one per operator or setting, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import pairs as P
from catalog.pairs import derived, table
from twinframe import (
    CaseInsensitive,
    CaseInsensitiveWhitespace,
    Comparison,
    Precision,
    Seconds,
    Whitespace,
    compare,
    compare_schemas,
    suggest_keys,
    table_meta,
)
from twinframe.functions.compare import displayed
from twinframe.functions.text import redacted
from twinframe.operators.audit import show_log
from twinframe.operators.drill import page_of
from twinframe.operators.history import (
    StoredHistory,
    cleared,
    insert_new,
    insert_new_into,
    newest,
    newest_per_group,
    read_history,
    retained,
    upserted,
    without_entry,
)
from twinframe.operators.versions import VersionedTable
from twinframe.session import fresh_path
from twinframe.sources.export import export
from twinframe.sources.files import read_source
from twinframe.sources.typed import typed_load

Query = Callable[[SparkSession, str], DataFrame]

ORDER_TOLERANCES = {
    "o_orderstatus": CaseInsensitive(),
    "o_totalprice": Precision(2),
    "o_orderdate": Seconds(5),
    "o_orderpriority": Whitespace(),
}


def orders(spark: SparkSession, sf: str, **settings) -> Comparison:
    if "pk_expression" not in settings:
        settings = {"pk_columns": ["o_orderkey"]} | settings
    return compare(table(spark, sf, "orders"), derived(spark, sf, P.ORDERS_B), **settings)


def tolerant_orders(spark: SparkSession, sf: str, **settings) -> Comparison:
    return orders(spark, sf, column_tolerances=ORDER_TOLERANCES, **settings)


def lineitem(spark: SparkSession, sf: str, **settings) -> Comparison:
    keys = ["l_orderkey", "l_linenumber"]
    return compare(table(spark, sf, "lineitem"), derived(spark, sf, P.LINEITEM_B), pk_columns=keys, **settings)


def null_keys(spark: SparkSession, sf: str, **settings) -> Comparison:
    a, b = derived(spark, sf, P.NULL_KEYS_A), derived(spark, sf, P.NULL_KEYS_B)
    return compare(a, b, pk_columns=["o_orderkey"], **settings)


def customers(spark: SparkSession, sf: str) -> Comparison:
    return compare(table(spark, sf, "customer"), derived(spark, sf, P.CUSTOMER_B), pk_columns=["c_custkey"])


def events(spark: SparkSession, sf: str, key: str, **settings) -> Comparison:
    return compare(table(spark, sf, "events"), derived(spark, sf, P.EVENTS_B), pk_columns=[key], **settings)


def documents(spark: SparkSession, sf: str, **settings) -> Comparison:
    return compare(table(spark, sf, "documents"), derived(spark, sf, P.DOCUMENTS_B), pk_columns=["doc_id"], **settings)


def composite_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    a, b = derived(spark, sf, P.PARTLY_NULL_KEYS_A), derived(spark, sf, P.PARTLY_NULL_KEYS_B)
    return compare(a, b, pk_columns=["o_orderkey", "o_custkey"]).overview()


def conversation_text_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "conversations"), derived(spark, sf, P.CONVERSATIONS_B)
    tolerances = {"role": CaseInsensitive(), "text": Whitespace()}
    return compare(a, b, pk_columns=["conv_id", "turn"], column_tolerances=tolerances).column_stats()


def page_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "pages"), derived(spark, sf, P.PAGES_B)
    return compare(a, b, pk_columns=["page_id"], column_tolerances={"html": CaseInsensitive()}).column_stats()


def array_column_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 20 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    return compare(a, a.withColumn("embedding", moved), pk_columns=["vec_id"]).column_stats()


def retyped(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    a, b = table(spark, sf, "orders"), derived(spark, sf, P.RETYPED_ORDERS)
    return compare(a, b, pk_columns=["o_orderkey"], on_type_mismatch=mode).column_stats()


def materialized_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tolerant_orders(spark, sf).materialize().rows("diffs")


def char_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_parts(customers(spark, sf).char_changes())


def document_char_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_parts(documents(spark, sf).char_changes())


def _joined_parts(changes: DataFrame) -> DataFrame:
    """The parts put together again, and how many characters both sides keep."""
    key = next(name for name in changes.columns if name.startswith("pk_"))
    kept = F.filter("parts_a", lambda part: part["kind"] == "kept")
    return changes.select(
        key,
        "column",
        F.concat_ws("", "parts_a.text").alias("text_a"),
        F.concat_ws("", "parts_b.text").alias("text_b"),
        F.length(F.concat_ws("", F.transform(kept, lambda part: part["text"]))).alias("kept_chars"),
    )


def cell_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return (
        customers(spark, sf).cell_changes().select("pk_c_custkey", "column", F.levenshtein("a", "b").alias("distance"))
    )


def schema_comparison(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "documents"), table(spark, sf, "labels")
    merged = compare_schemas(a, b)
    for side, df in (("a", a), ("b", b)):
        counted = table_meta(df).select("name", F.col("row_count").alias(f"rows_{side}"))
        merged = merged.join(counted, "name", "left")
    return merged.select(
        "ordinal", "name", "presence", "type_a", "type_b", "types_match", "rows_a", "rows_b"
    )


def roundtrip(fmt: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{fresh_path(spark, 'export')}.{fmt}"
        export(table(spark, sf, "orders"), path, fmt)
        a, b = read_source(spark, path), derived(spark, sf, P.ORDERS_B)
        key = ["o_orderkey"]
        return compare(a, b, pk_columns=key, column_tolerances=ORDER_TOLERANCES).column_stats().orderBy("name").drop("ordinal")

    return run


def export_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Exported differing rows, read back."""
    path = f"{fresh_path(spark, 'export')}.csv"
    tolerant_orders(spark, sf).export(path)
    return read_source(spark, path)


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "events")
    cells = source.select(F.array(*[F.col(name).cast("string") for name in source.columns]).alias("cells"))
    declared = {
        "event_id": "INTEGER",
        "ts": "TIMESTAMP_NTZ",
        "user_id": "FIXED",
        "event_type": "TEXT",
        "value": "FLOAT",
        "props": "VARIANT",
        "missing": "BOOLEAN",
    }
    return typed_load(cells, declared, cells="cells")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events seen as a log of queries (event types) on connections (users)."""
    source = table(spark, sf, "events")
    return source.select(
        F.col("user_id").cast("string").alias("connection_id"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit("\n")).alias("query"),
        F.col("ts").alias("used_at"),
    )


def history_latest(spark: SparkSession, sf: str) -> DataFrame:
    return upserted(event_log(spark, sf)).drop("id")


def history_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Newest entries per user and in all; latest uses never tie at microseconds."""
    return retained(upserted(event_log(spark, sf)), per_connection=3).drop("id")


def history_top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return newest_per_group(table(spark, sf, "events"), "user_id", [F.col("ts").desc(), F.col("event_id")])


def history_top_global(spark: SparkSession, sf: str) -> DataFrame:
    return newest(table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id")])


def redact_sql(spark: SparkSession, sf: str) -> DataFrame:
    statement = F.concat(
        F.lit("CREATE SECRET (KEY_ID '"),
        F.col("user_id"),
        F.lit("', SECRET '"),
        F.col("props"),
        F.lit("', SESSION_TOKEN '"),
        F.col("event_type"),
        F.lit("', EXTRA_HTTP_HEADERS MAP {'Authorization': 'Bearer "),
        F.col("value"),
        F.lit("'}) -- KEY '"),
        F.col("event_type"),
        F.lit("'"),
    )
    return table(spark, sf, "events").select("event_id", redacted(statement).alias("sql"))


def inserted(part: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return insert_new(table(spark, sf, "customer"), derived(spark, sf, P.CUSTOMER_B), "c_name")[part]

    return run


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of differing rows that follows the first 100."""
    return _page_after_first(tolerant_orders(spark, sf), 100)


def keyset_page_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same where keys, and pairs of rows, repeat."""
    return _page_after_first(lineitem(spark, sf, on_duplicates="pairs"), 60)


def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page 7 of all matched rows, from stored pages of files of 500 rows."""
    return tolerant_orders(spark, sf).paged("all", rows_per_file=500).page(7, 100).rows


def page_at_key(spark: SparkSession, sf: str) -> DataFrame:
    """The page of differing rows on which key 1000 stands or would stand."""
    return tolerant_orders(spark, sf).paged("diffs", rows_per_file=64).page_at({"pk_o_orderkey_a": 1000}, 20).rows


def deep_page_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Page 9 of all pairs of rows of repeated composite keys, ordered by both key columns and all others."""
    return lineitem(spark, sf, on_duplicates="pairs").paged("all", rows_per_file=1000).page(9, 250).rows


def _page_after_first(comparison: Comparison, n: int) -> DataFrame:
    """The page after the first ``n`` differing rows, found from the last of them."""
    first = comparison.page("diffs", page_size=n).rows.collect()
    seen = next((i for i in range(1, len(first)) if first[-i - 1] != first[-1]), len(first))
    return comparison.page_after(first[-1].asDict(), seen=seen)


def seconds_zoned(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as moments: a distance in seconds, whatever the session zone."""
    a, b = table(spark, sf, "orders"), derived(spark, sf, P.ORDERS_B)
    moments = [side.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")) for side in (a, b)]
    compared = compare(*moments, pk_columns=["o_orderkey"], column_tolerances={"o_orderdate": Seconds(5)})
    return compared.column_stats()


def far_times(spark: SparkSession, sf: str) -> Comparison:
    """Two distances of hours on a key of few values, all other columns along but not compared."""
    a, b = derived(spark, sf, P.EVENTS_FAR_TIMES_A), derived(spark, sf, P.EVENTS_FAR_TIMES_B)
    reaches = {"ts": Seconds(7200), "done": Seconds(10800)}
    return compare(a, b, pk_columns=["event_type"], column_tolerances=reaches, ignored_columns=["event_id", "user_id", "value", "props"])


def two_distances(spark: SparkSession, sf: str) -> DataFrame:
    a, b = derived(spark, sf, P.EVENTS_TWO_TIMES_A), derived(spark, sf, P.EVENTS_TWO_TIMES_B)
    tolerances = {"ts": Seconds(30), "done": Seconds(60)}
    return compare(a, b, pk_columns=["event_type"], column_tolerances=tolerances, ignored_columns=["event_id"]).overview()


def map_column_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The properties of events as maps within an array; entry order does not count."""
    events = table(spark, sf, "events")
    changed = F.when(F.col("event_id") % 20 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props"))
    listed = F.create_map(F.lit("p"), "props", F.lit("t"), "event_type")
    turned = F.create_map(F.lit("t"), "event_type", F.lit("p"), changed)
    a = events.select("event_id", F.array(listed).alias("maps"))
    b = events.select("event_id", F.array(turned).alias("maps"))
    return compare(a, b, pk_columns=["event_id"]).column_stats()


def json_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as arrays over several lines, beside a file of one object per line, read back and compared."""
    customers = table(spark, sf, "customer")
    path = f"{fresh_path(spark, 'arrays')}.json"
    row = F.to_json(F.struct(*customers.columns), {"ignoreNullFields": "false"})
    nation = F.col("c_nationkey")
    thousand = F.floor(F.col("c_custkey") / 1000).alias("thousand")
    listed = customers.where(nation >= 5).groupBy(thousand).agg(F.array_join(F.collect_list(row), ",\n").alias("rows"))
    arrays = listed.select(F.concat(F.lit("[\n"), "rows", F.lit("\n]")).alias("value"))
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    customers.where(nation < 5).select(row.alias("value")).write.mode("append").text(path)
    return compare(read_source(spark, path), derived(spark, sf, P.CUSTOMER_B), pk_columns=["c_custkey"]).column_stats().drop("ordinal")


def csv_zoned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV with offsets in their dates, read back as moments and compared as such."""
    path = f"{fresh_path(spark, 'zoned')}.csv"
    zoned = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    export(table(spark, sf, "orders").withColumn("o_orderdate", zoned), path, "csv")
    a, b = read_source(spark, path), derived(spark, sf, P.ORDERS_B).withColumn("o_orderdate", zoned.cast("timestamp"))
    compared = compare(a, b, pk_columns=["o_orderkey"], column_tolerances=ORDER_TOLERANCES)
    return compared.column_stats().orderBy("name").drop("ordinal")


def history_read(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of the user of the first event."""
    user = table(spark, sf, "events").orderBy("event_id").first().user_id
    return read_history(upserted(event_log(spark, sf)), str(user)).drop("id")


def history_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Without the newest entry of all, deleted by its id."""
    kept = upserted(event_log(spark, sf))
    newest_id = kept.orderBy(F.col("last_used_at").desc(), F.col("connection_id"), F.col("query")).first().id
    return without_entry(kept, newest_id).drop("id")


def history_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Without the entries of the user of the first event."""
    user = table(spark, sf, "events").orderBy("event_id").first().user_id
    return cleared(upserted(event_log(spark, sf)), str(user)).drop("id")


def history_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored history without limits: two logs entered one after the other, one connection cleared, the newest entry deleted."""
    early = F.col("used_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    history = StoredHistory(spark, fresh_path(spark, "history"), per_connection=None, in_total=None)
    for part in (early, ~early):
        history.add(event_log(spark, sf).where(part))
    history.clear(str(table(spark, sf, "events").orderBy("event_id").first().user_id))
    history.delete(history.table.read().orderBy(F.col("last_used_at").desc(), "connection_id", "query").first().id)
    return history.table.read().drop("id")


def insert_new_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The stored customers after those of new names were inserted."""
    stored_customers = VersionedTable(spark, fresh_path(spark, "customers"))
    stored_customers.replace(table(spark, sf, "customer"))
    insert_new_into(stored_customers, derived(spark, sf, P.CUSTOMER_B), "c_name")
    return stored_customers.read()


def activity_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events seen as log rows whose statements and errors hold secrets."""
    events = table(spark, sf, "events")
    log = events.select(
        F.col("event_id").alias("timestamp"),
        F.col("event_type").alias("operation"),
        F.concat(F.lit("SET SECRET '"), "props", F.lit("' WHERE v = "), F.col("user_id")).alias("sql"),
        F.lit(0).cast("bigint").alias("duration_ms"),
        F.col("event_id").alias("rows_affected"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("failed with KEY '"), "props", F.lit("'"))).alias("error"),
    )
    return show_log(log)


def display_precision(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", displayed(F.col("o_totalprice"), 1).alias("shown"))


def json_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page as JSON text, with all columns."""
    return page_of(orders(spark, sf).only_in("a"), ["o_orderkey"]).json()


QUERIES: dict[str, Query] = {
    "overview_exact": lambda s, d: orders(s, d).overview(),
    "column_stats_exact": lambda s, d: orders(s, d).column_stats(),
    "overview_tolerant": lambda s, d: tolerant_orders(s, d).overview(),
    "column_stats_tolerant": lambda s, d: tolerant_orders(s, d).column_stats(),
    "ranked_columns": lambda s, d: tolerant_orders(s, d).ranked_columns(),
    "column_stats_grouped": lambda s, d: tolerant_orders(s, d, pair_budget=0.0).column_stats(),
    "default_precision": lambda s, d: orders(s, d, tolerance=0).column_stats(),
    "precision_negative": lambda s, d: orders(s, d, column_tolerances={"o_totalprice": Precision(-1)}).column_stats(),
    "precision_override": lambda s, d: orders(
        s, d, tolerance=0, column_tolerances={"o_totalprice": Precision(2)}
    ).column_stats(),
    "case_whitespace": lambda s, d: orders(
        s,
        d,
        column_tolerances={
            "o_orderstatus": CaseInsensitiveWhitespace(),
            "o_orderpriority": CaseInsensitiveWhitespace(),
        },
    ).column_stats(),
    "tolerance_fallthrough": lambda s, d: orders(
        s,
        d,
        column_tolerances={"o_orderstatus": Precision(3), "o_totalprice": Seconds(5), "o_custkey": Whitespace()},
    ).column_stats(),
    "seconds_fraction": lambda s, d: events(s, d, "event_id", column_tolerances={"ts": Seconds(1.5)}).column_stats(),
    "seconds_zoned": seconds_zoned,
    "diff_join_flat": lambda s, d: tolerant_orders(s, d, ignored_columns=["o_custkey"]).diff_join(),
    "composite_key_overview": lambda s, d: lineitem(s, d).overview(),
    "composite_key_column_stats": lambda s, d: lineitem(s, d).column_stats(),
    "duplicate_pairs_grouped": lambda s, d: lineitem(s, d, pair_budget=0.0).column_stats(),
    "duplicate_pairs_hot_keys": lambda s, d: lineitem(s, d, hot_key_rows=5).column_stats(),
    "duplicate_pairs_flat": lambda s, d: lineitem(s, d, on_duplicates="pairs").diff_join(),
    "duplicate_pairs_flat_hot_keys": lambda s, d: lineitem(s, d, hot_key_rows=5, on_duplicates="pairs").diff_join(),
    "low_cardinality_key_overview": lambda s, d: events(
        s, d, "event_type", column_tolerances={"ts": Seconds(60), "value": Precision(0)}
    ).overview(),
    "low_cardinality_key_stats": lambda s, d: events(
        s, d, "event_type", column_tolerances={"ts": Seconds(60), "value": Precision(0)}
    ).column_stats(),
    "low_cardinality_two_distances": two_distances,
    "wide_distances_overview": lambda s, d: far_times(s, d).overview(),
    "wide_distances_stats": lambda s, d: far_times(s, d).column_stats(),
    "expression_key_overview": lambda s, d: orders(s, d, pk_expression="CAST(o_orderkey AS STRING)").overview(),
    "where_filter_overview": lambda s, d: tolerant_orders(s, d, where_clause="o_orderstatus = 'O'").overview(),
    "where_filter_unfiltered_keys": lambda s, d: lineitem(
        s, d, where_clause="l_returnflag = 'R'", where_scope="join"
    ).overview(),
    "ignored_columns_stats": lambda s, d: orders(
        s, d, ignored_columns=["o_orderdate", "o_orderpriority"]
    ).column_stats(),
    "null_key_summary": lambda s, d: null_keys(s, d).overview(),
    "null_key_reference_mode": lambda s, d: null_keys(s, d, null_keys="both_sides").overview(),
    "null_key_flat": lambda s, d: null_keys(s, d).diff_join(),
    "composite_null_keys": composite_null_keys,
    "type_mismatch_coerce": lambda s, d: retyped(s, d, "coerce"),
    "type_mismatch_skip": lambda s, d: retyped(s, d, "skip"),
    "only_in_a": lambda s, d: orders(s, d).only_in("a"),
    "only_in_b": lambda s, d: orders(s, d).only_in("b"),
    "only_in_a_null_keys": lambda s, d: null_keys(s, d).only_in("a"),
    "only_in_a_hot_keys": lambda s, d: orders(s, d, hot_key_rows=1).only_in("a"),
    "in_both_a": lambda s, d: orders(s, d).in_both("a"),
    "only_in_page": lambda s, d: orders(s, d).only_in_page("a", page=1, page_size=20).rows,
    "duplicate_keys": lambda s, d: lineitem(s, d).duplicate_keys("a"),
    "duplicate_keys_page": lambda s, d: lineitem(s, d).duplicate_keys_page("a", page=1, page_size=100).rows,
    "duplicate_key_count": lambda s, d: lineitem(s, d)
    .overview()
    .select("duplicate_pks_a", "duplicate_pks_b", "null_pks_a", "null_pks_b"),
    "rows_all": lambda s, d: tolerant_orders(s, d).rows("all"),
    "rows_diffs": lambda s, d: tolerant_orders(s, d).rows("diffs"),
    "indexed_overview": lambda s, d: tolerant_orders(s, d).indexed().overview(),
    "indexed_column_stats": lambda s, d: tolerant_orders(s, d).indexed().column_stats(),
    "indexed_rows_diffs": lambda s, d: tolerant_orders(s, d).indexed().rows("diffs"),
    "indexed_cell_changes": lambda s, d: tolerant_orders(s, d).indexed().cell_changes(),
    "indexed_only_in_a": lambda s, d: orders(s, d).indexed().only_in("a"),
    "indexed_only_in_a_null_keys": lambda s, d: null_keys(s, d).indexed().only_in("a"),
    "indexed_duplicate_keys": lambda s, d: lineitem(s, d).indexed().duplicate_keys("a"),
    "suggest_keys_of_many": lambda s, d: suggest_keys(table(s, d, "lineitem"), table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"), F.col("o_orderstatus").alias("l_linestatus")), ["l_orderkey", "l_partkey", "l_linestatus"]),
    "rows_minor": lambda s, d: tolerant_orders(s, d).rows("minor"),
    "rows_same": lambda s, d: tolerant_orders(s, d).rows("same"),
    "rows_diffs_one_column": lambda s, d: tolerant_orders(s, d).rows("diffs", "o_orderdate"),
    "rows_minor_one_column": lambda s, d: tolerant_orders(s, d).rows("minor", "o_totalprice"),
    "rows_materialized": materialized_rows,
    "diff_rows_page": lambda s, d: tolerant_orders(s, d).page("diffs", page=2, page_size=50).rows,
    "diff_rows_keyset_page": keyset_page,
    "keyset_page_repeated_keys": keyset_page_repeated_keys,
    "deep_page": deep_page,
    "page_at_key": page_at_key,
    "deep_page_repeated_keys": deep_page_repeated_keys,
    "json_page": json_page,
    "cell_changes": lambda s, d: tolerant_orders(s, d).cell_changes(),
    "cell_changes_display": lambda s, d: orders(s, d, tolerance=1).cell_changes(display_precision=1),
    "char_diff": char_diff,
    "document_char_diff": document_char_diff,
    "document_text_stats": lambda s, d: documents(
        s, d, column_tolerances={"text": CaseInsensitiveWhitespace()}
    ).column_stats(),
    "conversation_text_tolerance": conversation_text_tolerance,
    "page_text_stats": page_text_stats,
    "cell_edit_distance": cell_edit_distance,
    "schema_comparison": schema_comparison,
    "suggest_keys": lambda s, d: suggest_keys(table(s, d, "documents"), table(s, d, "labels")),
    "table_meta": lambda s, d: table_meta(table(s, d, "lineitem")),
    "array_column_diff": array_column_diff,
    "map_column_diff": map_column_diff,
    "display_precision": display_precision,
    "csv_roundtrip_diff": roundtrip("csv"),
    "json_roundtrip_diff": roundtrip("json"),
    "parquet_export_diff": roundtrip("parquet"),
    "json_array_roundtrip": json_array_roundtrip,
    "csv_zoned_roundtrip": csv_zoned_roundtrip,
    "export_diff_rows": export_diff_rows,
    "typed_load": typed_events,
    "history_latest": history_latest,
    "history_retained": history_retained,
    "history_read": history_read,
    "history_deleted": history_deleted,
    "history_cleared": history_cleared,
    "history_stored": history_stored,
    "activity_log": activity_log,
    "history_top_per_group": history_top_per_group,
    "history_top_global": history_top_global,
    "redact_sql": redact_sql,
    "insert_new_by_name": inserted(0),
    "insert_new_skipped": inserted(1),
    "insert_new_stored": insert_new_stored,
}

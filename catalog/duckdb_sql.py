"""The same results as the registered queries, as SQL for DuckDB on the same tables."""

from __future__ import annotations

from catalog import pairs as P
from catalog.pairs import duckdb_text

ORDERS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINEITEM = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate",
]


def exact(c: str) -> str:
    return f"(a.{c} IS DISTINCT FROM b.{c})"


def precision(c: str, n: int) -> str:
    return (
        f"(CASE WHEN a.{c} IS NULL AND b.{c} IS NULL THEN false WHEN a.{c} IS NULL OR b.{c} IS NULL THEN true "
        f"ELSE trunc(a.{c}::DOUBLE, {n}) <> trunc(b.{c}::DOUBLE, {n}) END)"
    )


def seconds(c: str, micros: int) -> str:
    return (
        f"(CASE WHEN a.{c} IS NULL AND b.{c} IS NULL THEN false WHEN a.{c} IS NULL OR b.{c} IS NULL THEN true "
        f"ELSE abs(epoch_us(a.{c}) - epoch_us(b.{c})) > {micros} END)"
    )


def lower(c: str) -> str:
    return f"(lower(a.{c}) IS DISTINCT FROM lower(b.{c}))"


def trim(c: str) -> str:
    return f"(trim(a.{c}) IS DISTINCT FROM trim(b.{c}))"


def lower_trim(c: str) -> str:
    return f"(lower(trim(a.{c})) IS DISTINCT FROM lower(trim(b.{c})))"


TOLERANT = {
    "o_orderstatus": lower("o_orderstatus"),
    "o_totalprice": precision("o_totalprice", 2),
    "o_orderdate": seconds("o_orderdate", 5_000_000),
    "o_orderpriority": trim("o_orderpriority"),
}


class Join:
    """The full outer join of two sides with flags, as common table expressions ``a``, ``b`` and ``j``."""

    def __init__(self, a, b, keys, columns, differs=None, where=None, key_expression=None, ignored=()):
        self.columns, self.keys, self.ignored = columns, keys, list(ignored)
        differs = differs or {}
        cut = f" WHERE {where}" if where else ""
        made = f", ({key_expression}) AS expr" if key_expression else ""
        select = []
        for k in keys:
            select += [f"a.{k} AS pk_{k}_a", f"b.{k} AS pk_{k}_b"]
        for c in columns:
            select += [f"a.{c} AS {c}_a", f"b.{c} AS {c}_b"]
            select += [f"{differs.get(c, exact(c))}::INTEGER AS is_diff_{c}", f"{exact(c)}::INTEGER AS is_raw_diff_{c}"]
        for c in ignored:
            select += [f"a.{c} AS {c}_a", f"b.{c} AS {c}_b"]
        on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
        self.ctes = (
            f"WITH source_a AS ({a}), source_b AS ({b}), "
            f"a AS (SELECT *, true AS present{made} FROM source_a{cut}), "
            f"b AS (SELECT *, true AS present{made} FROM source_b{cut}), "
            f"j AS (SELECT {', '.join(select)}, a.present AS in_a, b.present AS in_b "
            f"FROM a FULL OUTER JOIN b ON {on}) "
        )
        self.any_diff = " OR ".join(f"is_diff_{c} = 1" for c in columns)
        self.any_raw = " OR ".join(f"is_raw_diff_{c} = 1" for c in columns)

    def names(self, flags=True):
        found = [f"pk_{k}_{s}" for k in self.keys for s in "ab"]
        found += [f"{c}_{s}" for c in [*self.columns, *self.ignored] for s in "ab"]
        if flags:
            found += [f"is_diff_{c}" for c in self.columns] + [f"is_raw_diff_{c}" for c in self.columns]
        return ", ".join(found)

    def flat(self):
        return f"{self.ctes} SELECT {self.names()} FROM j"

    def rows(self, condition, flags=True):
        return f"{self.ctes} SELECT {self.names(flags)} FROM j WHERE in_a AND in_b AND ({condition})"

    def diffs(self, flags=True):
        return self.rows(self.any_diff, flags)

    def minor(self):
        return self.rows(f"NOT ({self.any_diff}) AND ({self.any_raw})")

    def same(self):
        return self.rows(f"NOT ({self.any_raw})")

    def column_stats(self, ordinal=True):
        parts = []
        for i, c in enumerate(self.columns):
            diff, minor = f"sum(is_diff_{c})", f"sum(CASE WHEN is_raw_diff_{c} = 1 AND is_diff_{c} = 0 THEN 1 ELSE 0 END)"
            parts.append(
                f"SELECT {f'{i}::INTEGER AS ordinal, ' if ordinal else ''}'{c}' AS name, "
                f"coalesce({diff}, 0)::BIGINT AS diff_count, coalesce({minor}, 0)::BIGINT AS minor_count, "
                f"(count(*) - coalesce({diff}, 0))::BIGINT AS match_count, count(*) AS total, "
                f"CASE WHEN count(*) > 0 THEN (count(*) - {diff})::DOUBLE / count(*)::DOUBLE * 100.0 ELSE 100.0 END AS match_pct, "
                f"CASE WHEN count(*) > 0 THEN ({diff})::DOUBLE / count(*)::DOUBLE * 100.0 ELSE 0.0 END AS diff_pct "
                f"FROM j WHERE in_a AND in_b"
            )
        return self.ctes + " UNION ALL ".join(parts)

    def overview(self, key_counts_of=("a", "b"), both_sides=False):
        def duplicates(source):
            keys = ", ".join(self.keys)
            return f"(SELECT count(*) FROM (SELECT {keys} FROM {source} GROUP BY {keys} HAVING count(*) > 1))"

        def nulls(source):
            return f"(SELECT count(*) FROM {source} WHERE {' OR '.join(f'{k} IS NULL' for k in self.keys)})"

        a, b = key_counts_of
        alone_a, alone_b = "in_b IS NULL", "in_a IS NULL"
        if both_sides:
            alone_a = " AND ".join(f"pk_{k}_b IS NULL" for k in self.keys)
            alone_b = " AND ".join(f"pk_{k}_a IS NULL" for k in self.keys)
        exclusive_a = f"(SELECT count(*) FROM j WHERE {alone_a})"
        exclusive_b = f"(SELECT count(*) FROM j WHERE {alone_b})"
        compared = f"((SELECT count(*) FROM j) - {exclusive_a} - {exclusive_b})"
        diffs = f"(SELECT count(*) FROM j WHERE in_a AND in_b AND ({self.any_diff}))"
        minor = f"(SELECT count(*) FROM j WHERE in_a AND in_b AND NOT ({self.any_diff}) AND ({self.any_raw}))"
        return (
            f"{self.ctes} SELECT (SELECT count(*) FROM a) AS total_rows_a, (SELECT count(*) FROM b) AS total_rows_b, "
            f"{exclusive_a} AS exclusive_a, {exclusive_b} AS exclusive_b, "
            f"{duplicates(a)} AS duplicate_pks_a, {duplicates(b)} AS duplicate_pks_b, "
            f"{nulls(a)} AS null_pks_a, {nulls(b)} AS null_pks_b, {compared} AS total_compared, "
            f"{diffs} AS rows_with_diffs, {minor} AS rows_minor, {compared} - {diffs} - {minor} AS rows_identical"
        )

    def cell_changes(self):
        keys = ", ".join(f"pk_{k}_a AS pk_{k}" for k in self.keys)
        parts = [
            f"SELECT {keys}, '{c}' AS \"column\", {c}_a::VARCHAR AS a, {c}_b::VARCHAR AS b, "
            f"CASE WHEN is_diff_{c} = 1 THEN 'diff' ELSE 'minor' END AS class FROM j "
            f"WHERE in_a AND in_b AND is_raw_diff_{c} = 1"
            for c in self.columns
        ]
        return self.ctes + " UNION ALL ".join(parts)


def orders(differs=None, columns=None, **settings) -> Join:
    settings = {"keys": ["o_orderkey"]} | settings
    return Join("SELECT * FROM orders", duckdb_text(P.ORDERS_B), columns=columns or ORDERS, differs=differs, **settings)


def tolerant(**settings) -> Join:
    return orders(TOLERANT, **settings)


def lineitem(**settings) -> Join:
    keys = ["l_orderkey", "l_linenumber"]
    return Join("SELECT * FROM lineitem", duckdb_text(P.LINEITEM_B), keys, LINEITEM, **settings)


def null_keys() -> Join:
    return Join(duckdb_text(P.NULL_KEYS_A), duckdb_text(P.NULL_KEYS_B), ["o_orderkey"], ORDERS)


def customers() -> Join:
    columns = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return Join("SELECT * FROM customer", duckdb_text(P.CUSTOMER_B), ["c_custkey"], columns)


def events(key: str, columns: list[str], differs) -> Join:
    return Join("SELECT * FROM events", duckdb_text(P.EVENTS_B), [key], columns, differs)


def documents(differs=None) -> Join:
    columns = ["text", "lang", "source", "n_chars"]
    return Join("SELECT * FROM documents", duckdb_text(P.DOCUMENTS_B), ["doc_id"], columns, differs)


def far_times() -> Join:
    return Join(
        duckdb_text(P.EVENTS_FAR_TIMES_A),
        duckdb_text(P.EVENTS_FAR_TIMES_B),
        ["event_type"],
        ["ts", "done"],
        {"ts": seconds("ts", 7_200_000_000), "done": seconds("done", 10_800_000_000)},
    )


def low_cardinality() -> Join:
    return events(
        "event_type",
        ["event_id", "ts", "user_id", "value", "props"],
        {"ts": seconds("ts", 60_000_000), "event_id": exact("event_id"), "value": precision("value", 0)},
    )


def page_after(join: Join, n: int) -> str:
    """The 50 differing rows after the first ``n``, by keys of A and then all columns."""
    return f"{join.diffs()} {total_order(join)} LIMIT 50 OFFSET {n}"


def total_order(join: Join) -> str:
    names = join.names().split(", ")
    first = [f"pk_{k}_a" for k in join.keys]
    return "ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in [*first, *[c for c in names if c not in first]])


def only_in(side: str, join: Join, tail: str = "") -> str:
    other = {"a": "b", "b": "a"}[side]
    on = " AND ".join(f"{side}.{k} = {other}.{k}" for k in join.keys)
    return (
        f"{join.ctes} SELECT * EXCLUDE (present) FROM {side} "
        f"WHERE NOT EXISTS (SELECT 1 FROM {other} WHERE {on}){tail}"
    )


def retyped(skip: bool) -> str:
    same = ["o_orderstatus", "o_orderpriority"]
    columns = same if skip else ORDERS
    return Join("SELECT * FROM orders", duckdb_text(P.RETYPED_ORDERS), ["o_orderkey"], columns).column_stats()


# DuckDB type names and the Spark names of the same types.
SPARK_NAMES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
}
TYPE_NAME = "CASE data_type " + " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in SPARK_NAMES.items()) + " END"


def columns_of(name: str) -> str:
    return (
        f"SELECT column_name AS name, {TYPE_NAME} AS data_type, "
        f"(row_number() OVER (ORDER BY ordinal_position) - 1)::INTEGER AS ordinal, (SELECT count(*) FROM {name}) AS row_count "
        f"FROM information_schema.columns WHERE table_name = '{name}'"
    )


SCHEMA_COMPARISON = f"""
WITH a AS ({columns_of('documents')}), b AS ({columns_of('labels')}),
m AS (SELECT coalesce(a.name, b.name) AS name,
        CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'shared' END AS presence,
        a.data_type AS type_a, b.data_type AS type_b, a.data_type = b.data_type AS types_match,
        a.row_count AS rows_a, b.row_count AS rows_b, a.ordinal AS at_a, b.ordinal AS at_b
      FROM a FULL OUTER JOIN b ON a.name = b.name)
SELECT (row_number() OVER (ORDER BY CASE presence WHEN 'shared' THEN 0 WHEN 'only_a' THEN 1 ELSE 2 END,
        coalesce(at_a, at_b)) - 1)::INTEGER AS ordinal, name, presence, type_a, type_b, types_match, rows_a, rows_b FROM m
"""

SUGGEST_KEYS = """
SELECT 0::INTEGER AS ordinal, 'doc_id' AS name,
  (SELECT count(*) FROM documents) AS rows_a, (SELECT count(*) FROM labels) AS rows_b,
  (SELECT count(DISTINCT doc_id) FROM documents) AS distinct_a, (SELECT count(DISTINCT doc_id) FROM labels) AS distinct_b,
  (SELECT count(*) FROM documents WHERE doc_id IS NULL) AS nulls_a,
  (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS nulls_b,
  (SELECT count(doc_id) = count(DISTINCT doc_id) FROM documents) AS unique_a,
  (SELECT count(doc_id) = count(DISTINCT doc_id) FROM labels) AS unique_b
"""

EVENT_LOG = "SELECT user_id::VARCHAR AS connection_id, event_type AS query, ts AS used_at FROM events"
UPSERTED = (
    f"SELECT connection_id, query, min(used_at) AS created_at, max(used_at) AS last_used_at FROM ({EVENT_LOG}) "
    "GROUP BY connection_id, query"
)

REDACTED = """
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  concat('CREATE SECRET (KEY_ID ''', user_id, ''', SECRET ''', props, ''', SESSION_TOKEN ''', event_type,
         ''', EXTRA_HTTP_HEADERS MAP {''Authorization'': ''Bearer ', value, '''}) -- KEY ''', event_type, ''''),
  '(KEY_ID '')[^'']*', '\\1***', 'g'), '(SECRET '')[^'']*', '\\1***', 'g'), '(SESSION_TOKEN '')[^'']*', '\\1***', 'g'),
  '(KEY '')[^'']*', '\\1***', 'g'), '(''Bearer )[^'']*', '\\1***', 'g') AS sql
FROM events
"""

DISPLAYED = orders({c: precision(c, 1) for c in ("o_custkey", "o_totalprice")})
ACTIVITY_LOG = (
    "SELECT event_id AS timestamp, event_type AS operation, "
    "concat('SET SECRET ', QUOTED, ' WHERE v = ', user_id) AS sql, 0::BIGINT AS duration_ms, event_id AS rows_affected, "
    "CASE WHEN event_id % 10 = 0 THEN concat('failed with KEY ', QUOTED) END AS error FROM events"
).replace("QUOTED", "chr(39) || '***' || chr(39)")
FIRST_USER = "SELECT user_id::VARCHAR FROM events ORDER BY event_id LIMIT 1"
# Either every "e" of a text changes, or every character that lower() changes; none of them occurs on side B.
DOCUMENT_KEPT = (
    ", CASE WHEN pk_doc_id % 10 = 1 THEN length(a) - (length(a) - length(replace(a, 'e', ''))) "
    "ELSE length(list_aggregate(list_filter(string_split(a, ''), lambda c: lower(c) = c), 'string_agg', '')) END::INTEGER AS kept_chars"
)
CHAR_PARTS = 'WITH c AS ({cells}) SELECT {key}, "column", a AS text_a, b AS text_b{kept} FROM c'


ORACLES: dict[str, str] = {
    "overview_exact": orders().overview(),
    "column_stats_exact": orders().column_stats(),
    "overview_tolerant": tolerant().overview(),
    "column_stats_tolerant": tolerant().column_stats(),
    "ranked_columns": f"SELECT * FROM ({tolerant().column_stats()}) ORDER BY diff_count DESC, ordinal",
    "column_stats_grouped": tolerant().column_stats(),
    "default_precision": orders({c: precision(c, 0) for c in ("o_custkey", "o_totalprice")}).column_stats(),
    "precision_negative": orders({"o_totalprice": precision("o_totalprice", -1)}).column_stats(),
    "precision_override": orders(
        {"o_custkey": precision("o_custkey", 0), "o_totalprice": precision("o_totalprice", 2)}
    ).column_stats(),
    "case_whitespace": orders({c: lower_trim(c) for c in ("o_orderstatus", "o_orderpriority")}).column_stats(),
    "tolerance_fallthrough": orders().column_stats(),
    "seconds_fraction": events(
        "event_id", ["ts", "user_id", "event_type", "value", "props"], {"ts": seconds("ts", 1_500_000)}
    ).column_stats(),
    "seconds_zoned": orders({"o_orderdate": seconds("o_orderdate", 5_000_000)}).column_stats(),
    "diff_join_flat": tolerant(columns=[c for c in ORDERS if c != "o_custkey"], ignored=["o_custkey"]).flat(),
    "composite_key_overview": lineitem().overview(),
    "composite_key_column_stats": lineitem().column_stats(),
    "duplicate_pairs_grouped": lineitem().column_stats(),
    "duplicate_pairs_hot_keys": lineitem().column_stats(),
    "duplicate_pairs_flat": lineitem().flat(),
    "duplicate_pairs_flat_hot_keys": lineitem().flat(),
    "low_cardinality_key_overview": low_cardinality().overview(),
    "low_cardinality_key_stats": low_cardinality().column_stats(),
    "wide_distances_overview": far_times().overview(),
    "wide_distances_stats": far_times().column_stats(),
    "low_cardinality_two_distances": Join(
        duckdb_text(P.EVENTS_TWO_TIMES_A),
        duckdb_text(P.EVENTS_TWO_TIMES_B),
        ["event_type"],
        ["ts", "done"],
        {"ts": seconds("ts", 30_000_000), "done": seconds("done", 60_000_000)},
    ).overview(),
    "expression_key_overview": orders(
        columns=["o_orderkey", *ORDERS], keys=["expr"], key_expression="CAST(o_orderkey AS VARCHAR)"
    ).overview(),
    "where_filter_overview": tolerant(where="o_orderstatus = 'O'").overview(),
    "where_filter_unfiltered_keys": lineitem(where="l_returnflag = 'R'").overview(("source_a", "source_b")),
    "ignored_columns_stats": orders(columns=["o_custkey", "o_orderstatus", "o_totalprice"]).column_stats(),
    "null_key_summary": null_keys().overview(),
    "null_key_reference_mode": null_keys().overview(both_sides=True),
    "null_key_flat": null_keys().flat(),
    "composite_null_keys": Join(
        duckdb_text(P.PARTLY_NULL_KEYS_A),
        duckdb_text(P.PARTLY_NULL_KEYS_B),
        ["o_orderkey", "o_custkey"],
        ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ).overview(),
    "type_mismatch_coerce": retyped(skip=False),
    "type_mismatch_skip": retyped(skip=True),
    "only_in_a": only_in("a", orders()),
    "only_in_b": only_in("b", orders()),
    "only_in_a_null_keys": only_in("a", null_keys()),
    "only_in_a_hot_keys": only_in("a", orders()),
    "in_both_a": f"{orders().ctes} SELECT * EXCLUDE (present) FROM a "
    "WHERE EXISTS (SELECT 1 FROM b WHERE a.o_orderkey = b.o_orderkey)",
    "only_in_page": only_in("a", orders(), " ORDER BY o_orderkey LIMIT 20 OFFSET 20"),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "duplicate_keys_page": "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 "
    "ORDER BY count DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET 100",
    "duplicate_key_count": "SELECT duplicate_pks_a, duplicate_pks_b, null_pks_a, null_pks_b "
    f"FROM ({lineitem().overview()})",
    "rows_all": tolerant().rows("true"),
    "rows_diffs": tolerant().diffs(),
    "indexed_overview": tolerant().overview(),
    "indexed_column_stats": tolerant().column_stats(),
    "indexed_rows_diffs": tolerant().diffs(),
    "indexed_cell_changes": tolerant().cell_changes(),
    "indexed_only_in_a": only_in("a", orders()),
    "indexed_only_in_a_null_keys": only_in("a", null_keys()),
    "indexed_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "suggest_keys_of_many": " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS ordinal, '{a}' AS name, rows_a, rows_b, distinct_a, distinct_b, nulls_a, nulls_b, "
        "known_a = distinct_a AS unique_a, known_b = distinct_b AS unique_b FROM "
        f"(SELECT count(*) AS rows_a, count({a}) AS known_a, count(DISTINCT {a}) AS distinct_a, count(*) - count({a}) AS nulls_a FROM lineitem), "
        f"(SELECT count(*) AS rows_b, count({b}) AS known_b, count(DISTINCT {b}) AS distinct_b, count(*) - count({b}) AS nulls_b FROM orders)"
        for i, (a, b) in enumerate([("l_orderkey", "o_orderkey"), ("l_partkey", "o_custkey"), ("l_linestatus", "o_orderstatus")])
    ),
    "rows_minor": tolerant().minor(),
    "rows_same": tolerant().same(),
    "rows_diffs_one_column": tolerant().rows("is_diff_o_orderdate = 1"),
    "rows_minor_one_column": tolerant().rows("is_diff_o_totalprice = 0 AND is_raw_diff_o_totalprice = 1"),
    "rows_materialized": tolerant().diffs(),
    "diff_rows_page": f"{tolerant().diffs()} ORDER BY pk_o_orderkey_a LIMIT 50 OFFSET 100",
    "diff_rows_keyset_page": page_after(tolerant(), 100),
    "keyset_page_repeated_keys": page_after(lineitem(), 60),
    "deep_page": f"{tolerant().rows('true')} ORDER BY pk_o_orderkey_a LIMIT 100 OFFSET 700",
    "page_at_key": "SELECT * EXCLUDE (nth, below) FROM (SELECT *, row_number() OVER (ORDER BY pk_o_orderkey_a) - 1 AS nth, "
    f"count(*) FILTER (WHERE pk_o_orderkey_a < 1000) OVER () AS below FROM ({tolerant().diffs()})) WHERE nth // 20 = below // 20",
    "deep_page_repeated_keys": f"{lineitem().rows('true')} {total_order(lineitem())} LIMIT 250 OFFSET 2250",
    "json_page": f"SELECT to_json({{o_orderkey: o_orderkey, o_custkey: o_custkey, o_orderstatus: o_orderstatus, "
    f"o_totalprice: o_totalprice, o_orderdate: strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'), "
    f"o_orderpriority: o_orderpriority}})::VARCHAR AS row FROM ({only_in('a', orders())}) ORDER BY o_orderkey LIMIT 50",
    "cell_changes": tolerant().cell_changes(),
    "cell_changes_display": f"WITH c AS ({DISPLAYED.cell_changes()}) SELECT pk_o_orderkey, \"column\", class, "
    + ", ".join(
        f"CASE WHEN \"column\" = 'o_totalprice' AND {x}::DOUBLE % 1 <> 0 "
        f"THEN printf('%.1f', trunc({x}::DOUBLE, 1)) ELSE {x} END AS {x}"
        for x in "ab"
    )
    + " FROM c",
    # One letter of each changed name is replaced, so all others are kept.
    "char_diff": CHAR_PARTS.format(
        cells=customers().cell_changes(), key="pk_c_custkey", kept=", (length(a) - 1)::INTEGER AS kept_chars"
    ),
    "document_char_diff": CHAR_PARTS.format(cells=documents().cell_changes(), key="pk_doc_id", kept=DOCUMENT_KEPT),
    "document_text_stats": documents({"text": lower_trim("text")}).column_stats(),
    "conversation_text_tolerance": Join(
        "SELECT * FROM conversations",
        duckdb_text(P.CONVERSATIONS_B),
        ["conv_id", "turn"],
        ["role", "text"],
        {"role": lower("role"), "text": trim("text")},
    ).column_stats(),
    "page_text_stats": Join(
        "SELECT * FROM pages", duckdb_text(P.PAGES_B), ["page_id"], ["url", "html"], {"html": lower("html")}
    ).column_stats(),
    "cell_edit_distance": f"WITH c AS ({customers().cell_changes()}) "
    'SELECT pk_c_custkey, "column", levenshtein(a, b)::INTEGER AS distance FROM c',
    "schema_comparison": SCHEMA_COMPARISON,
    "suggest_keys": SUGGEST_KEYS,
    "table_meta": columns_of("lineitem"),
    "array_column_diff": Join(
        "SELECT * FROM embeddings",
        "SELECT vec_id, CASE WHEN vec_id % 20 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding, label "
        "FROM embeddings",
        ["vec_id"],
        ["embedding", "label"],
    ).column_stats(),
    "map_column_diff": "SELECT 0::INTEGER AS ordinal, 'maps' AS name, d AS diff_count, 0::BIGINT AS minor_count, n - d AS match_count, "
    "n AS total, (n - d)::DOUBLE / n * 100.0 AS match_pct, d::DOUBLE / n * 100.0 AS diff_pct "
    "FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 20 = 0) AS d FROM events)",
    "display_precision": "SELECT o_orderkey, printf('%.1f', trunc(o_totalprice, 1)) AS shown FROM orders",
    "csv_roundtrip_diff": tolerant().column_stats(ordinal=False),
    "json_roundtrip_diff": tolerant().column_stats(ordinal=False),
    "parquet_export_diff": tolerant().column_stats(ordinal=False),
    "json_array_roundtrip": customers().column_stats(ordinal=False),
    "csv_zoned_roundtrip": tolerant().column_stats(ordinal=False),
    "export_diff_rows": tolerant().diffs(flags=False),
    "typed_load": "SELECT event_id, ts, user_id::DOUBLE AS user_id, event_type, value, props, "
    "CAST(NULL AS BOOLEAN) AS missing FROM events",
    "history_latest": UPSERTED,
    "history_retained": f"SELECT * FROM ({UPSERTED}) QUALIFY row_number() OVER "
    "(PARTITION BY connection_id ORDER BY last_used_at DESC) <= 3 ORDER BY last_used_at DESC LIMIT 500",
    "history_read": f"SELECT * FROM ({UPSERTED}) WHERE connection_id = ({FIRST_USER}) ORDER BY last_used_at DESC",
    "history_deleted": f"SELECT * FROM ({UPSERTED}) QUALIFY row_number() OVER "
    "(ORDER BY last_used_at DESC, connection_id, query) > 1",
    "history_cleared": f"SELECT * FROM ({UPSERTED}) WHERE connection_id IS DISTINCT FROM ({FIRST_USER})",
    "history_stored": f"SELECT * FROM ({UPSERTED}) WHERE connection_id IS DISTINCT FROM ({FIRST_USER}) QUALIFY row_number() OVER "
    "(ORDER BY last_used_at DESC, connection_id, query) > 1",
    "activity_log": ACTIVITY_LOG,
    "history_top_per_group": "SELECT * FROM events QUALIFY row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts DESC, event_id) <= 50",
    "history_top_global": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 500",
    "redact_sql": REDACTED,
    "insert_new_by_name": f"WITH b AS ({duckdb_text(P.CUSTOMER_B)}) SELECT * FROM customer UNION ALL "
    "SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM customer WHERE customer.c_name = b.c_name)",
    "insert_new_stored": f"WITH b AS ({duckdb_text(P.CUSTOMER_B)}) SELECT * FROM customer UNION ALL "
    "SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM customer WHERE customer.c_name = b.c_name)",
    "insert_new_skipped": f"WITH b AS ({duckdb_text(P.CUSTOMER_B)}) SELECT * FROM b "
    "WHERE EXISTS (SELECT 1 FROM customer WHERE customer.c_name = b.c_name)",
}

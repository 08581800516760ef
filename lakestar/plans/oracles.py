"""Independent SQL statements of the registered queries, for DuckDB.

Each statement recomputes its query from the raw test tables in plain SQL: the merges as
LEFT JOIN + NOT EXISTS, identity values as ``row_number()``, one-row-per-key as
``row_number() = 1``.  Statements are assembled from named CTEs; a statement carries only
the CTEs it depends on.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# Fixed values shared with the Spark side (see lakestar.sources.feed and catalog).
# ---------------------------------------------------------------------------
DAY1, DAY2, DAY3 = "2024-05-21", "2024-05-22", "2024-05-23"

KEY = "year, first_name, county, sex"
SILVER_COLS = ('year, first_name, county, sex, "count", _processing_date, _pipeline_run_id, '
               "_input_filename, _input_file_modification_date")
QUALITY = ('year IS NOT NULL AND first_name IS NOT NULL AND county IS NOT NULL AND sex IS NOT NULL'
           ' AND "count" IS NOT NULL AND "count" > 0')
LATEST_ORDER = ('_input_file_modification_date DESC NULLS LAST, "count" ASC NULLS FIRST, '
                "_processing_date DESC NULLS LAST, _pipeline_run_id ASC NULLS FIRST, "
                "_input_filename ASC NULLS FIRST")


def enc(expr: str) -> str:
    """Injective text form of one hashed value: ``<length>:<text>`` or ``N``."""
    return (f"CASE WHEN ({expr}) IS NULL THEN 'N' ELSE concat(CAST(length(CAST({expr} AS VARCHAR))"
            f" AS VARCHAR), ':', CAST({expr} AS VARCHAR)) END")


def hash_of(*exprs: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(enc(e) for e in exprs) + "))"


def day_range(col: str, day: str, next_day: str) -> str:
    return f"{col} >= TIMESTAMP '{day} 00:00:00' AND {col} < TIMESTAMP '{next_day} 00:00:00'"


CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


# ---------------------------------------------------------------------------
# Feed, bronze, silver
# ---------------------------------------------------------------------------
RUN2 = ("l_orderkey % 3 = 0 OR length(p_name) % 5 = 0 OR n_nationkey = 7 "
        "OR year(o_orderdate) = 1996")
cte("feed", """
SELECT
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_partkey % 61 = 0 THEN repeat(p_name, 40)
       ELSE p_name END AS first_name,
  CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE n_name END AS county,
  CASE WHEN l_suppkey % 83 = 0 AND l_linenumber = 1 THEN NULL ELSE l_returnflag END AS sex,
  CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN 0
       WHEN l_linenumber = 6 AND l_quantity > 45 THEN -1
       WHEN l_linenumber = 5 AND l_quantity > 45 THEN NULL
       ELSE CAST(trunc(l_quantity) AS INTEGER) END AS name_count,
  CASE WHEN {run2} THEN TIMESTAMP '2024-05-22 10:00:00'
       ELSE TIMESTAMP '2024-05-21 10:00:00' END AS _processing_date,
  CASE WHEN {run2} THEN 'run-2' ELSE 'run-1' END AS _pipeline_run_id,
  CASE WHEN {run2} THEN 'feed-2.csv' ELSE 'feed-1.csv' END AS _input_filename,
  CAST(l_shipdate AS TIMESTAMP) AS _input_file_modification_date
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation   ON c_nationkey = n_nationkey
JOIN part     ON l_partkey = p_partkey
""".replace("{run2}", RUN2))

cte("silver_all", f"""
SELECT year, first_name, county, sex, name_count AS "count", _processing_date, _pipeline_run_id,
       _input_filename, _input_file_modification_date
FROM feed
""")
cte("slice1", f"SELECT * FROM silver_all WHERE {day_range('_processing_date', DAY1, DAY2)}")
cte("slice2", f"SELECT * FROM silver_all WHERE {day_range('_processing_date', DAY2, DAY3)}")

for _n in ("1", "2"):
    cte(f"surv{_n}", f"""
SELECT {SILVER_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {LATEST_ORDER}) AS rn
  FROM slice{_n} WHERE {QUALITY}) WHERE rn = 1
""")
    cte(f"err{_n}", f"SELECT {SILVER_COLS} FROM slice{_n} EXCEPT SELECT {SILVER_COLS} FROM surv{_n}")

cte("silver1", "SELECT * FROM surv1")

_KEYJOIN = "t.year = s.year AND t.first_name = s.first_name AND t.county = s.county AND t.sex = s.sex"
cte("m1_join", f"""
SELECT t.*, s.year IS NOT NULL AS s_hit, s."count" AS s_count, s._processing_date AS s_pd,
       s._pipeline_run_id AS s_run, s._input_filename AS s_file,
       s._input_file_modification_date AS s_mod,
       coalesce(s.year IS NOT NULL AND t._input_file_modification_date < s._input_file_modification_date,
                false) AS upd
FROM silver1 t LEFT JOIN surv2 s ON {_KEYJOIN}
""")
cte("m1_new", f"SELECT s.* FROM surv2 s WHERE NOT EXISTS (SELECT 1 FROM silver1 t WHERE {_KEYJOIN})")
cte("silver2", f"""
SELECT year, first_name, county, sex,
  CASE WHEN upd THEN s_count ELSE "count" END AS "count",
  CASE WHEN upd THEN s_pd ELSE _processing_date END AS _processing_date,
  CASE WHEN upd THEN s_run ELSE _pipeline_run_id END AS _pipeline_run_id,
  CASE WHEN upd THEN s_file ELSE _input_filename END AS _input_filename,
  CASE WHEN upd THEN s_mod ELSE _input_file_modification_date END AS _input_file_modification_date
FROM m1_join
UNION ALL
SELECT {SILVER_COLS} FROM m1_new
""")
cte("silver1_d1", f"SELECT * FROM silver1 WHERE {day_range('_processing_date', DAY1, DAY2)}")
cte("silver2_d2", f"SELECT * FROM silver2 WHERE {day_range('_processing_date', DAY2, DAY3)}")

# ---------------------------------------------------------------------------
# Gold: dimensions and fact
# ---------------------------------------------------------------------------
DIMS = {
    # name: (business key columns, sid alias in the fact)
    "names": (("first_name", "sex"), "nameSid"),
    "years": (("year",), "yearSid"),
    "locations": (("county",), "locationSid"),
}
CONTROL = "_keyHash, _valueHash, _pipeline_run_id, _processing_date"


def dim_delta(dim: str, source: str) -> str:
    keys = DIMS[dim][0]
    k = ", ".join(keys)
    return f"""
SELECT {k}, _pipeline_run_id, _processing_date,
       {hash_of(*keys)} AS _keyHash,
       {hash_of('_pipeline_run_id', '_processing_date')} AS _valueHash
FROM (SELECT {k}, _pipeline_run_id, _processing_date,
        row_number() OVER (PARTITION BY {k}
          ORDER BY _processing_date DESC NULLS LAST, _pipeline_run_id DESC NULLS LAST) AS rn
      FROM {source}) WHERE rn = 1
"""


def star_v1(cols: str, order: str, delta: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY {order}) - 1 AS sid, {cols}, {CONTROL} FROM {delta}
"""


def star_v2(cols: str, order: str, current: str, delta: str, update_set: tuple[str, ...]) -> str:
    """Hash-change merge: matched rows with a new value hash take ``update_set`` from the
    source; unmatched source rows get ids after the current maximum."""
    out = ["sid", *cols.split(", "), "_keyHash", "_valueHash", "_pipeline_run_id", "_processing_date"]
    upd = "coalesce(s._valueHash <> t._valueHash, false)"
    proj = ", ".join(
        f"CASE WHEN {upd} THEN s.{c} ELSE t.{c} END AS {c}" if c in update_set else f"t.{c}"
        for c in out
    )
    return f"""
SELECT {proj} FROM {current} t LEFT JOIN {delta} s ON t._keyHash = s._keyHash
UNION ALL
SELECT (SELECT coalesce(max(sid) + 1, 0) FROM {current})
       + row_number() OVER (ORDER BY {order}) - 1 AS sid, {cols}, {CONTROL}
FROM {delta} s WHERE NOT EXISTS (SELECT 1 FROM {current} t WHERE t._keyHash = s._keyHash)
"""


_DIM_UPDATE = ("_pipeline_run_id", "_processing_date", "_keyHash", "_valueHash")
for _dim, (_keys, _alias) in DIMS.items():
    _cols = ", ".join(_keys)
    _order = ", ".join(f"{c} ASC NULLS FIRST" for c in _keys) + ", _keyHash ASC NULLS FIRST"
    cte(f"d{_dim}_delta1", dim_delta(_dim, "silver1_d1"))
    cte(f"d{_dim}_delta2", dim_delta(_dim, "silver2_d2"))
    cte(f"dim_{_dim}_v1", star_v1(_cols, _order, f"d{_dim}_delta1"))
    cte(f"dim_{_dim}_v2", star_v2(_cols, _order, f"dim_{_dim}_v1", f"d{_dim}_delta2", _DIM_UPDATE))
    cte(f"d{_dim}_all_delta", dim_delta(_dim, "silver2"))


def fact_rows(source: str, version: str) -> str:
    return f"""
SELECT coalesce(n.sid, -1) AS nameSid, coalesce(y.sid, -1) AS yearSid,
       coalesce(l.sid, -1) AS locationSid, x."count", x._pipeline_run_id, x._processing_date
FROM {source} x
LEFT JOIN dim_names_{version} n ON x.first_name = n.first_name AND x.sex = n.sex
LEFT JOIN dim_years_{version} y ON x.year = y.year
LEFT JOIN dim_locations_{version} l ON x.county = l.county
"""


FACT_KEY = ("nameSid", "yearSid", "locationSid")


def fact_delta(rows: str) -> str:
    return f"""
SELECT nameSid, yearSid, locationSid, "count", _pipeline_run_id, _processing_date,
       {hash_of(*FACT_KEY)} AS _keyHash,
       {hash_of('"count"', '_pipeline_run_id', '_processing_date')} AS _valueHash
FROM (SELECT *, row_number() OVER (PARTITION BY nameSid, yearSid, locationSid
        ORDER BY _processing_date DESC NULLS LAST, _pipeline_run_id DESC NULLS LAST,
                 "count" ASC NULLS FIRST) AS rn
      FROM {rows}) WHERE rn = 1
"""


_FACT_COLS = 'nameSid, yearSid, locationSid, "count"'
_FACT_ORDER = ("nameSid ASC NULLS FIRST, yearSid ASC NULLS FIRST, locationSid ASC NULLS FIRST, "
               "_keyHash ASC NULLS FIRST")
_FACT_UPDATE = ('"count"', "_pipeline_run_id", "_processing_date", "_valueHash")
cte("fact_rows1", fact_rows("silver1_d1", "v1"))
cte("fact_rows2", fact_rows("silver2_d2", "v2"))
cte("fact_delta1", fact_delta("fact_rows1"))
cte("fact_delta2", fact_delta("fact_rows2"))
cte("fact_v1", star_v1(_FACT_COLS, _FACT_ORDER, "fact_delta1"))
cte("fact_v2", star_v2(_FACT_COLS, _FACT_ORDER, "fact_v1", "fact_delta2", _FACT_UPDATE))
cte("fact_rows_all", fact_rows("silver2", "v2"))

# ---------------------------------------------------------------------------
# Mart
# ---------------------------------------------------------------------------
MART_COPY = {
    "names": "sid, left(first_name, 265) AS first_name, left(sex, 10) AS sex",
    "years": "sid, TRY_CAST(year AS INTEGER) AS year",
    "locations": "sid, left(county, 265) AS county",
    "fact": ("sid, TRY_CAST(nameSid AS BIGINT) AS nameSid, TRY_CAST(yearSid AS BIGINT) AS yearSid, "
             'TRY_CAST(locationSid AS BIGINT) AS locationSid, TRY_CAST("count" AS INTEGER) AS "count"'),
}
MART_BUSINESS = {
    "names": ("first_name", "sex"),
    "years": ("year",),
    "locations": ("county",),
    "fact": ("nameSid", "yearSid", "locationSid", '"count"'),
}
UNKNOWN = {
    "names": "SELECT CAST(-1 AS BIGINT) AS sid, CAST(NULL AS VARCHAR) AS first_name, "
             "CAST(NULL AS VARCHAR) AS sex",
    "years": "SELECT CAST(-1 AS BIGINT) AS sid, CAST(NULL AS INTEGER) AS year",
    "locations": "SELECT CAST(-1 AS BIGINT) AS sid, CAST(NULL AS VARCHAR) AS county",
}


def gold_name(table: str, version: str) -> str:
    return f"fact_{version}" if table == "fact" else f"dim_{table}_{version}"


def upsert_sql(current: str, source: str, table: str) -> str:
    business = MART_BUSINESS[table]
    sets = ", ".join(f"CASE WHEN s.sid IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in business)
    cols = ", ".join(business)
    return f"""
SELECT t.sid, {sets} FROM {current} t LEFT JOIN {source} s ON t.sid = s.sid
UNION ALL
SELECT sid, {cols} FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {current} t WHERE t.sid = s.sid)
"""


for _table in ("names", "years", "locations", "fact"):
    cte(f"mart_{_table}_v1_core", f"SELECT {MART_COPY[_table]} FROM {gold_name(_table, 'v1')}")
    cte(f"mart_{_table}_src2", f"SELECT {MART_COPY[_table]} FROM {gold_name(_table, 'v2')}")
    cte(f"mart_{_table}_chg2", f"SELECT {MART_COPY[_table]} FROM {gold_name(_table, 'v2')} "
        f"WHERE {day_range('_processing_date', DAY2, DAY3)}")
    if _table == "fact":
        cte("mart_fact_v1", "SELECT * FROM mart_fact_v1_core")
        cte("mart_fact_v2", upsert_sql("mart_fact_v1", "mart_fact_src2", "fact"))
    else:
        cte(f"mart_{_table}_v1", f"SELECT * FROM mart_{_table}_v1_core UNION ALL {UNKNOWN[_table]}")
        cte(f"mart_{_table}_v2", upsert_sql(f"mart_{_table}_v1", f"mart_{_table}_src2", _table))


# ---------------------------------------------------------------------------
# Assembly
# ---------------------------------------------------------------------------
_IDENT = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\b")


def _deps(body: str) -> list[str]:
    return [w for w in dict.fromkeys(_IDENT.findall(body)) if w in CTES]


def with_ctes(final: str) -> str:
    """``WITH`` clause of every CTE ``final`` needs (dependencies first), then ``final``."""
    order: list[str] = []

    def visit(name: str, stack: tuple[str, ...] = ()) -> None:
        if name in order or name in stack:
            return
        for d in _deps(CTES[name]):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for d in _deps(final):
        visit(d)
    if not order:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order) + "\n" + final.strip()


STATEMENTS: dict[str, str] = {}


def oracle(name: str, final: str) -> None:
    STATEMENTS[name] = with_ctes(final)


LANDING = "year, first_name, county, sex, name_count"
BRONZE = (LANDING + ", _processing_date, _pipeline_run_id, _input_filename, "
          "_input_file_modification_date")

# Sources and sinks
oracle("scan_csv", f"SELECT {LANDING} FROM feed")
oracle("scan_csv_inferred", f"SELECT {LANDING} FROM feed")
oracle("rescued_values", """
SELECT year, first_name, county, sex, CASE WHEN year % 5 = 0 THEN NULL ELSE name_count END AS name_count,
       CASE WHEN year % 5 = 0 AND name_count IS NOT NULL THEN '~' || name_count::VARCHAR END AS raw_count
FROM feed
""")
oracle("scan_table", f"SELECT {BRONZE} FROM feed")
oracle("file_lineage", f"SELECT {LANDING}, _input_filename AS landing_file, TRUE AS has_file_time "
       "FROM feed")
oracle("scan_modified_since", "SELECT * FROM fact_v2")
oracle("scan_mart_by_name", "SELECT * FROM mart_fact_v2")
oracle("incremental_slice", f"SELECT {BRONZE} FROM feed WHERE "
       f"{day_range('_processing_date', DAY2, DAY3)}")
oracle("bronze_append", f"SELECT {BRONZE} FROM feed")
oracle("bronze_append_twice", f"SELECT {BRONZE} FROM feed")
oracle("silver_first_load", "SELECT * FROM surv1")
oracle("csv_requote_roundtrip", f"SELECT {BRONZE} FROM feed")
for _table, _key in (("names", "dim_names"), ("years", "dim_years"),
                     ("locations", "dim_locations"), ("fact", "fact")):
    oracle(f"mart_copy_{_key}", f"SELECT * FROM mart_{_table}_src2")

# Projections and filters
oracle("quality_clean", f"SELECT * FROM silver_all WHERE {QUALITY}")
oracle("audit_columns", f"SELECT {LANDING}, TIMESTAMP '2024-05-21 18:39:52' AS _processing_date, "
       "'run-audit' AS _pipeline_run_id FROM feed")
oracle("rename_measure", "SELECT * FROM silver_all")
oracle("unknown_member", """
SELECT x.year, x.first_name, x.county, x.sex, coalesce(n.sid, -1) AS nameSid,
       coalesce(y.sid, -1) AS yearSid, coalesce(l.sid, -1) AS locationSid,
       x."count", x._pipeline_run_id, x._processing_date
FROM silver2 x
LEFT JOIN dim_names_v1 n ON x.first_name = n.first_name AND x.sex = n.sex
LEFT JOIN dim_years_v1 y ON x.year = y.year
LEFT JOIN dim_locations_v1 l ON x.county = l.county
""")
oracle("filter_ci", "SELECT * FROM silver2 WHERE lower(first_name) = lower('RED WIDGET')")

# Joins
oracle("lookup_name_sid", """
SELECT s.*, n.sid AS nameSid FROM silver2 s
LEFT JOIN dim_names_v1 n ON s.first_name = n.first_name AND s.sex = n.sex
""")
oracle("lookup_year_sid", "SELECT s.*, y.sid AS yearSid FROM silver2 s "
       "LEFT JOIN dim_years_v1 y ON s.year = y.year")
oracle("lookup_location_sid", "SELECT s.*, l.sid AS locationSid FROM silver2 s "
       "LEFT JOIN dim_locations_v1 l ON s.county = l.county")
oracle("quarantine", "SELECT * FROM err1 UNION ALL SELECT * FROM err2")
_FK = ("nameSid", "dim_names", "dim_names_v1"), ("yearSid", "dim_years", "dim_years_v1"), \
      ("locationSid", "dim_locations", "dim_locations_v1")
cte("fk_facts", fact_rows("silver2", "v1"))
oracle("fk_orphans", "\nUNION ALL\n".join(
    f"SELECT '{fk}' AS fk_column, '{dim}' AS dim_table, count(*) AS orphan_rows FROM fk_facts f "
    f"WHERE f.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tbl} d WHERE d.sid = f.{fk})" for fk, dim, tbl in _FK))
oracle("fk_check_mart", "\nUNION ALL\n".join(
    f"SELECT '{fk}' AS fk_column, '{dim}' AS dim_table, count(*) AS orphan_rows FROM mart_fact_v2 f "
    f"WHERE f.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mart_{dim[4:]}_v2 d "
    f"WHERE d.sid = f.{fk})"
    for fk, dim, _ in _FK))

# Aggregations
oracle("dedup_names", "SELECT * FROM dnames_all_delta")
oracle("dedup_years", "SELECT * FROM dyears_all_delta")
oracle("dedup_locations", "SELECT * FROM dlocations_all_delta")
oracle("dedup_fact", f"SELECT * FROM ({fact_delta('fact_rows_all')})")
oracle("mart_dedup_distinct", "\nUNION ALL BY NAME\n".join(
    f"SELECT DISTINCT *, 'dim_{_t}' AS dim FROM (SELECT * FROM mart_{_t}_v1_core "
    f"UNION ALL SELECT * FROM mart_{_t}_src2)" for _t in ("names", "years", "locations")))
oracle("pk_violations", "SELECT sid, count(*) AS n_rows FROM (SELECT DISTINCT * FROM "
       "(SELECT * FROM mart_fact_v1_core UNION ALL SELECT * FROM mart_fact_src2)) "
       "GROUP BY sid HAVING count(*) > 1")

# Windows
oracle("latest_per_key", f"""
SELECT {SILVER_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {LATEST_ORDER}) AS rn
  FROM silver_all WHERE {QUALITY}) WHERE rn = 1
""")
oracle("mart_dedup_rownum", f"""
SELECT {MART_COPY['fact']} FROM (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY _processing_date DESC NULLS LAST,
    nameSid ASC NULLS FIRST, yearSid ASC NULLS FIRST, locationSid ASC NULLS FIRST,
    "count" ASC NULLS FIRST, _keyHash ASC NULLS FIRST, _valueHash ASC NULLS FIRST,
    _pipeline_run_id ASC NULLS FIRST) AS rn
  FROM (SELECT * FROM fact_v1 UNION ALL SELECT * FROM fact_v2)) WHERE rn = 1
""")

# Reports: plain aggregates over the mart as one flat table
cte("mart_flat", """
SELECT f."count" AS n, d.first_name, d.sex, t.year FROM mart_fact_v2 f, mart_names_v2 d, mart_years_v2 t
WHERE f.nameSid = d.sid AND f.yearSid = t.sid
""")


def top_of(k: int, key: str, value: str, source: str) -> str:
    """The k keys with the largest totals, ties by key."""
    return f"""
SELECT {key}, total AS {value} FROM (
  SELECT {key}, total, row_number() OVER (ORDER BY total DESC, {key}) AS place
  FROM (SELECT {key}, CAST(sum(n) AS BIGINT) AS total FROM ({source}) GROUP BY {key}))
WHERE place <= {k}
"""


oracle("report_top10_f", top_of(10, "first_name", "total_count",
                                "SELECT * FROM mart_flat WHERE sex = 'R' AND year = 1998"))
oracle("report_top3_m", top_of(3, "first_name", "total_count",
                               "SELECT * FROM mart_flat WHERE sex = 'A' AND year = 1999"))
oracle("report_name_by_year", "SELECT year, CAST(sum(n) AS BIGINT) AS total_count FROM mart_flat "
       "WHERE first_name = 'red widget' GROUP BY year")
oracle("report_top10_all", top_of(10, "first_name", "cnt",
                                  'SELECT first_name, "count" AS n FROM silver2'))

# Merge, upsert, identity
oracle("merge_newer_wins", "SELECT * FROM silver2")
oracle("merge_metrics", """
SELECT (SELECT count(*) FROM m1_new) AS inserted,
       (SELECT count(*) FROM m1_join WHERE upd) AS updated,
       (SELECT count(*) FROM m1_join WHERE s_hit AND NOT upd) AS unchanged,
       (SELECT count(*) FROM m1_join WHERE NOT s_hit) AS carried,
       (SELECT count(*) FROM silver2) AS rows_out
""")
oracle("merge_dim_names", "SELECT * FROM dim_names_v2")
oracle("merge_dim_years", "SELECT * FROM dim_years_v2")
oracle("merge_dim_locations", "SELECT * FROM dim_locations_v2")
oracle("merge_fact", "SELECT * FROM fact_v2")
for _table, _key in (("names", "dim_names"), ("years", "dim_years"),
                     ("locations", "dim_locations"), ("fact", "fact")):
    oracle(f"upsert_{_key}", upsert_sql(f"mart_{_table}_v1", f"mart_{_table}_chg2", _table))
_KEY_ORDER = ("year ASC NULLS FIRST, first_name ASC NULLS FIRST, county ASC NULLS FIRST, "
              "sex ASC NULLS FIRST")
oracle("assign_sid", f"SELECT row_number() OVER (ORDER BY {_KEY_ORDER}) - 1 AS sid, {KEY} "
       "FROM silver2")
cte("ids1", f"SELECT row_number() OVER (ORDER BY {_KEY_ORDER}) - 1 AS sid, {KEY} FROM silver1")
oracle("assign_sid_incremental", f"""
SELECT * FROM ids1
UNION ALL
SELECT (SELECT coalesce(max(sid) + 1, 0) FROM ids1) + row_number() OVER (ORDER BY {_KEY_ORDER}) - 1
       AS sid, {KEY}
FROM silver2 s WHERE NOT EXISTS (SELECT 1 FROM ids1 t WHERE t.year = s.year AND
  t.first_name = s.first_name AND t.county = s.county AND t.sex = s.sex)
""")
oracle("merge_ambiguous_keys", f"""
SELECT _keyHash, count(*) AS n_rows
FROM (SELECT {hash_of('first_name', 'sex')} AS _keyHash FROM silver2)
GROUP BY _keyHash HAVING count(*) > 1
""")

# Scalar functions
oracle("hash_keys", f"""
SELECT year, first_name, county, sex,
  {hash_of('first_name', 'sex')} AS name_key_hash,
  {hash_of('year')} AS year_key_hash,
  {hash_of('county')} AS location_key_hash,
  {hash_of('_pipeline_run_id', '_processing_date')} AS value_hash
FROM silver2
""")
oracle("hash_collisions", f"""
SELECT count(*) AS n_rows,
  count(DISTINCT {hash_of(*FACT_KEY)}) AS n_exact_hashes,
  count(DISTINCT sha256(concat(CAST(nameSid AS VARCHAR), CAST(yearSid AS VARCHAR),
                               CAST(locationSid AS VARCHAR)))) AS n_compat_hashes
FROM fact_rows_all
""")
oracle("parse_dates", """
SELECT _processing_date,
  strftime(_processing_date, '%d-%m-%Y') AS day_param,
  strftime(_processing_date, '%d-%m-%Y %H:%M:%S') AS ts_param,
  strptime(strftime(_processing_date, '%d-%m-%Y'), '%d-%m-%Y') AS day_start,
  strptime(strftime(_processing_date, '%d-%m-%Y %H:%M:%S'), '%d-%m-%Y %H:%M:%S') AS parsed_ts,
  CAST(_processing_date AS DATE) AS processing_day
FROM (SELECT DISTINCT _processing_date FROM feed)
""")
oracle("run_parameters", """
SELECT _pipeline_run_id,
  concat('nybabynames-', strftime(_processing_date, '%d-%m-%Y'), '.csv') AS landing_file,
  strftime(_processing_date, '%d-%m-%Y %H:%M:%S') AS ts_param,
  _processing_date - INTERVAL 1 DAY AS modified_since
FROM (SELECT DISTINCT _pipeline_run_id, _processing_date FROM feed)
""")

# Maintenance
oracle("compact_preserves_rows", "SELECT * FROM silver2")
oracle("compact_day", f"SELECT {BRONZE} FROM feed")

# The flow
oracle("run_bronze", f"SELECT {LANDING}, _processing_date, _pipeline_run_id FROM feed")
oracle("stream_bronze", f"SELECT {LANDING}, _processing_date, _pipeline_run_id FROM feed")
oracle("run_silver", "SELECT * FROM silver2")
oracle("run_errors", "SELECT * FROM err1 UNION ALL SELECT * FROM err2")
oracle("run_dims", """
SELECT sid, first_name, sex, NULL::INTEGER AS year, NULL::VARCHAR AS county, _keyHash, _valueHash,
       _pipeline_run_id, _processing_date, 'dim_names' AS dim FROM dim_names_v2
UNION ALL
SELECT sid, NULL, NULL, year, NULL, _keyHash, _valueHash, _pipeline_run_id, _processing_date,
       'dim_years' FROM dim_years_v2
UNION ALL
SELECT sid, NULL, NULL, NULL, county, _keyHash, _valueHash, _pipeline_run_id, _processing_date,
       'dim_locations' FROM dim_locations_v2
""")
oracle("run_fact", "SELECT * FROM fact_v2")
oracle("run_mart", """
SELECT f.sid, n.first_name, n.sex, y.year, l.county, f."count"
FROM mart_fact_v2 f JOIN mart_names_v2 n ON f.nameSid = n.sid
JOIN mart_years_v2 y ON f.yearSid = y.sid JOIN mart_locations_v2 l ON f.locationSid = l.sid
""")


def _audit() -> str:
    counted = []
    for v in ("1", "2"):
        merge = {"rows_out": f"silver{v}"}
        if v == "1":
            merge["inserted"] = "silver1"
            zero = ("updated", "unchanged", "carried")
        else:
            merge |= {"inserted": "m1_new", "updated": "(SELECT * FROM m1_join WHERE upd)",
                      "unchanged": "(SELECT * FROM m1_join WHERE s_hit AND NOT upd)",
                      "carried": "(SELECT * FROM m1_join WHERE NOT s_hit)"}
            zero = ()
        rows = [("append_bronze", "bronze", f"(SELECT * FROM feed WHERE _pipeline_run_id = 'run-{v}')"),
                ("bronze_to_silver", "errors", f"err{v}"),
                *(("bronze_to_silver", m, t) for m, t in merge.items()),
                *(("bronze_to_silver", m, "(SELECT 1 WHERE false)") for m in zero)]
        for table, key in (("names", "dim_names"), ("years", "dim_years"),
                           ("locations", "dim_locations"), ("fact", "fact")):
            rows += [("silver_to_gold", key, gold_name(table, f"v{v}")),
                     ("gold_to_mart", key, f"mart_{table}_v{v}")]
        counted += [f"SELECT 'run-{v}' AS run_id, {v} AS version, '{step}' AS step, "
                    f"'{metric}' AS metric, count(*) AS value FROM {source}"
                    for step, metric, source in rows]
    return "\nUNION ALL\n".join(counted)


oracle("run_audit", _audit())


def _history() -> str:
    rows = []
    for v in ("1", "2"):
        none = ("NULL",) * 3
        rows += [("bronze", "WRITE", f"(SELECT * FROM feed WHERE _pipeline_run_id = 'run-{v}')", none),
                 ("errors", "WRITE", f"err{v}", none)]
        merged = (("(SELECT count(*) FROM silver1)", "0", "0") if v == "1" else
                  ("(SELECT count(*) FROM m1_new)", "(SELECT count(*) FROM m1_join WHERE upd)",
                   "(SELECT count(*) FROM m1_join WHERE NOT upd)"))
        rows.append(("silver", "MERGE", f"silver{v}", merged))
        for table, key in (("names", "dim_names"), ("years", "dim_years"),
                           ("locations", "dim_locations"), ("fact", "fact")):
            rows += [(f"gold_{key}", "MERGE", gold_name(table, f"v{v}"), none),
                     (f"mart_{key}", "MERGE", f"mart_{table}_v{v}", none)]
        for at, r in enumerate(rows):
            if len(r) == 4:
                rows[at] = (*r, v)
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", {v} AS version, '{op}' AS operation, "
        f"(SELECT count(*) FROM {source}) AS output_rows, CAST({m[0]} AS BIGINT) AS inserted, "
        f"CAST({m[1]} AS BIGINT) AS updated, CAST({m[2]} AS BIGINT) AS copied"
        for t, op, source, m, v in rows)


oracle("table_history", _history())
oracle("compaction_due", f"""
SELECT "table", CAST(NULL AS INTEGER) AS compacted_version, count(*) AS operations,
       CAST(sum(output_rows) AS BIGINT) AS rows_since, TRUE AS due
FROM ({_history()}) WHERE "table" NOT IN ('bronze', 'errors') GROUP BY 1
UNION ALL
SELECT 'bronze', 3, 3, (SELECT count(*) FROM feed WHERE _pipeline_run_id = 'run-2'), TRUE
""")
oracle("run_errors_rescued", """
SELECT DISTINCT year, first_name, county, sex, CAST(NULL AS INTEGER) AS "count",
       '~' || name_count::VARCHAR AS raw_count
FROM feed WHERE _pipeline_run_id = 'run-1' AND year % 5 = 0 AND name_count IS NOT NULL
""")

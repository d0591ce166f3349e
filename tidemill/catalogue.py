"""Registered queries over the cleaning operators, each with the DuckDB SQL of the same result.

Dirty text is derived from clean columns by rules on keys, so the SQL can state the expected result
from the clean column or repeat the rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import numbers, text, times, values
from tidemill.functions.outcome import Outcome
from tidemill.operators import profile, reports
from tidemill.operators.classify import classify, cleaned, first_seen, typed
from tidemill.plans.spec import Field, Pipeline, Policies, Skip, Step

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "clean_orders"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(rows: DataFrame, key: str, o: Outcome) -> DataFrame:
    return rows.select(key, o.cell.alias("_x")).select(key, F.col("_x.v").alias("value"), F.col("_x.code").alias("code"), F.col("_x.warn").alias("warned"))


# ---- cells

PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)"


@registered(f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE '' END || {PRICE} AS value, CAST(NULL AS VARCHAR) AS code, false AS warned FROM orders")
def to_decimal_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2)
    dirty = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("($"), price, F.lit(")"))).otherwise(F.concat(F.lit(" $"), price))
    return _shown(_table(spark, sf_dir, "orders"), "o_orderkey", numbers.to_decimal(dirty, ",", True, True, scale=2))


@registered("SELECT l_orderkey, l_linenumber, CAST(l_discount AS DECIMAL(10,2)) AS value, CAST(NULL AS VARCHAR) AS code FROM lineitem")
def to_decimal_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat((F.col("l_discount").cast("decimal(10,2)") * 100).cast("int").cast("string"), F.lit(" %"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.to_decimal(dirty, percent=True).cell.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.col("x.v").try_cast("decimal(10,2)").alias("value"), F.col("x.code").alias("code"))


@registered("SELECT p_partkey, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '000' WHEN 1 THEN '000000' ELSE '' END AS value FROM part")
def to_decimal_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 == 0, "K").when(F.col("p_partkey") % 3 == 1, "m").otherwise("")
    dirty = F.concat(F.floor("p_retailprice").cast("string"), unit)
    return _table(spark, sf_dir, "part").select("p_partkey", numbers.to_decimal(dirty, magnitude=True).value.alias("value"))


@registered("SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'TYP-08' ELSE 'ok' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def scale_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    dirty = F.when(F.col("l_orderkey") % 5 == 0, F.concat(price, F.lit("1"))).otherwise(F.concat(price, F.lit("0")))
    code = numbers.to_decimal(dirty, scale=2).code
    return _table(spark, sf_dir, "lineitem").groupBy(F.coalesce(code, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey * 1001 AS VARCHAR) END AS value, CASE WHEN o_orderkey % 9 = 0 THEN 'TYP-01' END AS code, false AS warned FROM orders")
def to_int_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.format_number(F.col("o_orderkey") * 1001, 0), F.when(F.col("o_orderkey") % 9 == 0, ".0").otherwise(""))
    return _shown(_table(spark, sf_dir, "orders"), "o_orderkey", numbers.to_int(dirty, ","))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 11 = 0 THEN 'TYP-03' END AS code, false AS warned FROM orders")
def to_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    dirty = F.when(F.col("o_orderkey") % 11 == 0, "31/31/2026").when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return _shown(_table(spark, sf_dir, "orders"), "o_orderkey", times.to_date(dirty, ["%m/%d/%Y", "%d.%m.%Y"]))


@registered("SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+0000' AS value, CAST(NULL AS VARCHAR) AS code, false AS warned FROM events")
def to_datetime_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return _shown(_table(spark, sf_dir, "events"), "event_id", times.to_datetime(dirty, ["%Y-%m-%d %H:%M:%S"], "+05:30"))


@registered("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' END AS value, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'TYP-06' END AS code, o_orderstatus = 'F' AS warned FROM orders")
def to_bool_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    dirty = F.when(s == "O", "Yes").when(s == "F", "NO").otherwise("maybe")
    return _shown(_table(spark, sf_dir, "orders"), "o_orderkey", values.to_bool(dirty, {"Yes": True, "No": False}))


@registered("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_mktsegment END AS value,
  CASE c_custkey % 4 WHEN 0 THEN 'TYP-10,NUL-03' WHEN 1 THEN 'NUL-02' WHEN 2 THEN 'TYP-10' ELSE '' END AS warned FROM customer""")
def null_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    dirty = F.when(k == 0, " N/A ").when(k == 1, "   ").when(k == 2, F.concat(F.lit("\t"), s, F.lit(" "))).otherwise(s)
    x = cleaned(dirty, dirty, Pipeline("q", ("c",), (), sentinels={"c": ("N/A",)}), "c")
    return _table(spark, sf_dir, "customer").select("c_custkey", x["v"].alias("value"), F.array_join(x["warns"], ",").alias("warned"))


@registered(r"""SELECT doc_id, md5(nullif(kept, '')) AS digest, CASE WHEN kept IS NULL THEN '' ELSE CASE WHEN changed THEN 'ENC-03,' ELSE '' END || 'ENC-04,ENC-05,' || CASE kept WHEN '' THEN 'NUL-02' ELSE 'TYP-10' END END AS warned
  FROM (SELECT doc_id, nfc_normalize(text) <> text AS changed, regexp_replace(nfc_normalize(text), '^\s+|\s+$', '', 'g') AS kept FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dirty = F.concat(F.lit("\x07 "), F.col("text"), F.lit(" ​"))
    docs = docs.select("doc_id", dirty.alias("raw")).withColumn("nfc", text.normalize(F.col("raw")))
    x = cleaned(F.col("nfc"), F.col("raw"), Pipeline("q", ("c",), ()), "c")
    return docs.select("doc_id", F.md5(x["v"]).alias("digest"), F.array_join(x["warns"], ",").alias("warned"))


@registered("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def unicode_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text"), "NFD").alias("x"))
    return docs.select("doc_id", F.md5(text.normalize(F.col("x"))).alias("digest"))


@registered(r"""SELECT doc_id, md5(CASE WHEN signed THEN text ELSE broken END) AS digest, coalesce(signed, false) AS warned FROM (
  SELECT doc_id, text, regexp_matches(text, '[\x{80}-\x{ff}\x{400}-\x{47f}]') AND NOT contains(text, chr(65533)) AS signed,
    array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: chr(CAST('0x' || b AS INTEGER))), '') AS broken FROM documents)""")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _table(spark, sf_dir, "documents").select("doc_id", text.repair_mojibake(broken).cell.alias("x")).select("doc_id", F.md5("x.v").alias("digest"), F.col("x.warn").alias("warned"))


@registered("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '''=' || event_type WHEN 1 THEN '''-' || event_type WHEN 2 THEN '+' || CAST(event_id AS VARCHAR) WHEN 3 THEN '-' ELSE event_type END AS value,
  CAST(NULL AS VARCHAR) AS code, event_id % 5 < 2 AS warned FROM events""")
def formula_neutralization(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 5, F.col("event_type")
    dirty = F.when(k == 0, F.concat(F.lit("="), e)).when(k == 1, F.concat(F.lit("-"), e)).when(k == 2, F.concat(F.lit("+"), F.col("event_id").cast("string"))).when(k == 3, "-").otherwise(e)
    return _shown(_table(spark, sf_dir, "events"), "event_id", text.neutralize_formula(dirty))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name || ' / ' || c_mktsegment END AS value FROM customer")
def concat_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return _table(spark, sf_dir, "customer").select("c_custkey", values.concat([F.col("c_name"), part], " / ").value.alias("value"))


@registered("SELECT lang, count(CASE WHEN length(text) > 1000 THEN 1 END) AS too_long, count(*) AS n FROM documents GROUP BY lang")
def length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = values.check_length(F.col("text"), 1000).code
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(code == "TYP-11").alias("too_long"), F.count("*").alias("n"))


@registered("SELECT l_returnflag, count(CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN 1 END) AS outside, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = numbers.check_range(F.col("l_quantity").cast("string"), "10", "40").code
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(code == "TYP-09").alias("outside"), F.count("*").alias("n"))


@registered("SELECT o_orderstatus, count(CASE WHEN o_orderkey % 6 = 0 THEN 1 END) AS missing FROM orders GROUP BY o_orderstatus")
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = values.not_null(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))).code
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(code == "NUL-04").alias("missing"))


# ---- rows: a composite dirty table of orders

COLUMNS = ("order_id", "customer", "amount", "order_date", "active", "priority")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_number, fields) with faults dealt by the order key."""
    k = F.col("o_orderkey")
    s = F.col("o_orderstatus")
    cells = [
        k.cast("string"),
        F.concat(F.lit("C "), F.col("o_custkey").cast("string")),
        F.when(k % 10 == 0, "n/k").otherwise(F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2))),
        F.when(k % 13 == 0, "31/31/2026").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")),
        F.when(s == "O", "Y").when(s == "F", "n").otherwise("N"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, " N/A ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))),
    ]
    fields = F.when(k % 29 == 0, F.array(*[F.lit(" ")] * 6)).when(k % 23 == 0, F.array(*cells[:5])).otherwise(F.array(*cells))
    return _table(spark, sf_dir, "orders").select((k + 2).alias("row_number"), fields.alias("fields"))


def order_plan(**policies: object) -> Pipeline:
    money = Step("to_decimal", {"thousands_sep": ",", "currency": True, "accounting_negative": True})
    fields = (
        Field("order_id", "integer", False, source="order_id", steps=(Step("to_int", {}),)),
        Field("customer", "string", source="customer", max_length=40),
        Field("amount", "decimal", scale=2, source="amount", steps=(money,)),
        Field("order_date", "date", source="order_date", steps=(Step("to_date", {"formats": ["%m/%d/%Y"]}),)),
        Field("is_active", "boolean", source="active", steps=(Step("to_bool", {"mapping": {"Y": True, "N": False}}),)),
        Field("priority", "string", False, source="priority"),
    )
    return Pipeline("orders", COLUMNS, fields, Policies(**policies), {"priority": ("N/A",)})


CLASSED = """WITH base AS (SELECT *, o_orderkey AS k, o_orderkey + 2 AS row_number,
    CASE WHEN o_orderkey % 29 = 0 THEN 'blank' WHEN o_orderkey % 23 = 0 THEN 'STR-02' WHEN o_orderkey % 10 = 0 THEN 'TYP-01' WHEN o_orderkey % 13 = 0 THEN 'TYP-03'
      WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'NUL-04' ELSE 'ok' END AS first_code,
    CASE WHEN o_orderkey % 29 = 0 THEN 'blank' WHEN o_orderkey % 23 = 0 THEN 'STR-02' WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'NUL-04' ELSE 'ok' END AS hard_code
  FROM orders) """


@registered(CLASSED + """SELECT CAST(k AS DECIMAL(38,0)) AS order_id, 'C ' || CAST(o_custkey AS VARCHAR) AS customer, CAST(o_totalprice AS DECIMAL(38,2)) AS amount,
  CAST(o_orderdate AS DATE) AS order_date, o_orderstatus = 'O' AS is_active, o_orderpriority AS priority FROM base WHERE first_code = 'ok'""")
def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = order_plan()
    return typed(classify(dirty_orders(spark, sf_dir), plan), plan).drop("row_number")


@registered(CLASSED + """SELECT row_number, CASE first_code WHEN 'blank' THEN 'blank' WHEN 'ok' THEN 'out' ELSE 'quarantined' END AS status,
  CASE WHEN first_code NOT IN ('blank', 'ok') THEN first_code END AS code,
  CASE first_code WHEN 'STR-02' THEN '<row>' WHEN 'TYP-01' THEN 'amount' WHEN 'TYP-03' THEN 'order_date' WHEN 'NUL-04' THEN 'priority' END AS "column" FROM base""")
def disposition_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(dirty_orders(spark, sf_dir), order_plan())
    return rows.select("row_number", "status", F.col("error.code").alias("code"), F.col("error.column").alias("column"))


@registered(CLASSED + """SELECT row_number, CASE hard_code WHEN 'blank' THEN 'blank' WHEN 'ok' THEN 'out' ELSE 'quarantined' END AS status,
  CASE WHEN hard_code NOT IN ('blank', 'ok') THEN hard_code END AS code,
  CASE WHEN hard_code = 'ok' THEN CASE WHEN k % 10 = 0 THEN 'amount:TYP-01;' ELSE '' END || CASE WHEN k % 13 = 0 THEN 'order_date:TYP-03;' ELSE '' END ELSE '' END AS changes FROM base""")
def disposition_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(dirty_orders(spark, sf_dir), order_plan(error_disposition="annotate"))
    changes = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["reason"], F.lit(";"))), "")
    return rows.select("row_number", "status", F.col("error.code").alias("code"), changes.alias("changes"))


@registered(CLASSED + "SELECT min(row_number) AS stop_row, min_by(first_code, row_number) AS code FROM base WHERE first_code NOT IN ('blank', 'ok')")
def disposition_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(dirty_orders(spark, sf_dir), order_plan(error_disposition="fail-fast"))
    return rows.where("status = 'quarantined'").agg(F.min("row_number").alias("stop_row"), F.min_by("error.code", "row_number").alias("code"))


@registered(CLASSED + """, bad AS (SELECT row_number, row_number() OVER (ORDER BY row_number) AS nth FROM base WHERE first_code NOT IN ('blank', 'ok'))
SELECT row_number AS stop_row, 'ERR-02' AS code FROM bad WHERE nth = (SELECT CAST(floor(5.0 * count(*) / 100) AS BIGINT) + 1 FROM base)""")
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = order_plan()
    rows = classify(dirty_orders(spark, sf_dir), plan).select("row_number", "status", "error")
    stop = reports.abort_row(rows, plan, rows.count())
    return spark.createDataFrame([stop] if stop else [], "stop_row long, code string")


@registered(CLASSED + """SELECT first_code AS error_code, CASE first_code WHEN 'STR-02' THEN '<row>' WHEN 'TYP-01' THEN 'amount' WHEN 'TYP-03' THEN 'order_date' ELSE 'priority' END AS "column", count(*) AS n
FROM base WHERE first_code NOT IN ('blank', 'ok') GROUP BY 1, 2""")
def errors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.errors_by_type(classify(dirty_orders(spark, sf_dir), order_plan()))


@registered(CLASSED + """, live AS (SELECT * FROM base WHERE first_code NOT IN ('blank', 'STR-02')), w AS (
  SELECT 'STR-06' AS code, '<row>' AS "column" FROM base WHERE first_code = 'blank'
  UNION ALL SELECT 'TYP-10', 'priority' FROM live WHERE k % 17 <> 0
  UNION ALL SELECT 'NUL-03', 'priority' FROM live WHERE k % 17 <> 0 AND k % 19 = 0
  UNION ALL SELECT 'TYP-10', 'active' FROM live WHERE k % 10 <> 0 AND k % 13 <> 0 AND o_orderstatus = 'F')
SELECT code, "column", count(*) AS n FROM w GROUP BY ALL""")
def warnings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.warnings_by_type(classify(dirty_orders(spark, sf_dir), order_plan()))


@registered(CLASSED + """SELECT CASE WHEN k % 10 = 0 THEN 'amount' END AS field, 'TYP-01' AS reason, count(*) AS n FROM base WHERE hard_code = 'ok' AND k % 10 = 0 GROUP BY 1
UNION ALL SELECT 'order_date', 'TYP-03', count(*) FROM base WHERE hard_code = 'ok' AND k % 13 = 0""")
def annotations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotations_by_type(classify(dirty_orders(spark, sf_dir), order_plan(error_disposition="annotate")))


@registered(CLASSED + """SELECT count(*) AS rows_in, count(CASE WHEN first_code = 'ok' THEN 1 END) AS rows_out, count(CASE WHEN first_code NOT IN ('ok', 'blank') THEN 1 END) AS rows_quarantined,
  CAST(0 AS BIGINT) AS rows_annotated, count(CASE WHEN first_code = 'blank' THEN 1 END) AS rows_blank, CAST(0 AS BIGINT) AS rows_skipped, CAST(0 AS BIGINT) AS rows_dropped FROM base""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(classify(dirty_orders(spark, sf_dir), order_plan()))


@registered(CLASSED + """SELECT row_number, CASE first_code WHEN 'STR-02' THEN '<row>' WHEN 'TYP-01' THEN 'amount' WHEN 'TYP-03' THEN 'order_date' ELSE 'priority' END AS "column",
  CASE first_code WHEN 'TYP-01' THEN 2 WHEN 'TYP-03' THEN 3 WHEN 'NUL-04' THEN 5 END AS column_idx, first_code AS error_code,
  CASE first_code WHEN 'TYP-01' THEN 'n/k' WHEN 'TYP-03' THEN '31/31/2026' END AS offending_value FROM base WHERE first_code NOT IN ('ok', 'blank')""")
def row_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = order_plan()
    return reports.error_records(classify(dirty_orders(spark, sf_dir), plan), plan).drop("message", "csv_line")


@registered("""SELECT o_orderkey + 2 AS row_number, '"x ""' || CAST(o_orderkey AS VARCHAR) || '"", y",' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS csv_line FROM orders""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.sources.sinks import csv_line

    k = F.col("o_orderkey")
    cells = F.array(F.concat(F.lit('x "'), k.cast("string"), F.lit('", y')), F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")))
    return _table(spark, sf_dir, "orders").select((k + 2).alias("row_number"), csv_line(cells).alias("csv_line"))


@registered("SELECT count(CASE WHEN o_orderkey % 31 <> 0 THEN 1 END) AS kept, count(CASE WHEN o_orderkey % 31 = 0 THEN 1 END) AS skipped FROM orders")
def skip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.when(k % 31 == 0, F.concat(F.lit("Total "), k.cast("string"))).otherwise(k.cast("string"))
    rows = _table(spark, sf_dir, "orders").select((k + 2).alias("row_number"), F.array(first).alias("fields"))
    plan = Pipeline("skips", ("id",), (Field("id", "string", source="id"),), skips=(Skip("id", r"\D"),))
    return classify(rows, plan).agg(F.count_if(F.col("status") == "out").alias("kept"), F.count_if(F.col("status") == "skipped").alias("skipped"))


@registered("""SELECT doc_id AS row_number, first AS first_seen_row FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE length(trim(text)) > 0) WHERE doc_id > first""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    rows = rows.select(F.col("doc_id").alias("row_number"), F.array("text").alias("fields"), F.lit(False).alias("blank"))
    return first_seen(rows).where("row_number > first_row").select("row_number", F.col("first_row").alias("first_seen_row"))


@registered("SELECT count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS dropped FROM documents WHERE length(trim(text)) > 0")
def drop_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("row_number"), F.array("text").alias("fields"))
    plan = Pipeline("drop", ("text",), (Field("text", "string", source="text"),), Policies(duplicate_rows="drop_exact"))
    return classify(rows, plan).agg(F.count_if(F.col("status") == "out").alias("kept"), F.count_if(F.col("status") == "duplicate").alias("dropped"))


@registered("SELECT count(CASE WHEN event_id % 8 = 0 THEN 1 END) AS ragged, count(CASE WHEN event_id % 8 <> 0 THEN 1 END) AS fits FROM events")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.col("event_id").cast("string"), F.col("event_type")]
    fields = F.when(F.col("event_id") % 8 == 0, F.array(*cells, F.lit("more"))).otherwise(F.array(*cells))
    rows = _table(spark, sf_dir, "events").select((F.col("event_id") + 2).alias("row_number"), fields.alias("fields"))
    plan = Pipeline("ragged", ("id", "kind"), (Field("id", "string", source="id"), Field("kind", "string", source="kind")))
    return classify(rows, plan).agg(F.count_if(F.col("error.code") == "STR-02").alias("ragged"), F.count_if(F.col("status") == "out").alias("fits"))


@registered("SELECT c_custkey, 'C-' || CAST(c_custkey AS VARCHAR) AS label, 'fixed' AS tag, CAST(NULL AS VARCHAR) AS nothing FROM customer WHERE c_custkey % 5 <> 0")
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select((k + 2).alias("row_number"), F.array(k.cast("string"), "c_name").alias("fields"))
    label = Step("expr", {"python": "rt.skip_if('C-' + row['key'], int(row['key']) % 5 == 0)"})
    fields = (Field("key", "string", source="key"), Field("label", "string", steps=(label,)), Field("tag", "string", steps=(Step("constant", {"value": "fixed"}),)), Field("nothing", "string", filled=False))
    out = classify(rows, Pipeline("exprs", ("key", "name"), fields)).where("status = 'out'")
    return out.select(F.col("out.key").cast("long").alias("c_custkey"), "out.label", "out.tag", "out.nothing")


# ---- profiles


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_orders(spark, sf_dir)
    return profile.unpivot(rows, list(COLUMNS))


FULL = CLASSED + ", live AS (SELECT * FROM base WHERE first_code NOT IN ('blank', 'STR-02')) "


@registered(FULL + """SELECT 5 AS col, count(*) AS n, count(CASE WHEN k % 17 = 0 THEN 1 END) AS empty FROM live
UNION ALL SELECT c, count(*), CAST(0 AS BIGINT) FROM live, (SELECT unnest([0, 1, 2, 3, 4]) AS c) GROUP BY c""")
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_facts(_cells(spark, sf_dir)).select("col", "n", "empty")


@registered(FULL + """SELECT count(CASE WHEN k % 10 <> 0 THEN 1 END) AS currency, count(CASE WHEN k % 10 <> 0 AND o_totalprice >= 1000 THEN 1 END) AS thousands FROM live""")
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = profile.column_facts(_cells(spark, sf_dir).where("col = 2"))
    return f.select(F.col("currency-symbol").alias("currency"), F.col("thousands-separators").alias("thousands"))


@registered(FULL + """SELECT count(*) AS dates, count(CASE WHEN k % 13 <> 0 AND day(o_orderdate) <= 12 THEN 1 END) AS both, count(CASE WHEN k % 13 <> 0 AND day(o_orderdate) > 12 THEN 1 END) AS mdy, CAST(0 AS BIGINT) AS dmy FROM live""")
def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_facts(_cells(spark, sf_dir).where("col = 3")).select(F.col("dm").alias("dates"), "both", "mdy", "dmy")


@registered(FULL + """SELECT 5 AS col, 'N/A' AS t, count(*) AS c FROM live WHERE k % 17 <> 0 AND k % 19 = 0 HAVING count(*) > 0
UNION ALL SELECT 0, CAST(k AS VARCHAR), count(*) FROM live WHERE k IN (9999, 99999, 999999) GROUP BY k""")
def profile_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sentinel_values(_cells(spark, sf_dir))


@registered(FULL + "SELECT CASE o_orderstatus WHEN 'O' THEN 'Y' WHEN 'F' THEN 'n' ELSE 'N' END AS t, count(*) AS c FROM live GROUP BY 1")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(_cells(spark, sf_dir).where("col = 4")).select("t", "c")


@registered(FULL + """SELECT count(*) AS digits, count(DISTINCT k) AS different, CAST(min(length(CAST(k AS VARCHAR))) AS INTEGER) AS narrowest, CAST(max(length(CAST(k AS VARCHAR))) AS INTEGER) AS widest FROM live""")
def profile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_facts(_cells(spark, sf_dir).where("col = 0")).select("digits", "different", "narrowest", "widest")


@registered(CLASSED + """SELECT 'STR-02' AS id, count(*) AS n FROM base WHERE first_code = 'STR-02'
UNION ALL SELECT 'STR-05', count(*) FROM base WHERE k % 29 <> 0
UNION ALL SELECT 'STR-06', count(*) FROM base WHERE k % 29 = 0""")
def profile_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every row twice: blank rows are no duplicates
    rows = dirty_orders(spark, sf_dir)
    once = profile.structure(rows, list(COLUMNS))
    twice = profile.structure(rows.unionByName(rows), list(COLUMNS))
    found = [(f.id, f.count) for f in once if f.id in ("STR-02", "STR-06")] + [(f.id, f.count) for f in twice if f.id == "STR-05"]
    return spark.createDataFrame(found, "id string, n long")


#: Cells of one kind each, dealt by key, and the counts that each kind adds to.
ODD_CELLS = [
    ("a\x07b", ["control"]), ("a\u200bb", ["invisible"]), ("e\u0301", ["denormal"]), ("\u00c3\u00a9", ["mojibake"]), ("=1+2", ["formula"]), ("   ", ["spaces"]), ("", ["empty"]), ("(12)", ["accounting-negative"]),
    ("12%", ["percent-suffix"]), ("0042", ["digits", "leading_zero"]), ("1.234,56", ["european"]), ("2024-01-05 10:00:00", ["naive"]), ("2024-01-05T10:00:00Z", []), ("31/01/2024", ["dm", "dmy"]), ("plain", []),
]
ODD_COUNTS = sorted({c for _, counts in ODD_CELLS for c in counts})


@registered("SELECT " + ", ".join(f"""count(CASE WHEN o_orderkey % {len(ODD_CELLS)} IN ({", ".join(str(i) for i, (_, counts) in enumerate(ODD_CELLS) if c in counts)}) THEN 1 END) AS "{c}\"""" for c in ODD_COUNTS) + " FROM orders")
def profile_odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("o_orderkey") % len(ODD_CELLS)).cast("int")
    cells = _table(spark, sf_dir, "orders").select(F.lit(0).alias("col"), F.col("o_orderkey").alias("row_number"), F.array(*[F.lit(v) for v, _ in ODD_CELLS])[kind].alias("v"))
    return profile.column_facts(cells).select(*[F.col(f"`{c}`") for c in ODD_COUNTS])

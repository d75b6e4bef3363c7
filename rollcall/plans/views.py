"""The canonical inputs as views over the driver's tables, in Spark and in DuckDB.

lineitem rows are votes (part number modulo 400 the division, return flag the
direction), suppliers the roster, orders dates of service, documents and
conversations statements, events pulled records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, LETTERS = "0123456789", "abcdefghij"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def word(n: Column) -> Column:
    return F.translate(F.lpad(n.cast("string"), 9, "0"), DIGITS, LETTERS)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def roster(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).select(
        F.explode(F.array(F.lit("F"), F.lit("O"))).alias("legislature"),
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat(F.lit("Supplier "), word(F.col("s_suppkey"))).alias("name"),
        F.col("r_name").alias("party"),
        F.col("n_name").alias("constituency"),
        F.lit("MP").alias("role"),
        F.when(F.col("s_acctbal") >= 0, "current").otherwise("historical").alias("status"),
        F.col("s_suppkey").alias("seq"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    return roster(spark, d).select("legislature", F.concat_ws(":", "legislature", "id").alias("member_key"), "name", "party", "constituency", "status")


def votes(spark: SparkSession, d: str) -> DataFrame:
    s = suppliers(spark, d).select("s_suppkey", "r_name", "n_name")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    v = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    day = F.col("l_shipdate").cast("date").cast("string")
    direction = F.when(F.col("l_returnflag") == "A", "aye").when(F.col("l_returnflag") == "N", "no").otherwise("no_vote")
    seq = F.concat(*[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 12), ("l_linenumber", 2), ("l_partkey", 10), ("l_suppkey", 8))], day)
    return v.select(
        F.col("l_linestatus").alias("legislature"),
        F.col("l_suppkey").cast("string").alias("member_id"),
        F.concat(F.lit("Supplier "), word(F.col("l_suppkey"))).alias("member_name"),
        F.concat(F.col("l_linestatus"), F.lit(":"), F.col("l_suppkey").cast("string")).alias("member_key"),
        F.col("r_name").alias("party"),
        F.col("n_name").alias("constituency"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 400).cast("string")).alias("division"),
        day.alias("date"),
        F.col("p_name").alias("title"),
        direction.alias("direction"),
        seq.alias("seq"),
        F.col("p_name").alias("motion"),
        F.concat(F.col("l_linestatus"), F.lit(":"), F.col("l_suppkey").cast("string")).alias("member"),
    )


def statements(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("statement_id"), F.col("doc_id").alias("n"), F.lit("speech").alias("dtype"), F.lit(1).alias("kind_order"), "text")
    talks = table(spark, d, "conversations")
    asks = F.coalesce(F.col("role"), F.lit("")) == "user"
    asked = talks.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("statement_id"), F.col("conv_id").alias("n"), F.when(asks, "question").otherwise("answer").alias("dtype"), F.when(asks, 0).otherwise(2).alias("kind_order"), "text")
    n, k = F.col("n"), F.col("n") % 130
    name = (
        F.when(n % 7 == 0, F.lit("The Presiding Officer"))
        .when(n % 11 == 0, F.lit("13:3"))
        .when(n % 5 == 0, F.concat(word(k), F.lit(", Mrs Supplier")))
        .otherwise(F.concat(F.lit("Supplier "), word(k)))
    )
    return docs.unionByName(asked).select(
        "statement_id",
        F.when(n % 2 == 0, "F").otherwise("O").alias("legislature"),
        F.when(n % 3 == 0, k.cast("string")).otherwise("").alias("member_id"),
        name.alias("member_name"),
        F.when(n % 4 == 0, "").otherwise("Own").alias("member_party"),
        F.lit("Area").alias("member_constituency"),
        F.concat(F.lit("m"), k.cast("string")).alias("member"),
        "dtype",
        "kind_order",
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd").alias("date"),
        F.col("statement_id").alias("seq"),
        "text",
    )


def service_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("legislature"), F.col("o_custkey").cast("string").alias("member_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))


def service_divisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("legislature"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


def service_members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("legislature"),
        F.col("c_custkey").cast("string").alias("member_key"),
        F.when(F.col("c_acctbal") >= 0, "current").otherwise("historical").alias("status"),
    )


def pulls(spark: SparkSession, d: str) -> DataFrame:
    """Pulled records: legislature = event type, data type by user, one run a day; a key repeats over runs."""
    kinds = F.array(*[F.lit(x) for x in ("members", "register_of_interests", "questions", "plenary_business", "votes_on_division")])
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("legislature"),
        F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("data_type"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k")).alias("key"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
        F.when(F.col("event_id") % 17 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("member_name"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("text"),
        "ts",
        "value",
    )


_WORD = "translate(lpad(({})::VARCHAR, 9, '0'), '0123456789', 'abcdefghij')"

#: The same views as common table expressions; DuckDB leaves out those a query does not use.
SQL = f"""
roster AS (
  SELECT l.legislature, s_suppkey::VARCHAR AS id, 'Supplier ' || {_WORD.format('s_suppkey')} AS name, r_name AS party, n_name AS constituency,
    'MP' AS role, CASE WHEN s_acctbal >= 0 THEN 'current' ELSE 'historical' END AS status, s_suppkey AS seq
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('F'), ('O')) l(legislature)),
members AS (SELECT legislature, legislature || ':' || id AS member_key, name, party, constituency, status FROM roster),
votes AS (
  SELECT l_linestatus AS legislature, l_suppkey::VARCHAR AS member_id, 'Supplier ' || {_WORD.format('l_suppkey')} AS member_name,
    l_linestatus || ':' || l_suppkey AS member_key, r_name AS party, n_name AS constituency, 'd' || (l_partkey % 400) AS division,
    strftime(l_shipdate, '%Y-%m-%d') AS date, p_name AS title,
    CASE l_returnflag WHEN 'A' THEN 'aye' WHEN 'N' THEN 'no' ELSE 'no_vote' END AS direction,
    lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 10, '0') || lpad(l_suppkey::VARCHAR, 8, '0')
      || strftime(l_shipdate, '%Y-%m-%d') AS seq,
    p_name AS motion, l_linestatus || ':' || l_suppkey AS member
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey),
cast_ AS (SELECT * FROM votes WHERE direction IN ('aye', 'no')),
stated AS (
  SELECT 'd' || doc_id AS statement_id, doc_id AS n, 'speech' AS dtype, 1 AS kind_order, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, conv_id, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END, CASE WHEN role = 'user' THEN 0 ELSE 2 END, text FROM conversations),
statements AS (
  SELECT statement_id, CASE WHEN n % 2 = 0 THEN 'F' ELSE 'O' END AS legislature, CASE WHEN n % 3 = 0 THEN (n % 130)::VARCHAR ELSE '' END AS member_id,
    CASE WHEN n % 7 = 0 THEN 'The Presiding Officer' WHEN n % 11 = 0 THEN '13:3' WHEN n % 5 = 0 THEN {_WORD.format('n % 130')} || ', Mrs Supplier'
      ELSE 'Supplier ' || {_WORD.format('n % 130')} END AS member_name,
    CASE WHEN n % 4 = 0 THEN '' ELSE 'Own' END AS member_party, 'Area' AS member_constituency, 'm' || (n % 130) AS member, dtype, kind_order,
    strftime(DATE '2024-01-01' + (n % 300)::INT, '%Y-%m-%d') AS date, statement_id AS seq, text FROM stated),
service_days AS (
  SELECT o_orderstatus AS legislature, o_custkey::VARCHAR AS member_key, strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS n FROM orders GROUP BY 1, 2, 3),
service_divisions AS (SELECT o_orderstatus AS legislature, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
service_members AS (
  SELECT l.legislature, c_custkey::VARCHAR AS member_key, CASE WHEN c_acctbal >= 0 THEN 'current' ELSE 'historical' END AS status
  FROM customer, (VALUES ('F'), ('O'), ('P')) l(legislature)),
pulls AS (
  SELECT event_type AS legislature, ['members', 'register_of_interests', 'questions', 'plenary_business', 'votes_on_division'][user_id % 5 + 1] AS data_type,
    user_id || '-' || (props::JSON ->> '$.k') AS key, strftime(ts, '%Y-%m-%d') AS run_date,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date, event_id AS seq,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE 'user ' || user_id END AS member_name, CASE WHEN event_type = 'error' THEN '' ELSE props END AS text, ts, value
  FROM events)"""

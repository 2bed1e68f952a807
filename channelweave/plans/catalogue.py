"""The registered queries over the test tables, each with its SQL where there is one.

The tables stand in for clinical ones. E: users, their first sign-up as the anchor, and
their events. T: customers, their first order, and the line items of all their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelweave.functions.columns import binary_entropy, finite, hours_between, seed_of, slug, tidy, topcoded_number, unique_slug
from channelweave.operators import channels, cohort, information, integrity, quantize, resolve, targets
from channelweave.operators.windowed import first_last, labs_window, offset_window, window_join
from channelweave.plans import pid, report, resample, studies
from channelweave.plans.constants import Study
from channelweave.sources.tables import stored, table

STUDY = Study()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = {"A": "accepted", "N": "none", "R": "returned"}
BUCKETS = {"AUTOMOBILE": "goods", "MACHINERY": "goods", "FURNITURE": "home", "HOUSEHOLD": "home"}


def e_cohort(spark: SparkSession, d: str) -> DataFrame:
    signups = table(spark, d, "events").where("event_type = 'signup'")
    return cohort.anchored(cohort.first_episode(signups, "user_id", ["ts", "event_id"]).select("user_id", F.col("ts").alias("t0")), "t0")


def e_window(spark: SparkSession, d: str) -> DataFrame:
    rows = window_join(table(spark, d, "events").drop("props"), e_cohort(spark, d), "user_id", "ts")
    return rows.select("user_id", "event_id", "event_type", "value", hours_between("t0", "ts").alias("hours_from_t0"))


def t_cohort(spark: SparkSession, d: str) -> DataFrame:
    first = cohort.first_episode(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_orderdate").alias("t0"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("outcome"))


def t_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").drop("l_tax", "l_linestatus")


def t_anchors(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their customer's anchor. Items meet its window at their order, so
    that only those within it are dealt by customer."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    return orders.join(t_cohort(spark, d), "custkey")


def t_inside(items: DataFrame, anchors: DataFrame, tolerant: tuple[str, str] | None = None) -> DataFrame:
    """Items from 365 days before their customer's anchor to 365 days after it."""
    start, end = F.expr("c.t0 - INTERVAL 365 DAYS"), F.expr("c.t0 + INTERVAL 365 DAYS")
    return window_join(items, anchors, "l_orderkey", "l_shipdate", start, end, tolerant=tolerant)


def t_window(spark: SparkSession, d: str) -> DataFrame:
    return t_inside(t_items(spark, d), t_anchors(spark, d)).withColumn("hours_from_t0", hours_between("t0", "l_shipdate"))


def t_paired(spark: SparkSession, d: str) -> DataFrame:
    # dealt by customer once: pairs, pivot and people need no other shuffle
    rows = t_window(spark, d).repartition("custkey")
    return first_last(rows, ["custkey", "l_returnflag"], "l_extendedprice", "hours_from_t0", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def t_people(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal", "c_mktsegment", "c_nationkey")
    return t_cohort(spark, d).select("custkey", "outcome").join(people, "custkey")


def t_wide(spark: SparkSession, d: str) -> DataFrame:
    return channels.build_wide(t_paired(spark, d), t_people(spark, d), "custkey", "l_returnflag", NAMES)


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Line items with levels of value (v), time (s), an outcome (y) and a site."""
    items = table(spark, d, "lineitem")
    site = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("site"))
    return items.join(site, "l_suppkey").select(
        "site", "l_linestatus", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("key"),
        F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("v"), (F.month("l_shipdate") % 4).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


E_COHORT = """ec AS (SELECT user_id, ts AS t0 FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type = 'signup') WHERE rn = 1)"""
E_WINDOW = f"""{E_COHORT}, ew AS (SELECT e.user_id, event_id, event_type, value, datesub('second', t0, ts) / 3600.0 AS hours_from_t0
  FROM events e JOIN ec ON e.user_id = ec.user_id AND ts >= t0 - INTERVAL 24 HOUR AND ts < t0 + INTERVAL 24 HOUR)"""
T_COHORT = """tc AS (SELECT o_custkey AS custkey, o_orderkey, o_orderdate AS t0, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1)"""
T_WINDOW = f"""{T_COHORT}, tw AS (SELECT l.*, tc.custkey, tc.t0, datesub('second', t0, l_shipdate) / 3600.0 AS hours_from_t0
  FROM lineitem l JOIN orders o ON l_orderkey = o.o_orderkey JOIN tc ON tc.custkey = o_custkey AND l_shipdate >= t0 - INTERVAL 365 DAY AND l_shipdate < t0 + INTERVAL 365 DAY)"""
_TIE = "l_orderkey {0}, l_linenumber {0}, l_partkey {0}, l_suppkey {0}"
T_PAIRED = f"""{T_WINDOW}, tr AS (SELECT *, row_number() OVER (PARTITION BY custkey, l_returnflag ORDER BY hours_from_t0, {_TIE.format("")}) AS a,
  row_number() OVER (PARTITION BY custkey, l_returnflag ORDER BY hours_from_t0 DESC, {_TIE.format("DESC")}) AS z FROM tw),
  tp AS (SELECT custkey, l_returnflag, max(CASE WHEN a = 1 THEN l_extendedprice END) AS value_first, max(CASE WHEN a = 1 THEN hours_from_t0 END) AS time_first,
  max(CASE WHEN z = 1 THEN l_extendedprice END) AS value_last, max(CASE WHEN z = 1 THEN hours_from_t0 END) AS time_last FROM tr GROUP BY 1, 2)"""
T_PEOPLE = f"{T_PAIRED}, pe AS (SELECT custkey, outcome, c_acctbal, c_mktsegment, c_nationkey FROM tc JOIN customer ON custkey = c_custkey)"
_FOUR = ("value_first", "value_last", "time_first", "time_last")
_VALUES = [f"{n}_{c}" for n in NAMES.values() for c in _FOUR[:2]]
_TIMES = [f"{n}_{c}" for n in NAMES.values() for c in _FOUR[2:]]
T_WIDE = f"""{T_PEOPLE}, wi AS (SELECT pe.*, {", ".join(f"{n}_{c}" for n in NAMES.values() for c in _FOUR)} FROM pe LEFT JOIN
  (SELECT custkey AS k, {", ".join(f"max(CASE WHEN l_returnflag = '{f}' THEN {c} END) AS {n}_{c}" for f, n in NAMES.items() for c in _FOUR)} FROM tp GROUP BY 1) ON k = custkey)"""
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in (*_VALUES, *_TIMES))
LEVELS = """lv AS (SELECT s_nationkey AS site, l_linestatus, CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS v, CAST(month(l_shipdate) % 4 AS INTEGER) AS s,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


# --- cohorts and windows ---


@query("""SELECT o_custkey, o_orderkey, o_orderdate, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
  JOIN customer ON o_custkey = c_custkey WHERE rn = 1 AND c_acctbal >= 1800""")
def first_stay_mimic_order(spark, d):
    first = cohort.first_episode(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return first.join(people, "o_custkey").where("c_acctbal >= 1800").select("o_custkey", "o_orderkey", "o_orderdate", "c_acctbal")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
  WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 180000) WHERE rn = 1""")
def first_stay_filter_before_rank(spark, d):
    eligible = F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") >= 180000)
    return cohort.first_episode(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], eligible).select("o_custkey", "o_orderkey", "o_orderdate")


@query(f"WITH {E_WINDOW} SELECT * FROM ew")
def windowed_labs_halfopen(spark, d):
    return e_window(spark, d)


@query(f"""WITH {E_COHORT} SELECT e.user_id, event_id, event_type, value, datesub('minute', t0, ts) AS offset_minutes, datesub('minute', t0, ts) / 60.0 AS hours_from_t0
  FROM events e JOIN ec ON e.user_id = ec.user_id WHERE datesub('minute', t0, ts) BETWEEN -1440 AND 1440""")
def windowed_labs_closed(spark, d):
    c = e_cohort(spark, d).select("user_id", "t0")
    rows = table(spark, d, "events").join(c, "user_id").withColumn("offset_minutes", F.expr("timestampdiff(MINUTE, t0, ts)"))
    return offset_window(rows, None, "user_id", "offset_minutes").select("user_id", "event_id", "event_type", "value", "offset_minutes", "hours_from_t0")


@query(f"""WITH {T_COHORT}, li AS (SELECT l.*, o_custkey AS custkey, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_orderkey ELSE l_orderkey + 1 END AS hadm_id FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
  SELECT li.custkey, l_orderkey, l_linenumber, l_partkey, hadm_id FROM li JOIN tc ON li.custkey = tc.custkey AND l_shipdate >= t0 - INTERVAL 365 DAY AND l_shipdate < t0 + INTERVAL 365 DAY
  AND (hadm_id IS NULL OR hadm_id = o_orderkey)""")
def null_tolerant_id_match(spark, d):
    n = F.col("l_linenumber") % 3
    items = t_items(spark, d).withColumn("hadm_id", F.when(n == 1, F.col("l_orderkey")).when(n == 2, F.col("l_orderkey") + 1))
    rows = t_inside(items, t_anchors(spark, d), ("hadm_id", "o_orderkey"))
    return rows.select("custkey", "l_orderkey", "l_linenumber", "l_partkey", "hadm_id")


@query(f"""WITH {E_WINDOW}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY hours_from_t0, event_id) AS a,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY hours_from_t0 DESC, event_id DESC) AS z FROM ew)
  SELECT user_id, event_type, max(CASE WHEN a = 1 THEN value END) AS value_first, max(CASE WHEN a = 1 THEN hours_from_t0 END) AS time_first,
  max(CASE WHEN z = 1 THEN value END) AS value_last, max(CASE WHEN z = 1 THEN hours_from_t0 END) AS time_last FROM r GROUP BY 1, 2""")
def paired_first_last(spark, d):
    return first_last(e_window(spark, d), ["user_id", "event_type"], "value", "hours_from_t0", "event_id")


@query(f"WITH {T_PAIRED} SELECT * FROM tp")
def paired_first_last_ties(spark, d):
    return t_paired(spark, d)


# --- which measurements ---


@query(f"""WITH {T_WINDOW} SELECT p_type, count(DISTINCT custkey) AS n_subj, count(DISTINCT custkey) / (SELECT count(DISTINCT custkey) FROM tw)::DOUBLE AS completeness, count(*) AS n_obs,
  count(*) FILTER (WHERE lo IS NOT NULL AND hi IS NOT NULL) / count(*)::DOUBLE AS frac_refrange, count(DISTINCT CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo, hi) END) AS n_distinct_ranges
  FROM (SELECT custkey, l_partkey, CASE WHEN l_discount > 0.02 THEN l_discount END AS lo, CASE WHEN l_quantity < 40 THEN l_quantity END AS hi FROM tw) JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def completeness_scan(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    limits = F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("lo"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("hi")
    rows = stored(t_window(spark, d).select("custkey", "l_partkey", *limits), "window")  # read for the kinds and for the base
    return resolve.completeness(rows.join(kinds, "l_partkey"), "custkey", ["p_type"], base=rows, low="lo", high="hi")


@query(f"""WITH {E_WINDOW} SELECT event_type, count(DISTINCT user_id) AS n_subj, count(DISTINCT user_id) / (SELECT count(*) FROM ec)::DOUBLE AS completeness, count(*) AS n_obs FROM ew GROUP BY 1""")
def completeness_scan_cohort_base(spark, d):
    return resolve.completeness(e_window(spark, d), "user_id", ["event_type"], base=e_cohort(spark, d))


_FLUID = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Urine' ELSE 'Blood' END"


@query(f"""WITH c AS (SELECT p_partkey, lower(p_name) AS label, {_FLUID} AS fluid, (p_partkey % 100) / 100.0::DOUBLE AS completeness, (p_partkey % 13) / 12.0::DOUBLE AS frac FROM part),
  x AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'non_analyte' WHEN p_partkey % 11 = 0 THEN 'derived' WHEN fluid IS NULL OR fluid <> 'Blood' THEN 'non_blood' END AS excluded FROM c)
  SELECT p_partkey, excluded, CASE WHEN excluded IS NULL AND completeness >= 0.95 AND frac >= 0.9 THEN 'core' WHEN excluded IS NULL AND completeness >= 0.02 THEN 'discretionary' END AS role FROM x""")
def classify_roles(spark, d):
    scan = table(spark, d, "part").select("p_partkey", F.expr(_FLUID).alias("fluid"), (F.col("p_partkey") % 100 / F.lit(100.0)).alias("completeness"), (F.col("p_partkey") % 13 / F.lit(12.0)).alias("frac"))
    return resolve.roles(scan, F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 11 == 0, F.col("fluid"), ranged=F.col("frac")).select("p_partkey", "excluded", "role")


@query("""SELECT label, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS ids FROM (SELECT lower(trim(p_name)) AS label, p_partkey FROM part WHERE p_name IS NOT NULL) GROUP BY label HAVING count(DISTINCT p_partkey) > 1""")
def duplicate_labels(spark, d):
    return resolve.duplicate_labels(table(spark, d, "part"), "p_partkey", "p_name").select("label", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH c AS (SELECT p_name, {_FLUID} AS fluid, p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS completeness FROM part),
  x AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'non_analyte' WHEN p_partkey % 11 = 0 THEN 'derived' WHEN fluid IS NULL OR fluid <> 'Blood' THEN 'non_blood' END AS excluded FROM c)
  SELECT excluded, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS labels FROM x WHERE excluded IS NOT NULL AND completeness >= 0.02 GROUP BY 1""")
def excluded_labels(spark, d):
    scan = table(spark, d, "part").select("p_partkey", "p_name", F.expr(_FLUID).alias("fluid"), (F.col("p_partkey") % 100 / F.lit(100.0)).alias("completeness"))
    roles = resolve.roles(scan, F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 11 == 0, F.col("fluid"))
    return resolve.excluded_labels(roles, "p_name").select("excluded", F.array_join("labels", "|").alias("labels"))


# --- columns and targets ---

_AGE = "CASE WHEN c_acctbal > 9000 THEN '> 89' WHEN c_acctbal < 0 THEN '' WHEN c_custkey % 9 = 0 THEN 'unknown' WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(CAST(floor(c_acctbal / 100) AS INTEGER) AS {}) END"


@query(f"SELECT c_custkey, CASE WHEN age = '> 89' THEN 90.0::DOUBLE WHEN trim(age) = '' THEN NULL ELSE try_cast(age AS DOUBLE) END AS age FROM (SELECT c_custkey, {_AGE.format('VARCHAR')} AS age FROM customer)")
def topcoded_age_cast(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_AGE.format("STRING")).alias("age"))
    return rows.select("c_custkey", topcoded_number(F.col("age")).alias("age"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome FROM orders")
def outcome_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", targets.two_way("o_orderstatus", "F").alias("outcome"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS old, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building FROM customer")
def target_twoway(spark, d):
    return table(spark, d, "customer").select("c_custkey", targets.age_target("c_acctbal", 4500).alias("old"), targets.two_way("c_mktsegment", "BUILDING").alias("building"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders")
def target_threeway(spark, d):
    return table(spark, d, "orders").select("o_orderkey", targets.three_way("o_orderstatus", "F", "O").alias("y"))


_BUCKET = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUCKETS.items()) + " END"


def contrast_rows(spark, d):
    dim = spark.createDataFrame(list(BUCKETS.items()), "raw string, bucket string")
    return targets.bucket_contrast(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", dim, "goods", "home", "y")


@query(f"SELECT c_custkey, {_BUCKET} AS bucket, CASE {_BUCKET} WHEN 'goods' THEN 0 WHEN 'home' THEN 1 END AS y FROM customer")
def bucket_contrast(spark, d):
    return contrast_rows(spark, d).select("c_custkey", "bucket", "y")


@query(f"SELECT c_mktsegment, count(*) AS n FROM customer WHERE {_BUCKET} IS NULL GROUP BY 1")
def excluded_counts(spark, d):
    return targets.excluded_counts(contrast_rows(spark, d), "c_mktsegment", "y")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def column_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS plain FROM part)
  SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY plain) > 1 OR regexp_matches(plain, '_[0-9]+$') THEN plain || '_' || p_partkey ELSE plain END AS slug FROM p""")
def unique_column_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", unique_slug("p_name", "p_partkey").alias("slug"))


#: CRC-32 by its polynomial, a bit at a time.
_CRC_BITS = "list_reduce(range(0, 8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
_CRC = f"xor(list_reduce(list_transform(range(1, length(told) + 1), lambda i: ascii(told[i])::BIGINT), lambda c, b: {_CRC_BITS}, 4294967295::BIGINT), 4294967295)"


@query(f"SELECT n_nationkey, {_CRC} AS seed FROM (SELECT n_nationkey, n_name || '|' || n_nationkey || '|3' AS told FROM nation)")
def crc32_seed(spark, d):
    return table(spark, d, "nation").select("n_nationkey", seed_of(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("3")).alias("seed"))


# --- channels ---


@query(f"WITH {T_WIDE} SELECT * FROM wi")
def wide_pivot(spark, d):
    return t_wide(spark, d)


@query(f"WITH {T_WIDE} SELECT custkey, {', '.join([*_VALUES, *_TIMES])}, outcome AS y FROM wi WHERE {_WHOLE}")
def complete_case(spark, d):
    return channels.complete_case(t_wide(spark, d), "custkey", NAMES, "outcome").rows


@query(f"""WITH {T_WIDE}, c AS (SELECT * FROM wi WHERE {_WHOLE}) SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM wi) - (SELECT count(*) FROM c) AS n_dropped,
  round(1.0 - (SELECT count(*) FROM c) / (SELECT count(*) FROM wi)::DOUBLE, 9) AS drop_rate, (SELECT round(avg(outcome), 9) FROM c) AS prevalence""")
def complete_case_meta(spark, d):
    wide = t_wide(spark, d)
    meta = channels.arm_meta(channels.complete_case(wide, "custkey", NAMES, "outcome"), wide)
    return meta.select("n", "n_dropped", F.round("drop_rate", 9).alias("drop_rate"), F.round("prevalence", 9).alias("prevalence"))


@query(f"WITH {T_WIDE} SELECT custkey, {', '.join(f'coalesce({c}, -999.0) AS {c}' for c in _TIMES)}, outcome AS y FROM wi")
def impute_sentinel_time(spark, d):
    return channels.impute(t_wide(spark, d), "custkey", NAMES, "outcome").rows.select("custkey", *_TIMES, "y")


@query(f"WITH {T_WIDE} SELECT custkey, {', '.join(f'round(coalesce({c}, (SELECT avg({c}) FROM wi)), 6) AS {c}' for c in _VALUES)} FROM wi")
def impute_mean_value(spark, d):
    rows = channels.impute(t_wide(spark, d), "custkey", NAMES, "outcome").rows
    return rows.select("custkey", *(tidy(F.col(c)).alias(c) for c in _VALUES))


@query()
def impute_chained(spark, d):
    rows = channels.impute(t_wide(spark, d), "custkey", NAMES, "outcome", "mice").rows
    return rows.select("custkey", *(F.round(c, 3).alias(c) for c in _VALUES), "y")


def outcome_of_balance(spark, d):
    old = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_acctbal") >= 4500).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), old.alias("old"))


@query(f"""WITH {T_WIDE} SELECT custkey, {', '.join([*_VALUES, *_TIMES])}, CASE WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS y FROM wi WHERE {_WHOLE} AND custkey % 7 <> 0""")
def retarget_filter(spark, d):
    arm = channels.complete_case(t_wide(spark, d), "custkey", NAMES, "outcome")
    return channels.retarget(arm, outcome_of_balance(spark, d), "old").rows


@query(f"WITH {T_WIDE} SELECT custkey, {', '.join([*_VALUES, *_TIMES])}, outcome AS y FROM wi WHERE {_WHOLE}")
def retarget_noop(spark, d):
    arm = channels.complete_case(t_wide(spark, d), "custkey", NAMES, "outcome")
    return channels.retarget(arm, t_cohort(spark, d).select("custkey", "outcome"), "outcome").rows


# --- the cohorts of both databases, their lab window and targets, with checks ---

_GENDER = "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END"
_SITE_AGE = "CASE o_custkey % 12 WHEN 0 THEN '> 89' WHEN 1 THEN '' WHEN 2 THEN 'old' ELSE CAST(10 + o_custkey % 60 AS {}) END"
_SITE_GENDER = "CASE o_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END"
_DISCHARGE = "CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'O' THEN 'Alive' ELSE '' END"


def single_site(spark, d):
    """Orders as stays, those of a known status as admissions, customers as patients."""
    orders = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "subject_id", "o_orderkey": "hadm_id"})
    stays = orders.select("subject_id", "hadm_id", F.col("hadm_id").alias("stay_id"), F.col("o_orderdate").alias("intime"), F.expr("o_orderdate + INTERVAL 3 DAYS").alias("outtime"), F.col("o_totalprice").alias("los"))
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.expr("c_custkey % 80 + 10").alias("anchor_age"), F.expr(_GENDER).alias("gender"), F.lit(None).cast("timestamp").alias("dod"))
    known = orders.where("o_orderstatus IN ('F', 'O')")
    admissions = known.select("hadm_id", targets.two_way("o_orderstatus", "F").alias("hospital_expire_flag"), F.col("o_orderpriority").alias("admission_type"), F.col("o_orderstatus").alias("race"))
    return cohort.single_site_cohort(stays, patients, admissions)


SINGLE_SITE = f"""ss AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS stay_id, o_orderdate AS t0, o_totalprice AS icu_los_days, c_custkey % 80 + 10 AS anchor_age, {_GENDER} AS gender,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag, o_orderpriority AS admission_type FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) JOIN customer ON o_custkey = c_custkey
  WHERE rn = 1 AND o_orderstatus IN ('F', 'O') AND c_custkey % 80 + 10 >= 18)"""


@query(f"WITH {SINGLE_SITE} SELECT *, t0 - INTERVAL 24 HOUR AS t_win_start, t0 + INTERVAL 24 HOUR AS t_win_end FROM ss")
def single_site_cohort(spark, d):
    return single_site(spark, d).drop("outtime", "dod", "race")


@query(f"""SELECT o_orderkey AS patientunitstayid, o_custkey AS uniquepid, age, {_SITE_GENDER} AS gender, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag FROM (SELECT *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey % 5, o_orderkey) AS rn FROM (SELECT *, CASE WHEN a = '> 89' THEN 90.0::DOUBLE WHEN trim(a) = '' THEN NULL ELSE try_cast(a AS DOUBLE) END AS age
  FROM (SELECT *, {_SITE_AGE.format("VARCHAR")} AS a FROM orders)) WHERE age >= 18 AND o_orderstatus IN ('F', 'O')) WHERE rn = 1""")
def multi_site_cohort(spark, d):
    patient = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("patientunitstayid"), F.col("o_orderkey").alias("patienthealthsystemstayid"), F.col("o_custkey").alias("uniquepid"), F.expr("o_custkey % 25").alias("hospitalid"),
        F.expr(_SITE_AGE.format("STRING")).alias("age"), F.expr(_SITE_GENDER).alias("gender"), F.col("o_orderpriority").alias("ethnicity"), F.expr(_DISCHARGE).alias("hospitaldischargestatus"),
        F.year("o_orderdate").alias("hospitaldischargeyear"), F.expr("o_orderkey % 5").alias("unitvisitnumber"),
    )
    return cohort.multi_site_cohort(patient).select("patientunitstayid", "uniquepid", "age", "gender", "hospital_expire_flag")


_HADM = "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_orderkey ELSE l_orderkey + 1 END"
_DRAWN = "(l_linenumber * 7 + l_partkey) % 72 - 36"


@query(f"""WITH {SINGLE_SITE}, le AS (SELECT o_custkey AS subject_id, {_HADM} AS hadm, l_linenumber AS specimen_id, l_partkey AS itemid, o_orderdate + to_hours(CAST({_DRAWN} AS INTEGER)) AS charttime, l_quantity AS valuenum
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT ss.subject_id, ss.hadm_id, stay_id, specimen_id, itemid, charttime, valuenum, datesub('second', t0, charttime) / 3600.0 AS hours_from_t0
  FROM le JOIN ss ON le.subject_id = ss.subject_id AND charttime >= t0 - INTERVAL 24 HOUR AND charttime < t0 + INTERVAL 24 HOUR AND (hadm IS NULL OR hadm = ss.hadm_id)""")
def single_site_labs(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"), "o_orderdate")
    labs = table(spark, d, "lineitem").join(orders, "l_orderkey").select(
        "subject_id", F.expr(_HADM).alias("hadm_id"), F.col("l_linenumber").alias("specimen_id"), F.col("l_partkey").alias("itemid"),
        F.expr(f"o_orderdate + make_dt_interval(0, CAST({_DRAWN} AS INT))").alias("charttime"), F.col("l_quantity").alias("valuenum"),
        *(F.lit(None).cast("string").alias(c) for c in ("ref_range_lower", "ref_range_upper", "flag", "priority", "order_provider_id")),
    )
    return labs_window(labs, single_site(spark, d)).select("subject_id", "hadm_id", "stay_id", "specimen_id", "itemid", "charttime", "valuenum", "hours_from_t0")


def demographics(spark, d):
    """The cohort with its race from another table, which has to know every patient."""
    race = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("race"))
    people = integrity.checked_left_join(single_site(spark, d).select("subject_id", "gender", "anchor_age"), race, "subject_id", ["race"])
    return targets.demographic_targets(people, "subject_id", spark.createDataFrame(list(BUCKETS.items()), "raw string, bucket string"), ("goods", "home"))


@query(f"""WITH {SINGLE_SITE} SELECT subject_id, CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS gender_female, CASE WHEN anchor_age >= 65 THEN 1 ELSE 0 END AS age_ge65,
  CASE {_BUCKET} WHEN 'goods' THEN 0 WHEN 'home' THEN 1 END AS race_binary FROM ss JOIN customer ON subject_id = c_custkey""")
def demographic_targets(spark, d):
    return demographics(spark, d)[0]


@query(f"WITH {SINGLE_SITE} SELECT c_mktsegment AS race, count(*) AS n FROM ss JOIN customer ON subject_id = c_custkey WHERE {_BUCKET} IS NULL GROUP BY 1")
def demographic_exclusions(spark, d):
    return demographics(spark, d)[1]


@query(f"""WITH {T_WIDE} SELECT count(*) AS n_cohort, count(*) FILTER (WHERE {_WHOLE}) AS n, count(*) FILTER (WHERE NOT ({_WHOLE})) AS n_dropped, 1 - count(*) FILTER (WHERE {_WHOLE}) / count(*)::DOUBLE AS drop_rate,
  avg(outcome) FILTER (WHERE {_WHOLE}) AS prevalence, count(*) FILTER (WHERE outcome IS NULL) AS target_missing FROM wi""")
def arm_integrity(spark, d):
    _, found = integrity.complete_arm(t_wide(spark, d), "custkey", NAMES, "outcome")
    return spark.createDataFrame([found], "n_cohort long, n long, n_dropped long, drop_rate double, prevalence double, target_missing long")


_SETS = {"whole": _WHOLE, "partial": f"NOT ({_WHOLE})", "goods": f"({_BUCKET}) = 'goods'", "home": f"({_BUCKET}) = 'home'", "expired": "outcome = 1"}


@query(f"""WITH {T_WIDE}, me AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{s}' AS s, custkey FROM wi WHERE {c}" for i, (s, c) in enumerate(_SETS.items()))}), si AS (SELECT i, s, count(DISTINCT custkey) AS n FROM me GROUP BY ALL)
  SELECT x.s AS a, y.s AS b, x.n AS n_a, y.n AS n_b, n_both, n_both = 0 AS disjoint, n_both = x.n AND n_both = y.n AS equal FROM si x JOIN si y ON x.i < y.i,
  LATERAL (SELECT count(DISTINCT p.custkey) AS n_both FROM me p JOIN me q ON p.custkey = q.custkey AND p.i = x.i AND q.i = y.i)""")
def set_overlaps(spark, d):
    return integrity.overlaps(t_wide(spark, d), "custkey", {s: F.expr(c) for s, c in _SETS.items()})


# --- discretisation ---

_Z = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}_z' for c in _Z)} FROM lineitem""")
def zscore_pop(spark, d):
    rows = quantize.zscore(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_Z), list(_Z))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(tidy(F.col(f"{c}_z")).alias(f"{c}_z") for c in _Z))


_REAL = {c: f"CASE WHEN {c} IS NOT NULL THEN {c} END" for c in _TIMES}


@query(f"""WITH {T_WIDE} SELECT custkey, {', '.join(f'round(coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0), 6) + 0.0 AS {c}_z, CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS {c}_real' for c in _TIMES)} FROM wi""")
def zscore_sentinel(spark, d):
    rows = quantize.zscore(channels.impute(t_wide(spark, d), "custkey", NAMES, "outcome").rows, _TIMES, -999.0)
    return rows.select("custkey", *(tidy(F.col(f"{c}_z")).alias(f"{c}_z") for c in _TIMES), *(f"{c}_real" for c in _TIMES))


_CENTRES = [[0.5 if j % 4 == i else 0.0 for j in range(64)] for i in range(4)]


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT vec_id, i, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM e, (SELECT * FROM (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(_CENTRES))}) v(i, c0)) q, LATERAL (SELECT CAST(c0 AS DOUBLE[]) AS c))
  SELECT vec_id, CAST(arg_min(i, (d, i)) AS INTEGER) AS cluster FROM d GROUP BY vec_id""")
def nearest_centroid_assign(spark, d):
    return quantize.nearest_centroid(table(spark, d, "embeddings"), "embedding", _CENTRES).select("vec_id", "cluster")


@query()
def kmeans_levels(spark, d):
    rows = table(spark, d, "embeddings")
    n = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = rows.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)))
    found, _ = quantize.kmeans_levels(rows, [f"x{i}" for i in range(n)], 5)
    return found.select("vec_id", "level")


@query("""SELECT vec_id, CAST(r - 1 AS INTEGER) AS level FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM embeddings GROUP BY label) USING (label)""")
def relabel_by_size(spark, d):
    return quantize.relabel_by_size(table(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", "level")


_RARE = "CASE WHEN l_quantity >= 49.5 THEN 9 WHEN l_quantity >= 48.5 THEN 8 WHEN l_quantity <= 1 THEN 0 ELSE CAST(1 + floor(l_quantity / 10) AS INTEGER) END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, {_RARE} AS u FROM lineitem), n AS (SELECT u, count(*) / sum(count(*)) OVER () AS p FROM l GROUP BY u),
  k AS (SELECT u, CAST(row_number() OVER (ORDER BY u) - 1 AS INTEGER) AS level FROM n WHERE p >= 0.05), m AS (SELECT n.u, arg_min(level, (abs(n.u - k.u), k.u)) AS level FROM n, k GROUP BY n.u)
  SELECT l_orderkey, l_linenumber, l_partkey, level FROM l JOIN m USING (u)""")
def collapse_rare(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_RARE.replace("INTEGER", "INT")).alias("u"))
    return quantize.collapse_rare(rows, "u", 0.05, "level").drop("u")


@query()
def collapse_occupancy(spark, d):
    rows, found = quantize.collapse_for_occupancy(levels(spark, d), "v", "s", "y", min_cell=20)
    return rows.groupBy("v", "s", "y").agg(F.count("*").alias("n")).withColumn("min_share", F.lit(found["min_share"]))


# --- information ---

_JOINT = f"{LEVELS}, jc AS (SELECT site, v, s, y, count(*) AS n FROM lv WHERE v IS NOT NULL AND s IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"


def entropy_sql(cols: str) -> str:
    return f"(SELECT site, -sum(p * ln(p)) AS h, count(*) AS k FROM (SELECT site, sum(n) / sum(sum(n)) OVER (PARTITION BY site) AS p FROM jc GROUP BY {cols}) GROUP BY site)"


_ENT = "".join(f", h_{name} AS {entropy_sql(cols)}" for name, cols in (("v", "site, v"), ("s", "site, s"), ("y", "site, y"), ("vs", "site, v, s"), ("vy", "site, v, y"), ("sy", "site, s, y"), ("vsy", "site, v, s, y")))
_MI = f"""{_JOINT}{_ENT}, mi AS (SELECT t.site, t.n, h_y.h AS h_y, h_v.h + h_y.h - h_vy.h AS i_val, h_s.h + h_y.h - h_sy.h AS i_str, h_vs.h + h_y.h - h_vsy.h AS i_joint,
  h_v.h + h_y.h - h_vy.h + (h_v.k + h_y.k - h_vy.k - 1) / (2.0 * t.n) AS i_val_mm, h_s.h + h_y.h - h_sy.h + (h_s.k + h_y.k - h_sy.k - 1) / (2.0 * t.n) AS i_str_mm,
  h_vs.h + h_y.h - h_vsy.h + (h_vs.k + h_y.k - h_vsy.k - 1) / (2.0 * t.n) AS i_joint_mm
  FROM (SELECT site, CAST(sum(n) AS BIGINT) AS n FROM jc GROUP BY site) t {' '.join(f'JOIN h_{x} ON h_{x}.site = t.site' for x in ('v', 's', 'y', 'vs', 'vy', 'sy', 'vsy'))})"""
_MI_COLS = ("h_y", "i_val", "i_str", "i_joint")


def counts_by_site(spark, d):
    return information.joint_counts(levels(spark, d), ["site"])


@query(f"""WITH {_JOINT}, g AS (SELECT * FROM (SELECT DISTINCT site, v FROM jc) JOIN (SELECT DISTINCT site, s FROM jc) USING (site) JOIN (SELECT DISTINCT site, y FROM jc) USING (site))
  SELECT site, v, s, y, coalesce(n, 0) AS n FROM g LEFT JOIN jc USING (site, v, s, y)""")
def joint_table_dense(spark, d):
    return information.dense(counts_by_site(spark, d), ["site"])


@query(f"""WITH {_JOINT} SELECT 'vy' AS margin, site, v AS level, y, CAST(sum(n) AS BIGINT) AS n FROM jc GROUP BY ALL UNION ALL SELECT 'sy', site, s, y, CAST(sum(n) AS BIGINT) FROM jc GROUP BY ALL""")
def joint_marginals(spark, d):
    c = counts_by_site(spark, d)
    one = lambda x: information.marginal(c, ["site"], [x, "y"]).select(F.lit(f"{x}y").alias("margin"), "site", F.col(x).alias("level"), "y", "n")
    return one("v").unionByName(one("s"))


@query(f"WITH {_MI} SELECT site, n, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in _MI_COLS)} FROM mi")
def plugin_mi(spark, d):
    return information.mutual_information(counts_by_site(spark, d), ["site"]).select("site", "n", *(tidy(F.col(c), 9).alias(c) for c in _MI_COLS))


@query(f"WITH {_MI} SELECT site, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in ('i_val_mm', 'i_str_mm', 'i_joint_mm'))} FROM mi")
def miller_madow_mi(spark, d):
    return information.mutual_information(counts_by_site(spark, d), ["site"]).select("site", *(tidy(F.col(c), 9).alias(c) for c in ("i_val_mm", "i_str_mm", "i_joint_mm")))


@query(f"WITH {LEVELS} SELECT site, round(avg(y), 9) AS prevalence, round(-(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))), 9) AS h, round(100 * 0.01 / -(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))), 6) AS pct FROM lv GROUP BY site")
def binary_entropy_pct(spark, d):
    p = levels(spark, d).groupBy("site").agg(F.avg("y").alias("p"))
    return p.select("site", F.round("p", 9).alias("prevalence"), F.round(binary_entropy(F.col("p")), 9).alias("h"), F.round(information.entropy_share(F.lit(0.01), F.col("p")), 6).alias("pct"))


@query(f"""WITH {_JOINT}, g AS (SELECT * FROM (SELECT DISTINCT site, v FROM jc) JOIN (SELECT DISTINCT site, s FROM jc) USING (site) JOIN (SELECT DISTINCT site, y FROM jc) USING (site)),
  de AS (SELECT site, coalesce(n, 0) AS n FROM g LEFT JOIN jc USING (site, v, s, y)) SELECT site, min(n) AS min_cell, count(*) AS n_cells, count(*) FILTER (WHERE n = 0) AS n_empty_cells, CAST(sum(n) AS BIGINT) AS n FROM de GROUP BY site""")
def occupancy_stats(spark, d):
    return information.occupancy(counts_by_site(spark, d), ["site"])


def atoms_of(spark, d, measure):
    found = pid.decompose(information.joint_counts(levels(spark, d), ["l_linestatus"]), ["l_linestatus"], measure)
    return found.select("l_linestatus", "n", *(F.round(a, 9).alias(a) for a in studies.ATOMS), F.round("i_joint", 9).alias("i_joint"), "min_cell", "converged")


@query("""WITH c AS (SELECT l_orderkey, CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS v, CAST(month(l_shipdate) % 4 AS INTEGER) AS s, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)
  SELECT l_orderkey, count(DISTINCT v) AS n_v, count(DISTINCT s) AS n_s, count(DISTINCT y) AS n_y FROM c GROUP BY 1 HAVING least(count(DISTINCT v), count(DISTINCT s), count(DISTINCT y)) < 2""")
def degenerate_cells(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("v"), (F.month("l_shipdate") % 4).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return pid.degenerate(rows.dropna(subset=["v", "s", "y"]).withColumn("n", F.lit(1)), ["l_orderkey"])


@query()
def broja_atoms(spark, d):
    return atoms_of(spark, d, "broja")


@query()
def ccs_atoms(spark, d):
    return atoms_of(spark, d, "ccs")


def copula_source(spark, d):
    return channels.complete_case(t_wide(spark, d), "custkey", NAMES, "outcome").rows


@query()
def gcmi_atoms(spark, d):
    found = pid.gaussian_pid(copula_source(spark, d), "custkey", _VALUES, _TIMES, boots=STUDY.gaussian_bootstrap_draws)
    return spark.createDataFrame([found])


def line_moments(spark, d):
    """Class moments of line items, returned or not, about the columns' rounded means (so
    that squares of large numbers do not cancel; covariances do not change)."""
    rows = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.array(*(F.col(c).cast("double") for c in _Z)).alias("x"))
    return pid.moments(rows, "key", len(_Z), 0, 0, 0)["all", 0]


@query(f"""SELECT c_custkey, round((rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / (count(*) OVER () + 1), 9) AS u FROM (SELECT c_custkey, floor(c_acctbal / 10) AS b FROM customer)""")
def copula_rank(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 10).alias("b"))
    return information.average_ranks(rows, ["b"], "c_custkey").select("c_custkey", F.round("u", 9).alias("u"))


@query("SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS m_{c}" for c in _Z) + " FROM lineitem GROUP BY 1")
def pooled_class_means(spark, d):
    m = line_moments(spark, d)
    rows = [(c, int(m.n[c]), *(float(x) for x in m.total[c] / m.n[c])) for c in (0, 1)]
    found = spark.createDataFrame(rows, "y int, n long, " + ", ".join(f"m_{c} double" for c in _Z))
    return found.select("y", "n", *(F.round(f"m_{c}", 6).alias(f"m_{c}") for c in _Z))


@query("SELECT " + ", ".join(f"round(sum(c_{a}_{b}) / (sum(n) - 2), 3) AS cov_{a}_{b}" for a in range(3) for b in range(a, 3)) + " FROM (SELECT count(*) AS n, " + ", ".join(f"covar_pop({_Z[a]}, {_Z[b]}) * count(*) AS c_{a}_{b}" for a in range(3) for b in range(a, 3)) + " FROM lineitem GROUP BY l_returnflag = 'R')")
def pooled_cov(spark, d):
    cov = line_moments(spark, d).pooled()
    row = [(f"cov_{a}_{b}", float(cov[a, b])) for a in range(3) for b in range(a, 3)]
    return spark.createDataFrame([tuple(x for _, x in row)], ", ".join(f"{n} double" for n, _ in row)).select(*(F.round(n, 3).alias(n) for n, _ in row))


@query(f"WITH {_MI} SELECT site, round(least(i_val, i_str), 9) + 0.0 AS red, round(i_val - least(i_val, i_str), 9) + 0.0 AS u_val, round(i_str - least(i_val, i_str), 9) + 0.0 AS u_str, round(i_joint - i_val - i_str + least(i_val, i_str), 9) + 0.0 AS syn FROM mi")
def mmi_atoms(spark, d):
    rows = information.mutual_information(counts_by_site(spark, d), ["site"])
    return rows.select("site", *(tidy(c, 9).alias(k) for k, c in information.mmi_atoms(F.col("i_val"), F.col("i_str"), F.col("i_joint")).items()))


# --- nulls and intervals ---

_COUNTS = f"{LEVELS}, ct AS (SELECT l_linestatus, v, s, y, count(*) AS n FROM lv GROUP BY ALL), dr AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS draw)"


def status_counts(spark, d):
    return information.joint_counts(levels(spark, d), ["l_linestatus"])


@query(f"""WITH {_COUNTS} SELECT 'vs' AS margin, l_linestatus, draw, v AS a, s AS b, CAST(sum(n) AS BIGINT) AS n FROM ct, dr GROUP BY ALL
  UNION ALL SELECT 'y', l_linestatus, draw, y, 0, CAST(sum(n) AS BIGINT) FROM ct, dr GROUP BY ALL""")
def perm_null_margins(spark, d):
    t = resample.null_tables(status_counts(spark, d), ["l_linestatus"], "permutation", 3)
    vs = t.groupBy("l_linestatus", "draw", F.col("v").alias("a"), F.col("s").alias("b")).agg(F.sum("n").alias("n")).withColumn("margin", F.lit("vs"))
    y = t.groupBy("l_linestatus", "draw", F.col("y").alias("a")).agg(F.sum("n").alias("n")).withColumns({"b": F.lit(0), "margin": F.lit("y")})
    return vs.unionByName(y)


@query(f"""WITH {_COUNTS} SELECT 'vs' AS margin, l_linestatus, draw, v AS a, s AS b, CAST(sum(n) AS BIGINT) AS n FROM ct, dr GROUP BY ALL
  UNION ALL SELECT 'vy', l_linestatus, draw, v, y, CAST(sum(n) AS BIGINT) FROM ct, dr GROUP BY ALL""")
def cond_null_margins(spark, d):
    t = resample.null_tables(status_counts(spark, d), ["l_linestatus"], "conditional", 3)
    one = lambda m, a, b: t.groupBy("l_linestatus", "draw", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum("n").alias("n")).withColumn("margin", F.lit(m))
    return one("vs", "v", "s").unionByName(one("vy", "v", "y"))


@query()
def perm_null_atoms(spark, d):
    draws = resample.null_draws(status_counts(spark, d), ["l_linestatus"], draws=STUDY.calibration_permutations)
    return draws.select("l_linestatus", "draw", *(F.round(a, 9).alias(a) for a in studies.ATOMS), F.round("i_joint", 9).alias("i_joint"))


@query()
def joint_gate(spark, d):
    c = status_counts(spark, d)
    return resample.joint_gate(c, ["l_linestatus"], information.mutual_information(c, ["l_linestatus"]), STUDY.permutations)


_DRAWS = "SELECT event_type, CAST(event_id % 211 AS INTEGER) AS draw, value AS x FROM events"


@query(f"""WITH d AS ({_DRAWS}), o AS (SELECT event_type, max(value) * 0.8 AS obs FROM events GROUP BY 1), j AS (SELECT d.event_type, CASE WHEN draw % 10 <> 0 THEN x END AS x, obs FROM d JOIN o USING (event_type))
  SELECT event_type, round(any_value(obs), 6) AS observed, round(avg(x), 6) AS null_mean, round(quantile_cont(x, 0.95), 6) AS null_p95, round(quantile_cont(x, 0.975), 6) AS null_p975, round(any_value(obs) - avg(x), 6) AS debiased,
  round((count(*) FILTER (WHERE x >= obs) + 1) / (count(x) + 1)::DOUBLE, 9) AS p, (count(*) FILTER (WHERE x >= obs) + 1) / (count(x) + 1)::DOUBLE <= 0.05 AS gate_pass, count(x) AS n_used, count(*) - count(x) AS n_dropped FROM j GROUP BY 1""")
def null_pvalue(spark, d):
    events = table(spark, d, "events")
    x = F.when(F.col("event_id") % 211 % 10 != 0, F.col("value")).otherwise(float("nan"))
    draws = events.select("event_type", x.alias("x"))
    observed = events.groupBy("event_type").agg((F.max("value") * 0.8).alias("obs"))
    got = resample.p_value(draws, observed, ["event_type"], "x", "obs")
    return got.select("event_type", *(F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_p95", "null_p975", "debiased")), F.round("p", 9).alias("p"), "gate_pass", "n_used", "n_dropped")


@query()
def bootstrap_ci(spark, d):
    draws = resample.bootstrap(copula_source(spark, d), "custkey", _VALUES, _TIMES, ["y"], STUDY.k, STUDY.bootstrap_draws)
    return resample.interval(draws, ["target", "measure"], list(studies.ATOMS))


@query("""SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_sd, round(quantile_cont(value, 0.025), 6) AS value_low, round(quantile_cont(value, 0.5), 6) AS value_median,
  round(quantile_cont(value, 0.975), 6) AS value_high, count(*) AS n_draws FROM events GROUP BY 1""")
def percentile_ci(spark, d):
    got = resample.interval(table(spark, d, "events"), ["event_type"], ["value"])
    return got.select("event_type", *(F.round(f"value_{c}", 6).alias(f"value_{c}") for c in ("mean", "sd", "low", "median", "high")), "n_draws")


# --- studies ---


@query(f"WITH {LEVELS} SELECT site, count(*) AS n FROM lv GROUP BY 1")
def site_value_counts(spark, d):
    return levels(spark, d).groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site")


@query(f"""WITH {LEVELS}, z AS (SELECT y, site, count(*) AS c FROM lv GROUP BY ALL), m AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS m)
  SELECT *, n_eligible >= m AS enough FROM (SELECT y, m, count(*) FILTER (WHERE c >= 3000 // m) AS n_eligible FROM z, m GROUP BY y, m)""")
def eligible_sites_per_m(spark, d):
    return studies.eligible_sites(levels(spark, d), "site", [1, 2, 4, 8, 16, 32], 3000, ["y"])


@query(f"WITH {_MI} SELECT site, n, round(i_joint, 9) + 0.0 AS i_joint, round(i_joint_mm, 9) + 0.0 AS i_joint_mm FROM mi")
def site_mi(spark, d):
    return studies.site_information(levels(spark, d), "site").select("site", "n", tidy(F.col("i_joint"), 9).alias("i_joint"), tidy(F.col("i_joint_mm"), 9).alias("i_joint_mm"))


def effect_rows(spark, d):
    """A table of site results made from nations: sizes and percentages."""
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), *(F.avg((F.col("c_acctbal") + 1000 * i) / 100).alias(f"in_{a}") for i, a in enumerate(studies.ATOMS)))
    return n.withColumns({f"rand_{a}": F.col(f"in_{a}") / 2 + i for i, a in enumerate(studies.ATOMS)}).withColumn("region", F.col("c_nationkey") % 5)


_EFFECT = (
    "WITH n AS (SELECT c_nationkey, c_nationkey % 5 AS region, count(*) AS n, " + ", ".join(f"avg((c_acctbal + {1000 * i}) / 100) AS in_{a}" for i, a in enumerate(studies.ATOMS)) + " FROM customer GROUP BY 1), "
    "r AS (SELECT *, " + ", ".join(f"in_{a} / 2 + {i} AS rand_{a}" for i, a in enumerate(studies.ATOMS)) + " FROM n) SELECT region, count(*) AS n_sites, CAST(trunc(median(n)) AS INTEGER) AS median_n, "
    + ", ".join(f"round(sum(in_{a} * n) / sum(n), 6) AS within_{a}, round(sum(rand_{a} * n) / sum(n), 6) AS random_{a}, round(sum(in_{a} * n) / sum(n) - sum(rand_{a} * n) / sum(n), 6) AS delta_{a}" for a in studies.ATOMS)
    + " FROM r GROUP BY region"
)


@query(_EFFECT)
def weighted_pooling_effect(spark, d):
    got = studies.pooling_effect(effect_rows(spark, d), ["region"], "c_nationkey")
    return got.select("region", "n_sites", "median_n", *(F.round(f"{k}_{a}", 6).alias(f"{k}_{a}") for a in studies.ATOMS for k in ("within", "random", "delta")))


@query(f"WITH {LEVELS} SELECT site, least(count(*), 50) AS n FROM lv GROUP BY site")
def size_matched_draws(spark, d):
    return resample.resample_without_replacement(levels(spark, d), ["site"], 50, 7, "key").groupBy("site").agg(F.count("*").alias("n"))


@query(f"""WITH {_MI}, h AS (SELECT unnest(['broja', 'ccs']) AS measure) SELECT site, 'y' AS target, measure, n, round(i_joint, 9) + 0.0 AS i_joint, round(i_joint_mm, 9) + 0.0 AS i_joint_mm FROM mi, h""")
def headline_cells(spark, d):
    got = studies.headline(levels(spark, d), ["y"], ["site"], STUDY.measures)
    return got.select("site", "target", "measure", "n", tidy(F.col("i_joint"), 9).alias("i_joint"), tidy(F.col("i_joint_mm"), 9).alias("i_joint_mm"))


@query()
def headline_atoms(spark, d):
    got = studies.headline(levels(spark, d), ["y"], ["site"], STUDY.measures)
    return got.select("site", "target", "measure", "n", *(tidy(F.col(a), 9).alias(a) for a in studies.ATOMS), "converged")


@query()
def headline_gated(spark, d):
    rows = levels(spark, d)
    counts = information.joint_counts(studies.by_target(rows, ["y"], ["site"]), ["site", "target"]).persist()
    got = studies.with_gate(pid.decompose(counts, ["site", "target"], "broja"), counts, ["site", "target"], STUDY.permutations, level=STUDY.level)
    return got.select("site", "target", "n", *(tidy(F.col(f"{a}_pct"), 6).alias(f"{a}_pct") for a in studies.ATOMS), F.round("p", 9).alias("p"), "gate_pass", "n_used")


def two_targets(spark, d):
    """Line items with two outcomes; the line's status stands for the database."""
    items = table(spark, d, "lineitem")
    return items.select(
        "l_linestatus", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("v"), (F.month("l_shipdate") % 4).alias("s"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.when(F.col("l_tax") > 0, (F.col("l_discount") >= 0.05).cast("int")).alias("discounted"),
    )


_NODE = lambda name, over: f"{name} AS (SELECT db, target, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY db, target) AS t FROM (SELECT db, target, {over}, sum(n) AS n FROM c GROUP BY ALL)) GROUP BY 1, 2)"
_SIDE = ", ".join(f"round(max(CASE WHEN db = '{x}' THEN {a} END), 6) + 0.0 AS {n}_{a}" for n, x in (("first", "F"), ("second", "O")) for a in ("red", "u_val", "u_str", "syn"))
_APART = ", ".join(f"round(max(CASE WHEN db = 'F' THEN {a} END) - max(CASE WHEN db = 'O' THEN {a} END), 6) + 0.0 AS gap_{a}" for a in ("red", "u_val", "u_str", "syn"))


@query(f"""WITH b AS (SELECT l_linestatus AS db, CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS v, month(l_shipdate) % 4 AS s, CAST(l_returnflag = 'R' AS INTEGER) AS returned,
  CASE WHEN l_tax > 0 THEN CAST(l_discount >= 0.05 AS INTEGER) END AS discounted FROM lineitem),
  r AS (SELECT db, 'returned' AS target, v, s, returned AS y FROM b UNION ALL SELECT db, 'discounted', v, s, discounted FROM b WHERE discounted IS NOT NULL),
  c AS (SELECT db, target, v, s, y, count(*) AS n FROM r GROUP BY ALL), {", ".join(_NODE(f"h_{o.replace(', ', '')}", o) for o in ("v", "s", "y", "v, y", "s, y", "v, s", "v, s, y"))},
  i AS (SELECT db, target, h_v.h + h_y.h - h_vy.h AS iv, h_s.h + h_y.h - h_sy.h AS si, h_vs.h + h_y.h - h_vsy.h AS ij FROM h_v JOIN h_s USING (db, target) JOIN h_y USING (db, target) JOIN h_vy USING (db, target)
    JOIN h_sy USING (db, target) JOIN h_vs USING (db, target) JOIN h_vsy USING (db, target)),
  a AS (SELECT db, target, 100 * least(iv, si) / ij AS red, 100 * (iv - least(iv, si)) / ij AS u_val, 100 * (si - least(iv, si)) / ij AS u_str, 100 * (ij - iv - si + least(iv, si)) / ij AS syn FROM i)
  SELECT target, {_SIDE}, {_APART} FROM a GROUP BY target""")
def headline_across(spark, d):
    cells = studies.headline(two_targets(spark, d), ["returned", "discounted"], ["l_linestatus"], ("mmi",))
    got = studies.across(cells, "l_linestatus", ["target"], "F", "O")
    return got.select("target", *(tidy(F.col(c)).alias(c) for c in got.columns if c.startswith(("first_", "second_", "gap_"))))


@query(f"""WITH {_JOINT}, w AS (SELECT site, sum(n) AS n, sum(CASE WHEN y = 1 THEN n END) AS n1 FROM jc GROUP BY site),
  p AS (SELECT site % 5 AS region, 100.0 * sum(n1) / sum(n) AS pooled, avg(100.0 * n1 / n) AS within, max(100.0 * n1 / n) + 3 AS other FROM w GROUP BY 1)
  SELECT region, round(pooled, 6) AS pooled, round(within, 6) AS within, round(other, 6) AS other, round(other - pooled, 6) AS gap, CASE WHEN abs(other - pooled) >= 2 THEN round((within - pooled) / (other - pooled), 6) + 0.0 END AS closed FROM p""")
def gap_closed(spark, d):
    sites = counts_by_site(spark, d).groupBy("site").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("n1")).withColumn("region", F.col("site") % 5)
    share = F.lit(100.0) * F.col("n1") / F.col("n")
    pooled = sites.groupBy("region").agg((F.lit(100.0) * F.sum("n1") / F.sum("n")).alias("x"))
    got = studies.gap_closed(pooled, sites.groupBy("region").agg(F.avg(share).alias("x")), sites.groupBy("region").agg((F.max(share) + 3).alias("x")), ["region"], "x", STUDY.least_gap)
    return got.select("region", *(tidy(F.col(c)).alias(c) for c in ("pooled", "within", "other", "gap", "closed")))


@query("""WITH o AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS x FROM events GROUP BY ALL), a AS (SELECT event_type, avg(x) AS m, stddev_samp(x) AS s, arg_min(x, seed) AS f FROM o GROUP BY 1),
  n AS (SELECT event_type, avg(value) AS m, quantile_cont(value, 0.95) AS q, max(value) AS x, count(value) AS k, count(*) - count(value) AS g FROM events GROUP BY 1)
  SELECT event_type, round(a.m, 6) AS obs_mean, round(a.s, 6) AS obs_sd, round(a.f, 6) AS obs_first, round(n.m, 6) AS null_mean, round(n.q, 6) AS null_p95, round(n.x, 6) AS null_max, n.k AS n_ok, n.g AS n_dropped, round(a.m - n.m, 6) + 0.0 AS debiased FROM a JOIN n USING (event_type)""")
def null_calibration(spark, d):
    events = table(spark, d, "events")
    seen = events.groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("value"))
    got = resample.calibration(seen, events.select("event_type", "value"), ["event_type"], "value")
    return got.select("event_type", *(tidy(F.col(c)).alias(c) for c in ("obs_mean", "obs_sd", "obs_first", "null_mean", "null_p95", "null_max")), "n_ok", "n_dropped", tidy(F.col("debiased")).alias("debiased"))


@query("""WITH c AS (SELECT l_partkey % 7 AS k, l_linestatus AS a, avg(l_discount) AS m FROM lineitem GROUP BY ALL), s AS (SELECT k, max(CASE WHEN a = 'F' THEN m END) * 1000 AS fixed_syn, max(CASE WHEN a = 'O' THEN m END) * 1000 AS collapse_syn FROM c GROUP BY k)
  SELECT k, round(fixed_syn, 6) AS fixed_syn, round(collapse_syn, 6) AS collapse_syn, round(collapse_syn - fixed_syn, 6) + 0.0 AS shift, abs(collapse_syn - fixed_syn) > 1 AS shifted,
  coalesce(k = (SELECT min(k) FROM s WHERE abs(collapse_syn - fixed_syn) > 1), false) AS first_shift FROM s""")
def collapse_shift(spark, d):
    arms = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 7).alias("k"), F.when(F.col("l_linestatus") == "F", "fixed").otherwise("collapse").alias("arm"))
    spread = arms.agg((F.avg("l_discount") * 1000).alias("syn_mean"), F.stddev_pop("l_discount").alias("worst_sd"))
    got = studies.collapse_verdict(spread)
    return got.select("k", *(tidy(F.col(c)).alias(c) for c in ("fixed_syn", "collapse_syn", "shift")), "shifted", "first_shift")


@query()
def within_site_atoms(spark, d):
    got = studies.within_sites(levels(spark, d), "site", "key", least=100, draws=len(STUDY.seeds))
    return got.select("site", "n", *(F.round(f"{k}_{a}", 6).alias(f"{k}_{a}") for k in ("in", "rand") for a in studies.ATOMS))


@query()
def dose_response(spark, d):
    return studies.dose_response(levels(spark, d), "site", "key", list(STUDY.pooled_sites), STUDY.pooled_rows, STUDY.pooled_draws)


@query(f"""WITH {LEVELS}, z AS (SELECT site, count(*) AS c FROM lv WHERE v IS NOT NULL AND s IS NOT NULL AND y IS NOT NULL GROUP BY site), m AS (SELECT CAST(unnest({list(STUDY.pooled_sites)}) AS INTEGER) AS m),
  ok AS (SELECT m FROM z, m GROUP BY m HAVING count(*) FILTER (WHERE c >= {STUDY.pooled_rows} // m) >= m)
  SELECT m, CAST(unnest(range({STUDY.pooled_draws})) AS INTEGER) AS draw, m AS n_sites, CAST(m * ({STUDY.pooled_rows} // m) AS BIGINT) AS n FROM ok""")
def dose_set_sizes(spark, d):
    picked = studies.dose_sets(counts_by_site(spark, d), "site", list(STUDY.pooled_sites), STUDY.pooled_rows, STUDY.pooled_draws)
    return picked.groupBy("m", "draw").agg(F.count_distinct("site").cast("int").alias("n_sites"), F.sum("n").alias("n"))


_TREND = "SELECT l_returnflag AS target, CAST(power(2, l_linenumber) AS DOUBLE) AS m, avg(l_extendedprice) AS u_str FROM lineitem GROUP BY l_returnflag, l_linenumber"


def trend_rows(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("target"), F.pow(F.lit(2.0), "l_linenumber").alias("m")).agg(F.avg("l_extendedprice").alias("u_str"))


@query(f"""WITH t AS ({_TREND}) SELECT target, count(*) AS n_points, round(regr_slope(u_str, log2(m)), 6) AS slope, round(arg_min(u_str, m), 6) AS first_mean, round(arg_max(u_str, m), 6) AS last_mean,
  round((arg_min(u_str, m) - arg_max(u_str, m)) / arg_min(u_str, m) * 100, 6) + 0.0 AS pct_removed FROM t GROUP BY target""")
def dose_slope(spark, d):
    got = studies.trend(trend_rows(spark, d), ["target"], "m", "u_str")
    return got.select("target", "n_points", *(tidy(F.col(c)).alias(c) for c in ("slope", "first_mean", "last_mean", "pct_removed")))


@query(f"""WITH t AS ({_TREND}), r AS (SELECT target, rank() OVER (PARTITION BY target ORDER BY m) AS a, rank() OVER (PARTITION BY target ORDER BY u_str) AS b FROM t)
  SELECT target, round(corr(a, b), 6) + 0.0 AS rho FROM r GROUP BY target""")
def spearman_rho(spark, d):
    return studies.trend(trend_rows(spark, d), ["target"], "m", "u_str").select("target", tidy(F.col("rho")).alias("rho"))


@query(f"""WITH t AS ({_TREND}), c AS (SELECT * FROM t, (SELECT CAST(unnest([2, 4, 8, 16]) AS INTEGER) AS start) WHERE m >= start)
  SELECT target, start, count(*) AS n_points, round(regr_slope(u_str, log2(m)), 6) AS slope, regr_slope(u_str, log2(m)) < 0 AS falling FROM c GROUP BY ALL HAVING count(DISTINCT m) >= 3""")
def truncated_trend_slopes(spark, d):
    cut = studies.truncated_trends(trend_rows(spark, d), ["target"], "m", "u_str", [2, 4, 8, 16])
    return cut.select("target", "start", "n_points", F.round("slope", 6).alias("slope"), "falling")


@query()
def truncated_trend_verdict(spark, d):
    cut = studies.truncated_trends(trend_rows(spark, d), ["target"], "m", "u_str", [2, 4, 8, 16])
    return studies.trend_verdict(cut, ["target"])


@query("""WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, l_extendedprice AS x FROM lineitem), g AS (SELECT avg(x) AS g FROM r), ma AS (SELECT a, avg(x) AS m FROM r GROUP BY a), mb AS (SELECT b, avg(x) AS m FROM r GROUP BY b),
  mc AS (SELECT a, b, avg(x) AS m FROM r GROUP BY a, b), s AS (SELECT sum((ma.m - g) ** 2) AS s0, sum((mb.m - g) ** 2) AS s1, sum((mc.m - ma.m - mb.m + g) ** 2) AS s2, sum((x - mc.m) ** 2) AS s3
  FROM r JOIN ma USING (a) JOIN mb USING (b) JOIN mc USING (a, b), g)
  SELECT source, round(ss / 1e6, 3) AS ss_m, round(100 * ss / (s0 + s1 + s2 + s3), 6) AS pct FROM s, LATERAL (VALUES ('l_returnflag', s0), ('l_linestatus', s1), ('interaction', s2), ('residual', s3)) v(source, ss)""")
def two_way_anova_ss(spark, d):
    got = studies.two_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")
    return got.select("source", F.round(F.col("ss") / 1e6, 3).alias("ss_m"), F.round("pct", 6).alias("pct"))


@query("""WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, l_extendedprice AS x FROM lineitem), g AS (SELECT avg(x) AS g FROM r), ma AS (SELECT a, avg(x) AS m FROM r GROUP BY a), mb AS (SELECT b, avg(x) AS m FROM r GROUP BY b),
  mc AS (SELECT a, b, avg(x) AS m, count(*) AS n FROM r GROUP BY a, b), s AS (SELECT sum((ma.m - g) ** 2) AS s0, sum((mb.m - g) ** 2) AS s1, sum((mc.m - ma.m - mb.m + g) ** 2) AS s2, sum((x - mc.m) ** 2) AS s3, count(*) AS n
  FROM r JOIN ma USING (a) JOIN mb USING (b) JOIN mc USING (a, b), g), k AS (SELECT (SELECT count(*) FROM ma) AS na, (SELECT count(*) FROM mb) AS nb, (SELECT min(n) = max(n) FROM mc) AS balanced)
  SELECT source, CAST(df AS BIGINT) AS df, CASE WHEN source <> 'residual' THEN round(ss / df / (s3 / (n - na * nb)), 6) END AS f, balanced
  FROM s, k, LATERAL (VALUES ('l_returnflag', s0, na - 1), ('l_linestatus', s1, nb - 1), ('interaction', s2, (na - 1) * (nb - 1)), ('residual', s3, n - na * nb)) v(source, ss, df)""")
def two_way_anova_f(spark, d):
    got = studies.two_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")
    return got.select("source", "df", F.round("f", 6).alias("f"), "balanced")


@query()
def two_way_anova_tests(spark, d):
    got = studies.two_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")
    return got.select("source", "df", F.round("f", 6).alias("f"), F.round("p", 9).alias("p"), "balanced")


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m, max(l_extendedprice) - min(l_extendedprice) AS span FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, round(max(CASE WHEN l_linestatus = 'F' THEN m END), 6) AS first_mean, round(max(CASE WHEN l_linestatus = 'O' THEN m END), 6) AS second_mean, round(max(span), 6) AS seed_span,
  round(max(CASE WHEN l_linestatus = 'F' THEN m END) - max(CASE WHEN l_linestatus = 'O' THEN m END), 6) + 0.0 AS gap FROM c GROUP BY 1""")
def main_effects_gap(spark, d):
    got = studies.main_effects(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "l_extendedprice", "F", "O")
    return got.select("l_returnflag", *(tidy(F.col(c)).alias(c) for c in ("first_mean", "second_mean", "seed_span", "gap")))


@query("SELECT arg_min(n_name, (s, n_name)) AS least, arg_min(n_name, (-s, n_name)) AS most FROM (SELECT n_name, sum(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def argmin_argmax_label(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return studies.most_and_least(table(spark, d, "customer").join(n, "c_nationkey").groupBy("n_name").agg(F.sum("c_acctbal").alias("s")), "n_name", "s")


@query()
def k_sweep(spark, d):
    sweep = studies.k_sweep(copula_source(spark, d), "custkey", _VALUES, _TIMES, "y", list(STUDY.ks), list(STUDY.seeds), STUDY.starts)
    return studies.sweep_spread(sweep)


@query(f"""WITH {_MI}, g AS (SELECT site, min(n) AS min_cell FROM jc GROUP BY site) SELECT mi.site, n, round(i_joint, 9) + 0.0 AS i_joint, round(i_joint_mm, 9) + 0.0 AS corrected_i_joint_mm, min_cell AS least_min_cell FROM mi LEFT JOIN g USING (site)""")
def results_report_join(spark, d):
    c = counts_by_site(spark, d)
    mi = information.mutual_information(c, ["site"])
    head = mi.select("site", "n", tidy(F.col("i_joint"), 9).alias("i_joint"))
    least = c.groupBy("site").agg(F.min("n").alias("min_cell"))
    return report.join_results(["site"], head, corrected=mi.select("site", tidy(F.col("i_joint_mm"), 9).alias("i_joint_mm")), least=least)


@query("SELECT c_custkey, CASE WHEN isfinite(x) THEN x END AS x FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE c_acctbal END AS x FROM customer)")
def finite_or_null(spark, d):
    n = F.col("c_custkey") % 4
    x = F.when(n == 0, float("nan")).when(n == 1, float("inf")).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", finite(x).alias("x"))

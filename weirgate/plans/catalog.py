"""Registered queries over the operators, each with the same in DuckDB SQL where SQL can say it.

The driver's tables stand in for forms, postings and resumes: documents are postings and resume texts, pages saved
pages, events the log of applications, lineitem controls of forms, conversations lines in order. Inputs that have no
stand-in are small inline tables, written once for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.functions import vocab as V
from weirgate.operators import decisions, history, matching, postings, resume
from weirgate.plans import fill_plan
from weirgate.sources import forms
from weirgate.sources import postings as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "[" + ", ".join(map(quoted, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


class Inline:
    """A small table, as a DataFrame and as SQL."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in self.rows) + f") t({', '.join(self.names)})"


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# ---- the history: events as a log, user_id as url, event_type as status -------------------------------------------

_UPSERT = "SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, max_by(event_type, (ts, event_id)) AS status, max_by(value, (ts, event_id)) AS value, max_by(strftime(ts, '%Y-%m-%d %H:%M:%S'), (ts, event_id)) AS applied_at FROM events GROUP BY user_id"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.col("event_type").alias("first_type"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("applied_at"))
    return history.upsert(log, "user_id", ["ts", "event_id"], ["first_type"], ["status", "value", "applied_at"])


@query(_UPSERT)
def history_upsert(spark, sf_dir):
    return _history(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({_UPSERT}) GROUP BY status")
def status_summary(spark, sf_dir):
    return history.summary(_history(spark, sf_dir))


@query(f"SELECT applied_at, first_type AS source, status, value, user_id AS url FROM ({_UPSERT})")
def history_export(spark, sf_dir):
    rows = _history(spark, sf_dir).withColumnsRenamed({"user_id": "url", "first_type": "source"})
    return history.export(rows, ["applied_at", "source", "status", "value", "url"])


_STATUS = "CASE event_type WHEN 'purchase' THEN 'filled' WHEN 'view' THEN 'skipped_by_policy' WHEN 'click' THEN 'skipped_no_match' ELSE 'skipped_no_value' END"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "purchase", "filled").when(e == "view", "skipped_by_policy").when(e == "click", "skipped_no_match").otherwise("skipped_no_value")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", status.alias("status"), (F.col("value") > 50).alias("required"))


@query(f"SELECT user_id, count(*) FILTER (s = 'filled') AS filled, count(*) FILTER (s <> 'filled') AS review, count(*) FILTER (s <> 'filled' AND value > 50) AS required_gaps, count(*) FILTER (s = 'skipped_by_policy') AS by_policy, count(*) FILTER (s = 'skipped_no_match') AS no_match FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id")
def plan_counts(spark, sf_dir):
    return history.status_counts(_matches(spark, sf_dir), ["user_id"])


@query(f"""SELECT user_id, count(*) FILTER (s = 'filled') AS ready, count(*) FILTER (s = 'skipped_by_policy') AS yours, count(*) FILTER (s = 'skipped_no_value') AS gaps,
CAST(0 AS BIGINT) AS failed, count(*) FILTER (s = 'skipped_no_match') AS unknown FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id""")
def plan_summary(spark, sf_dir):
    return history.plan_summary(_matches(spark, sf_dir), ["user_id"])


@query(f"""SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (s <> 'filled' AND value > 50), '') AS gaps
FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id""")
def required_gaps(spark, sf_dir):
    found = history.required_gaps(_matches(spark, sf_dir), ["user_id"], "event_type", "event_id")
    return found.select("user_id", joined("gaps", ",").alias("gaps"))


@query(f"""WITH m AS (SELECT user_id, event_id, event_type, event_type || ' ' || hour(ts) AS label, {_STATUS} AS s FROM events),
f AS (SELECT user_id, s, label, min(event_id) AS e FROM m GROUP BY ALL),
k AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS keys FROM (SELECT DISTINCT user_id, event_type FROM m WHERE s = 'skipped_no_value') GROUP BY user_id)
SELECT user_id, coalesce(string_agg(label, '|' ORDER BY e) FILTER (s = 'skipped_by_policy'), '') AS yours,
coalesce(string_agg(label, '|' ORDER BY e) FILTER (s = 'skipped_no_value'), '') AS gaps, coalesce(any_value(keys), '') AS keys FROM f LEFT JOIN k USING (user_id) GROUP BY user_id""")
def next_steps(spark, sf_dir):
    rows = _matches(spark, sf_dir).withColumn("label", F.concat_ws(" ", "event_type", F.hour("ts")))
    steps = history.next_steps(rows, ["user_id"], "label", "event_id", "event_type")
    return steps.select("user_id", joined("yours").alias("yours"), joined("gaps").alias("gaps"), joined("keys", ",").alias("keys"))


@query(f"""SELECT user_id, CASE WHEN len(g) > 0 THEN 'needs_review' ELSE 'submitted' END AS gate, len(g) AS n_gaps, array_to_string(g[1:5], ', ') AS first_gaps
FROM (SELECT user_id, coalesce(list(event_type ORDER BY event_id) FILTER (s <> 'filled' AND value > 50), []) AS g FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id)""")
def submit_gate(spark, sf_dir):
    return history.submit_gate(_matches(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type || ':' || hour(ts) AS signature, row_number() OVER (PARTITION BY user_id, event_type, hour(ts) ORDER BY ts, event_id) AS nth FROM events)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(signature, (ts, event_id)) AS signature FROM s WHERE nth = 2 GROUP BY user_id""")
def step_repeat(spark, sf_dir):
    sign = F.concat_ws(":", "event_type", F.hour("ts"))
    return decisions.first_repeat(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], sign).select("user_id", "event_id", "signature")


@query("SELECT event_id, user_id FROM events WHERE event_type LIKE '%c%' ORDER BY ts DESC, event_id LIMIT 12")
def recent_topk(spark, sf_dir):
    return sources.newest(table(spark, sf_dir, "events"), "c", 12, "event_type", "ts", "event_id").select("event_id", "user_id")


# ---- look-ups and joins ------------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))")
def seen_anti_join(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("status"))
    return history.unseen(table(spark, sf_dir, "customer"), seen, "c_custkey", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 300000) ORDER BY o_orderkey LIMIT 10")
def skip_then_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    seen = orders.where("o_totalprice > 300000").select("o_custkey", F.col("o_orderstatus").alias("status"))
    return history.first_unseen(orders, seen, "o_custkey", 10, "o_orderkey", retry=("F",)).select("o_orderkey", "o_custkey")


_JOBS = "list({'company': o_orderpriority, 'title': o_orderstatus, 'ends': CASE WHEN o_orderstatus = 'O' THEN 'Present' ELSE strftime(o_orderdate, '%Y') END} ORDER BY o_orderkey)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resumes, their orders as positions."""
    end = F.when(F.col("o_orderstatus") == "O", "Present").otherwise(F.date_format("o_orderdate", "yyyy"))
    job = F.struct("o_orderkey", F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.lit("").alias("location"), F.lit("").alias("start_date"), end.alias("end_date"), F.lit("").alias("description"))
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.sort_array(F.collect_list(job)), lambda x: x.dropFields("o_orderkey")).alias("positions"))
    rows = table(spark, sf_dir, "customer").join(jobs.hint("merge"), "c_custkey", "left")
    blank = {c: F.lit("") for c in ("phone", "address_line1", "state", "postal_code", "country", "linkedin_url", "github_url", "portfolio_url")}
    study = "array<struct<school:string,degree:string,major:string,graduation_year:string,in_progress:boolean>>"
    return rows.select(
        F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat("c_name", F.lit("@x.org"))).alias("email"), F.col("c_nationkey").cast("string").alias("city"),
        *(v.alias(c) for c, v in blank.items()), F.coalesce("positions", F.from_json(F.lit("[]"), "array<struct<company:string,title:string,location:string,start_date:string,end_date:string,description:string>>")).alias("positions"),
        F.from_json(F.lit('[{"school":"State","degree":"BS","major":"","graduation_year":"2001","in_progress":true}]'), study).alias("education"),
    )


_CUSTOMERS = f"""(SELECT c_custkey, c_name, c_mktsegment, c_nationkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name || '@x.org' END AS email, coalesce(jobs, []) AS jobs,
coalesce(list_filter(jobs, lambda x: x.ends = 'Present')[1], jobs[1]) AS job FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, {_JOBS} AS jobs FROM orders GROUP BY o_custkey) USING (c_custkey))"""
_FLAT = {
    "first_name": "c_name", "last_name": "c_mktsegment", "full_name": "c_name || ' ' || c_mktsegment", "email": "email", "confirm_email": "email", "city": "CAST(c_nationkey AS VARCHAR)",
    "current_company": "coalesce(job.company, '')", "current_title": "coalesce(job.title, '')", "school": "'State'", "degree": "'BS (In Progress)'", "major": "''", "graduation_year": "'2001'",
    **dict.fromkeys(("phone", "address_line1", "state", "postal_code", "country", "linkedin_url", "github_url", "portfolio_url"), "''"),
}
_VALUES = " UNION ALL ".join(f"SELECT c_custkey AS resume_id, '{c}' AS canonical, {v} AS value FROM {_CUSTOMERS}" for c, v in _FLAT.items())


@query(_VALUES)
def value_lookup(spark, sf_dir):
    return fill_plan.resume_values(_customers(spark, sf_dir))


#: Labels of a form with what they stand for; the fifth stands for nothing, two are for the applicant to answer.
_ASKED = (("First Name", "first_name"), ("Email address", "email"), ("Gender", "demographic"), ("Desired salary", "desired_salary"), ("Favourite colour", ""), ("Zip code", "postal_code"))


@query(f"""WITH q(field_idx, canonical) AS (VALUES {', '.join(f"({i}, '{c}')" for i, (_, c) in enumerate(_ASKED))}), r AS ({_VALUES}),
p AS (SELECT c_custkey AS resume_id, 'desired_salary' AS canonical, n_name AS supplied FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)
SELECT CAST(c_custkey AS VARCHAR) AS form_id, CAST(field_idx AS BIGINT) AS field_idx, q.canonical, CASE WHEN q.canonical = '' THEN '' WHEN supplied IS NOT NULL THEN supplied ELSE coalesce(value, '') END AS value,
CASE WHEN q.canonical = '' THEN 'skipped_no_match' WHEN supplied IS NOT NULL THEN 'filled' WHEN q.canonical IN ('demographic', 'desired_salary') THEN 'skipped_by_policy'
WHEN coalesce(value, '') <> '' THEN 'filled' ELSE 'skipped_no_value' END AS status
FROM customer CROSS JOIN q LEFT JOIN r ON r.resume_id = c_custkey AND r.canonical = q.canonical LEFT JOIN p ON p.resume_id = c_custkey AND p.canonical = q.canonical""")
def profile_override(spark, sf_dir):
    """The whole plan over a form for each customer: matching, the resume's values, what the applicant supplied."""
    labels = F.posexplode(F.array(*(F.lit(x) for x, _ in _ASKED))).alias("field_idx", "label")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("form_id"), F.col("c_custkey").alias("resume_id"), labels)
    empty = ("name", "element_id", "aria_label", "placeholder", "autocomplete", "accept", "grp")
    fields = asked.withColumns({c: F.lit("") for c in empty} | {"tag": F.lit("input"), "field_type": F.lit("text"), "grp_index": F.lit(-1)})
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("supplied"))
    profile = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("resume_id"), F.lit("desired_salary").alias("canonical"), "supplied")
    return fill_plan.plan(fields, _customers(spark, sf_dir), profile).select("form_id", "field_idx", "canonical", "value", "status")


@query(f"SELECT n_nationkey, left(n_name, 2) AS state, CASE WHEN upper(left(n_name, 2)) IN ('NA', 'NATION', 'AL', 'AK', 'NE', 'MP', 'TX') AND upper(left(n_name, 2)) <> 'NA' THEN 'United States' ELSE '' END AS country FROM nation")
def infer_country(spark, sf_dir):
    state = F.left("n_name", F.lit(2))
    return table(spark, sf_dir, "nation").select("n_nationkey", state.alias("state"), resume.infer_country(state).alias("country"))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'tion_1')")
def location_filter(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(postings.in_location(F.col("n_name"), " TION_1 ")).select("n_nationkey", "n_name")


# ---- matching: lineitem as controls of forms ---------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS grp_index FROM lineitem")
def row_renumber(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", matching.renumber_rows(rows, ["l_orderkey"], "l_linenumber").cast("long").alias("grp_index"))


@query("SELECT l_orderkey, l_returnflag, count(*) AS controls, count(*) FILTER (l_discount >= 0.055) AS candidates FROM lineitem GROUP BY l_orderkey, l_returnflag")
def scope_partition(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("controls"), F.count_if(F.col("l_discount") >= 0.055).alias("candidates"))


_GREEDY = """SELECT l_orderkey, w[1].idx AS field_idx, w[1].canon AS canonical, round(-w[1].neg, 2) AS confidence, r AS rank FROM (
SELECT l_orderkey, unnest(won) AS w, generate_subscripts(won, 1) - 1 AS r FROM (
SELECT l_orderkey, list_transform(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.idx = x[1].idx OR (y.canon = x[1].canon AND NOT x[1].multi))) > 0 THEN acc ELSE list_concat(acc, x) END), lambda z: [z]) AS won FROM (
SELECT l_orderkey, list({'neg': -conf, 'idx': l_linenumber, 'canon': canon, 'multi': canon IN ('3', '4')} ORDER BY -conf, l_linenumber, canon) AS c FROM (
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_suppkey % 5 AS VARCHAR) AS canon, round(l_discount * 10, 2) AS conf FROM lineitem WHERE round(l_discount * 10, 2) >= 0.55) GROUP BY l_orderkey)))"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("field_idx"), (F.col("l_suppkey") % 5).cast("string").alias("canonical"), F.round(F.col("l_discount") * 10, 2).alias("confidence"))
    cands = rows.where(F.col("confidence") >= V.THRESHOLD).withColumn("multi", F.col("canonical").isin("3", "4"))
    return matching.greedy(cands, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 2))


@query(_GREEDY)
def greedy_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH a AS ({_GREEDY}), l AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS field_idx, l_returnflag FROM lineitem),
f AS (SELECT l_orderkey, l_returnflag, arg_min(canonical, rank) AS canonical, arg_min(confidence, rank) AS confidence FROM a JOIN l USING (l_orderkey, field_idx) WHERE confidence >= 0.8 GROUP BY ALL)
SELECT l_orderkey, field_idx, canonical, confidence, false AS copied FROM a UNION ALL
SELECT l_orderkey, field_idx, canonical, confidence, true FROM l JOIN f USING (l_orderkey, l_returnflag) WHERE (l_orderkey, field_idx) NOT IN (SELECT (l_orderkey, field_idx) FROM a)""")
def duplicate_propagation(spark, sf_dir):
    controls = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("field_idx"), "l_returnflag").distinct()
    return matching.propagate_duplicates(controls, _assigned(spark, sf_dir), ["l_orderkey"], "l_returnflag", "field_idx", "canonical", "confidence")


@query("""WITH g AS (SELECT l_orderkey, l_linestatus, bool_or(l_returnflag = 'R') AS keep FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (keep) AS shown, count(*) FILTER (NOT keep) AS hidden FROM g GROUP BY l_orderkey""")
def collapse_empty_rows(spark, sf_dir):
    rows = fill_plan.collapse_empty_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linestatus"], F.col("l_returnflag") == "R")
    return rows.groupBy("l_orderkey").agg(F.count_if("any_filled").alias("shown"), F.count_if(~F.col("any_filled")).alias("hidden"))


_ENTRIES = {
    "entry_title": "p.title", "entry_company": "p.company", "entry_description": "''", "entry_start_month": "''", "entry_start_year": "''", "entry_end_month": "''",
    "entry_end_year": "CASE WHEN p.ends = 'Present' THEN '' ELSE p.ends END", "entry_currently_here": "CASE WHEN p.ends = 'Present' THEN 'yes' ELSE '' END", "entry_location": "''",
}
_STUDIES = {"entry_school": "State", "entry_degree": "BS (In Progress)", "entry_field_of_study": "", "entry_end_year": "2001"}


@query(f"""WITH j AS (SELECT c_custkey, unnest(jobs) AS p, CAST(generate_subscripts(jobs, 1) - 1 AS INTEGER) AS row FROM {_CUSTOMERS})
""" + " UNION ALL ".join([f"SELECT c_custkey AS resume_id, 'positions' AS source, row, '{c}' AS canonical, {v} AS value FROM j" for c, v in _ENTRIES.items()]
    + [f"SELECT c_custkey, 'education', 0, '{c}', '{v}' FROM customer" for c, v in _STUDIES.items()]))
def entry_value_lookup(spark, sf_dir):
    return fill_plan.entry_values(_customers(spark, sf_dir))


_WANTED = Inline("wanted string", ("part 1",), ("brand",), ("green",), ("a",))


def _option_sql(either: bool) -> str:
    inside = "contains(lower(trim(p_name)), lower(wanted))" + " OR contains(lower(wanted), lower(trim(p_name)))" * either
    return f"""SELECT p_brand, wanted, arg_min(p_name, (pr, p_partkey, p_name)) AS p_name, min(pr) AS priority FROM (SELECT *, CASE WHEN lower(trim(p_name)) = lower(wanted) THEN 0 WHEN {inside} THEN 1 END AS pr FROM part, {_WANTED.sql}) WHERE pr IS NOT NULL GROUP BY p_brand, wanted"""


def _options(spark: SparkSession, sf_dir: str, either: bool) -> DataFrame:
    """Each wanted word against each brand's names; the words are a literal list, so the table is read once."""
    words = F.array(*(F.lit(r[0]) for r in _WANTED.rows))
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", F.explode(words).alias("wanted"))
    return decisions.select_option(pairs, ["p_brand", "wanted"], "wanted", "p_name", "p_partkey", either).select("p_brand", "wanted", "p_name", "priority")


@query(_option_sql(False))
def option_select(spark, sf_dir):
    return _options(spark, sf_dir, False)


@query(_option_sql(True))
def option_select_combobox(spark, sf_dir):
    return _options(spark, sf_dir, True)


@query("""WITH w AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part),
x AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(a, '[^a-z0-9]+'), lambda t: length(t) > 2)) AS wa, list_distinct(list_filter(regexp_split_to_array(b, '[^a-z0-9]+'), lambda t: length(t) > 2)) AS wb FROM w)
SELECT p_partkey, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (len(wb) > 0 AND len(list_intersect(wa, wb)) / len(wb) >= 0.5)) AS agree FROM x""")
def values_agree(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", decisions.values_agree(F.col("p_name"), F.col("p_type")).alias("agree"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linestatus = 'O' THEN '0' ELSE '' END AS frame FROM lineitem")
def frame_order(spark, sf_dir):
    frame = F.when(F.col("l_linestatus") == "O", "0").otherwise("")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", frame.alias("frame")).orderBy("l_orderkey", "frame", "l_linenumber")


@query("""WITH l AS (SELECT l_orderkey, list({'s': l_suppkey, 'o': l_linestatus} ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(list_filter(p, lambda x: x.o = 'O')[1].s, p[1].s) AS suppkey FROM l""")
def current_position(spark, sf_dir):
    end = F.when(F.col("l_linestatus") == "O", "Present").otherwise("2020")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", end.alias("end_date")))).alias("p"))
    return rows.select("l_orderkey", fill_plan.current_position(F.col("p"))["l_suppkey"].alias("suppkey"))


# ---- texts: documents as postings and resumes --------------------------------------------------------------------

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
#: References in the pages, for the SQL; the ampersand is last.
_REFS = {"&lt;": 60, "&gt;": 62, "&quot;": 34, "&#39;": 39, "&nbsp;": 160, "&copy;": 169, "&middot;": 183, "&ndash;": 8211, "&mdash;": 8212, "&eacute;": 233, "&uuml;": 252, "&amp;": 38}


def _unescaped(x: str) -> str:
    for ref, code in _REFS.items():
        x = f"replace({x}, '{ref}', chr({code}))"
    return x


_PLAIN = "(CASE WHEN contains(text, '<') THEN " + _unescaped("regexp_replace(text, '<[^>]+>', ' ', 'g')") + " ELSE text END)"


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')")
def keyword_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(postings.has_keyword(F.col("text"), ["License", " idiot ", ""])).select("doc_id")


@query(f"SELECT doc_id, trim(line) AS url, 'url-list' AS source FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {_D}) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def url_list_clean(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return sources.url_list(rows, "value", "doc_id")


@query(rf"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS normal FROM {_D}")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normal"))


_TERMS = rf"""SELECT doc_id, list_concat(list_filter(list_transform(regexp_extract_all(low, '[A-Za-z][A-Za-z0-9+#.\-]{{1,29}}'), lambda t: regexp_replace(t, '[.\-]+$', '')), lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(quoted, V.STOP_WORDS))})),
list_filter([{', '.join(map(quoted, V.KNOWN_PHRASES))}], lambda p: contains(low, p))) AS terms FROM (SELECT doc_id, lower({_PLAIN}) AS low FROM {_D})"""


@query(f"SELECT doc_id, len(terms) AS n, array_to_string(terms, ' ') AS terms FROM ({_TERMS})")
def tokenize_terms(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), joined("t", " ").alias("terms"))


_COUNTS = f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM ({_TERMS})) GROUP BY doc_id, term"


@query(_COUNTS)
def term_counts(spark, sf_dir):
    return postings.term_counts(_docs(spark, sf_dir), "doc_id", "text")


_PROPER = rf"""SELECT DISTINCT doc_id, lower(word) AS term FROM (
SELECT doc_id, regexp_replace(word, '[.\-]+$', '') AS word, right(coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY i), '') || gap, 3) AS before FROM (
SELECT doc_id, unnest(words) AS word, unnest(gaps) AS gap, generate_subscripts(words, 1) AS i FROM (
SELECT doc_id, regexp_extract_all(p, '(?s)(.*?)([A-Za-z][A-Za-z0-9+#.\-]{{1,29}})', 2) AS words, regexp_extract_all(p, '(?s)(.*?)([A-Za-z][A-Za-z0-9+#.\-]{{1,29}})', 1) AS gaps FROM (SELECT doc_id, {_PLAIN} AS p FROM {_D}))))
WHERE regexp_matches(word, '^[A-Z]') AND (regexp_matches(word, '^.+[A-Z]') OR NOT regexp_matches(before, '(?:^|[.!?:;>\n•\-][\s\x0b]*)$'))"""


@query(_PROPER)
def proper_nouns(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.proper_nouns(F.col("text"))).alias("term"))


_TOP = f"""SELECT doc_id, term, n, rank FROM (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n * CASE WHEN p.term IS NULL THEN 1 ELSE 3 END DESC, term) AS rank
FROM ({_COUNTS}) c LEFT JOIN ({_PROPER}) p USING (doc_id, term)) WHERE rank <= 25"""


@query(_TOP)
def top_terms(spark, sf_dir):
    return postings.top_terms(_docs(spark, sf_dir), "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


_GAP = f"""WITH t AS ({_TOP}), corpus AS (SELECT lower(string_agg(text, ' ' ORDER BY item_id)) AS c FROM benchmark),
runs AS (SELECT DISTINCT unnest(regexp_split_to_array(c, '[^a-z0-9]+')) AS term FROM corpus),
o AS (SELECT DISTINCT term FROM t WHERE NOT regexp_matches(term, '^[a-z0-9]+$')),
f AS (SELECT term FROM o, corpus WHERE regexp_matches(c, '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)') UNION ALL SELECT term FROM runs WHERE term <> ''),
m AS (SELECT t.*, f.term IS NOT NULL AS matched FROM t LEFT JOIN f USING (term)),
g AS (SELECT doc_id, coalesce(string_agg(term, '|' ORDER BY rank) FILTER (matched), '') AS matched, coalesce(string_agg(term, '|' ORDER BY rank) FILTER (NOT matched), '') AS missing,
 count(*) FILTER (matched) / count(*) AS coverage FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(matched, '') AS matched, coalesce(missing, '') AS missing, round(coalesce(coverage, 0), 6) AS coverage, CAST(round_even(coalesce(coverage, 0) * 100, 0) AS INTEGER) AS coverage_percent FROM documents LEFT JOIN g USING (doc_id)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"])
    corpus = table(spark, sf_dir, "benchmark").agg(F.lower(joined(texts, " ")).alias("corpus"))  # one applicant's own text
    return postings.keyword_gap(_docs(spark, sf_dir), "doc_id", "text", corpus)


@query(_GAP)
def keyword_gap(spark, sf_dir):
    return _gaps(spark, sf_dir).select("doc_id", joined("matched").alias("matched"), joined("missing").alias("missing"), F.round("coverage", 6).alias("coverage"), "coverage_percent")


@query(f"SELECT doc_id, coverage, coverage_percent FROM ({_GAP})")
def coverage_rank(spark, sf_dir):
    return postings.rank_by_coverage(_gaps(spark, sf_dir), "doc_id").select("doc_id", F.round("coverage", 6).alias("coverage"), "coverage_percent")


@query(f"""SELECT doc_id, 'Dear src team,' || chr(10) || chr(10) || 'I would like to apply as analyst.' || CASE WHEN h <> '' THEN ' My work so far covers ' || h || '.' ELSE '' END
|| CASE WHEN l <> '' THEN chr(10) || chr(10) || '[To add if true: ' || l || ']' ELSE '' END || chr(10) || chr(10) || 'Kind regards' AS letter
FROM (SELECT doc_id, array_to_string(string_split(matched, '|')[1:6], ', ') AS h, array_to_string(string_split(missing, '|')[1:6], ', ') AS l FROM ({_GAP}))""")
def cover_letter(spark, sf_dir):
    return _gaps(spark, sf_dir).select("doc_id", postings.cover_letter(F.lit("analyst"), F.lit("src"), F.col("matched"), F.col("missing")).alias("letter"))


_HEADING = r"""CASE WHEN length(s) BETWEEN 1 AND 45 AND NOT regexp_matches(s, '^[•\-*●▪]') AND NOT regexp_matches(s, '[.,;]\z') AND norm <> '' AND len(regexp_split_to_array(norm, '\s+')) <= 5
AND ((upper(s) = s AND regexp_matches(s, '[A-Z]')) OR (regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[A-Za-z][A-Z]|(^|[^A-Za-z])[a-z]')) OR ends_with(s, ':') OR length(norm) <= 30)
THEN CASE """ + " ".join(f"WHEN regexp_matches(norm, '{'|'.join(ws)}') THEN '{k}'" for k, ws in V.SECTION_KEYWORDS.items()) + " END END"
_SECTIONS = rf"""SELECT doc_id, pos, line, section, opens FROM (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM (
SELECT *, {_HEADING} AS opens FROM (SELECT *, trim(regexp_replace(lower(s), '[^a-z\s]', '', 'g')) AS norm FROM (SELECT *, trim(line) AS s FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {_D})))))"""


@query(f"SELECT doc_id, section, count(*) AS n_lines FROM ({_SECTIONS}) WHERE opens IS NULL AND trim(line) <> '' GROUP BY ALL")
def section_split(spark, sf_dir):
    return resume.section_lines(_docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


_RX = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "phone": T.PHONE, "linkedin": T.LINKEDIN, "github": T.GITHUB}


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_RX['email']}', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '{_RX['phone']}', ' ', 'g'), '[|•·●]+', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM {_D}")
def contact_strip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.contact_strip(F.col("text")).alias("stripped"))


@query(f"SELECT doc_id, regexp_extract(text, '{_RX['email']}') AS email FROM {_D}")
def email_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.email(F.col("text")).alias("email"))


def _phone(x: str) -> str:
    return f"coalesce(trim(list_filter(regexp_extract_all({x}, '{_RX['phone']}'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)[1]), '')"



@query(f"SELECT doc_id, {_phone('text')} AS phone FROM {_D}")
def phone_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.phone(F.col("text")).alias("phone"))


_URLS = Inline("id int, text string", (1, "see linkedin.com/in/ana-b and https://github.com/anab/x"), (2, "www.github.com/z_1. mail a@b.io"), (3, "my site https://ana.dev/work, cv.pdf"), (4, "ana.b@mail.example.org only"), (5, ""), (6, "http://www.LinkedIn.com/in/Q%20/ then q.ai"))


def _scheme(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' WHEN starts_with(lower({x}), 'http') THEN {x} ELSE 'https://' || {x} END"


@query(f"SELECT id, {_scheme('l')} AS linkedin_url, {_scheme('g')} AS github_url FROM (SELECT id, regexp_extract(text, '{_RX['linkedin']}') AS l, regexp_extract(text, '{_RX['github']}') AS g FROM {_URLS.sql})")
def profile_urls(spark, sf_dir):
    return _URLS.df(spark).select("id", T.linkedin(F.col("text")).alias("linkedin_url"), T.github(F.col("text")).alias("github_url"))


@query("SELECT * FROM (VALUES (1, ''), (2, ''), (3, 'https://ana.dev/work'), (4, 'https://example.org'), (5, ''), (6, 'https://q.ai')) t(id, portfolio_url)")
def portfolio_url(spark, sf_dir):
    return _URLS.df(spark).select("id", T.portfolio(F.col("text")).alias("portfolio_url"))


_PLACES = Inline("id int, text string", (1, "Ana B\nSan Antonio, TX 78240 | x"), (2, "Austin, TX, 78701-1234"), (3, "St. Louis, MO"), (4, "no place"), (5, "Rome, IT is"), (6, "x, ABC"), (7, "Austin, TX then Dallas, TX 75201"))


@query(rf"SELECT id, regexp_extract(text, '{T.LOCATION}', 1) AS city, regexp_extract(text, '{T.LOCATION}', 2) AS state, regexp_extract(text, '{T.LOCATION}', 3) AS postal_code FROM {_PLACES.sql}".replace("\n", "' || chr(10) || '"))
def location_extract(spark, sf_dir):
    c = resume.contact(F.col("text"))
    return _PLACES.df(spark).select("id", c["city"].alias("city"), c["state"].alias("state"), c["postal_code"].alias("postal_code"))


_HEAD = "split_part(text, chr(10), 1)"


@query(f"""SELECT doc_id, CASE WHEN he = '' OR hp = '' THEN CASE WHEN te <> '' THEN te ELSE he END ELSE he END AS email, CASE WHEN he = '' OR hp = '' THEN CASE WHEN tp <> '' THEN tp ELSE hp END ELSE hp END AS phone
FROM (SELECT doc_id, regexp_extract({_HEAD}, '{_RX['email']}') AS he, {_phone(_HEAD)} AS hp, regexp_extract(text, '{_RX['email']}') AS te, {_phone('text')} AS tp FROM {_D})""")
def contact_fallback(spark, sf_dir):
    c = resume.contact_with_fallback(F.get(F.split("text", "\n"), F.lit(0)), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", c["email"].alias("email"), c["phone"].alias("phone"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_D}),
p AS (SELECT doc_id, pos, unnest(regexp_split_to_array(c, '\s*[,;|]\s*|\s{{3,}}')) AS raw, generate_subscripts(regexp_split_to_array(c, '\s*[,;|]\s*|\s{{3,}}'), 1) AS k FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '^[\s•\-*]+', ''), '^[A-Za-z /]{{3,25}}:\s*', '') AS c FROM l)),
s AS (SELECT doc_id, pos, k, trim(raw, ' .') AS skill FROM p WHERE length(trim(raw, ' .')) BETWEEN 2 AND 40)
SELECT doc_id, arg_min(skill, (pos, k)) AS skill FROM s GROUP BY doc_id, lower(skill)""")
def skills_dedupe(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return resume.skills(rows, "doc_id").select("doc_id", "skill")


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(replace(text, ' ', ''))) / length(text) END, 6) AS space_ratio FROM {_D}")
def space_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.space_ratio(F.col("text")), 6).alias("space_ratio"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '.' ELSE text END AS short FROM {_D}")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 40).alias("short"))


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 'posting' ELSE s END AS slug FROM (SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS s FROM {_D})")
def slugify(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("slug"))


# ---- pages -------------------------------------------------------------------------------------------------------

_P = "(SELECT page_id, coalesce(html, '') AS text FROM pages)"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g')"


def _plain_sql(x: str) -> str:
    stripped = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace({_unescaped(stripped)}, '[\s\x0b]+', ' ', 'g'))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))


@query(f"SELECT page_id, {_PLAIN} AS plain FROM {_P}")
def strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.strip_html(F.col("html")).alias("plain"))


_POSTING = rf"""SELECT page_id, CASE WHEN h <> '' THEN h ELSE t END AS title, body FROM (SELECT page_id, {_plain_sql("regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t,
{_plain_sql("regexp_extract(bare, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h, {_plain_sql('bare')} AS body FROM (SELECT page_id, {_BARE} AS bare FROM {_P}))"""


@query(_POSTING)
def html_posting(spark, sf_dir):
    p = sources.html_posting(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", p.alias("p")).select("page_id", "p.title", "p.body")


_MARKERS = ["the", "and", "der", "les", "para", "copy"]


def _score_sql(x: str) -> str:
    return " + ".join(f"CAST(contains(lower({x}), '{m}') AS INTEGER)" for m in _MARKERS)


@query(f"SELECT page_id, {_score_sql('body')} AS score FROM ({_POSTING})")
def jd_score(spark, sf_dir):
    return html_posting(spark, sf_dir).select("page_id", postings.marker_score(F.col("body"), _MARKERS).alias("score"))


@query(f"SELECT page_id, CASE WHEN a > b THEN title WHEN b > a THEN body WHEN length(title) > length(body) THEN title ELSE body END AS description FROM (SELECT *, {_score_sql('title')} AS a, {_score_sql('body')} AS b FROM ({_POSTING}))")
def description_choice(spark, sf_dir):
    return html_posting(spark, sf_dir).select("page_id", postings.best_description(F.col("title"), F.col("body"), _MARKERS).alias("description"))


_SIGNS = ["track(", "ad 1", "nav", "footer"]


@query(f"""SELECT page_id, true AS sparse, CAST((length(l) - length(replace(l, '<script', ''))) / 7 AS INTEGER) AS n_scripts, (length(l) - length(replace(l, '<script', ''))) / 7 > 20 AS script_heavy,
array_to_string(list_filter([{', '.join(map(quoted, _SIGNS))}], lambda m: contains(l, m))[1:3], '|') AS markers FROM (SELECT page_id, lower(text) AS l FROM {_P})""")
def sparse_scan(spark, sf_dir):
    s = decisions.sparse_scan(F.col("html"), F.lit(0), _SIGNS)
    return _pages(spark, sf_dir).select("page_id", s.alias("s")).select("page_id", "s.sparse", "s.n_scripts", "s.script_heavy", joined("s.markers").alias("markers"))


_FORM = """<form><label for=fn>First Name *</label><input id=fn name=firstName required autocomplete=given-name>
<label>Email <input type=email name=email></label><input type=hidden name=tok><fieldset><legend>Are you authorized to work?</legend>
<label><input type=radio name=auth value=1> Yes</label><label><input type=radio name=auth value=0> No</label></fieldset>
<div class=field-label>Why do you want to join us? Please tell us more.</div><textarea name=q1></textarea>
<label for=cv>Resume</label><input type=file id=cv accept=".pdf,.docx"><select name=country aria-label=Country><option>Spain<option>Peru</select>
<input id=workExperience-3--jobTitle aria-label="Job Title"><input id=workExperience-7--jobTitle aria-label="Job Title">
<input aria-hidden=true name=proxy><div role=combobox aria-label=City aria-controls=lb></div><ul role=listbox id=lb><li role=option>Lima</li></ul></form>"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form, asked once with each page of the table (pages have no forms of their own)."""
    pages = _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("form_id"), F.concat("html", F.lit(_FORM)).alias("html"))
    return forms.scan_forms(pages)


@query()
def form_scan(spark, sf_dir):
    return _scanned(spark, sf_dir)


@query(f"SELECT CAST(page_id AS VARCHAR) AS form_id, 10 AS controls, 1 AS required, 2 AS grouped FROM {_P}")
def scan_stats(spark, sf_dir):
    n = lambda c: F.count_if(c).cast("int")
    return _scanned(spark, sf_dir).groupBy("form_id").agg(F.count("*").cast("int").alias("controls"), n(F.col("required")).alias("required"), n(F.col("grp") != "").alias("grouped"))


# ---- conversations as lines in order ------------------------------------------------------------------------------

def _history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as experience sections: a user's turn is a dated line of a position, the others describe it."""
    dated = F.concat(F.lit("Engineer, Org "), "conv_id", F.lit(", Town  "), F.col("turn") + 2000, F.lit(" - Present"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "user", dated).otherwise(F.coalesce("text", F.lit(""))).alias("line"))


_POSITIONS = r"""WITH t AS (SELECT *, CAST(sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER) - 1 AS row FROM conversations),
d AS (SELECT conv_id, row, string_agg(trim(text, E' \t\n\r'), chr(10) ORDER BY turn) AS description FROM t WHERE role <> 'user' AND row >= 0 AND trim(coalesce(text, '')) <> '' GROUP BY ALL)
SELECT conv_id, row, 'Org ' || conv_id AS company, 'Engineer' AS title, 'Town' AS location, CAST(turn + 2000 AS VARCHAR) AS start_date, 'Present' AS end_date, coalesce(description, '') AS description
FROM t LEFT JOIN d USING (conv_id, row) WHERE role = 'user'"""


@query(_POSITIONS)
def positions(spark, sf_dir):
    return resume.positions(_history_lines(spark, sf_dir), "conv_id")


@query(f"SELECT conv_id, row, description FROM ({_POSITIONS}) WHERE description <> ''")
def description_blocks(spark, sf_dir):
    return resume.positions(_history_lines(spark, sf_dir), "conv_id").where("description != ''").select("conv_id", "row", "description")


@query("""WITH l AS (SELECT conv_id, turn AS pos, CASE WHEN role = 'user' THEN text ELSE '' END AS degree, CASE WHEN role = 'assistant' THEN text ELSE '' END AS school FROM conversations WHERE role IN ('user', 'assistant')),
n AS (SELECT *, greatest(1, sum(CAST(degree <> '' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS entry FROM l),
e AS (SELECT conv_id, entry, coalesce(arg_min(school, pos) FILTER (school <> ''), '') AS school, coalesce(arg_min(degree, pos) FILTER (degree <> ''), '') AS degree FROM n GROUP BY conv_id, entry),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, school, degree ORDER BY entry) AS r FROM e WHERE school <> '' OR degree <> '')
SELECT conv_id, school, degree FROM d WHERE r = 1""")
def education_entries(spark, sf_dir):
    at = lambda role: F.when(F.col("role") == role, F.col("text")).otherwise("")
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", F.col("turn").alias("pos"), at("assistant").alias("school"), at("user").alias("degree"), F.lit("").alias("major"), F.lit("").alias("year"), F.lit(False).alias("open"))
    return resume.education_entries(rows, "conv_id").select("conv_id", "school", "degree")


_TITLE = rf"length(s) BETWEEN 1 AND 70 AND NOT regexp_matches(s, '^[•\-*●▪]') AND NOT regexp_matches(s, '[.:;]\z')"


@query(rf"""SELECT conv_id, turn, {_TITLE} AS plausible, ({_TITLE}) AND regexp_matches(s, '{resume.ROLE_WORD}') AS is_role,
({_TITLE}) AND (regexp_matches(s, '{resume.ROLE_WORD}') OR (len(w) BETWEEN 2 AND 9 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z0-9]'))) >= len(w) * 0.6)) AS could_be
FROM (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, trim(text) AS s FROM conversations))""")
def title_tests(spark, sf_dir):
    s = F.trim("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", resume.plausible(s).alias("plausible"), resume.is_role_title(s).alias("is_role"), resume.could_be_title(s).alias("could_be"))


@query("SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, 'again' FROM conversations WHERE turn = 0")
def wizard_union(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return steps.unionByName(steps.where("turn = 0").withColumn("role", F.lit("again")))


@query("""SELECT conv_id, '{"conv_id":' || conv_id || ',"fields":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn, role) || ']}' AS report FROM conversations GROUP BY conv_id""")
def run_report_json(spark, sf_dir):
    return sources.report_json(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "turn")


# ---- inline cases ------------------------------------------------------------------------------------------------

_FIELDS = Inline(
    "form_id string, field_idx int, tag string, field_type string, name string, element_id string, label string, aria_label string, placeholder string, autocomplete string, accept string, grp string, grp_index int, resume_id string",
    ("f1", 0, "input", "text", "firstName", "x1", "First Name", "", "", "given-name", "", "", -1, "r1"),
    ("f1", 1, "input", "text", "last_name", "x2", "", "", "Surname", "", "", "", -1, "r1"),
    ("f1", 2, "input", "email", "mail", "x3", "Email address", "", "", "email", "", "", -1, "r1"),
    ("f1", 3, "input", "email", "mail2", "x4", "Confirm your email", "", "", "", "", "", -1, "r1"),
    ("f1", 4, "input", "file", "up", "x5", "", "", "", "", ".pdf,.docx", "", -1, "r1"),
    ("f1", 5, "input", "file", "pic", "x6", "Upload your resume photo", "", "", "", "image/png", "", -1, "r1"),
    ("f1", 6, "textarea", "textarea", "q", "x7", "What makes this team the right one for you?", "", "", "", "", "", -1, "r1"),
    ("f1", 7, "input", "text", "g", "x8", "Gender", "", "", "", "", "", -1, "r1"),
    ("f1", 8, "input", "text", "firstName2", "x9", "First Name", "", "", "", "", "", -1, "r1"),
    ("f1", 9, "input", "text", "we0", "x10", "Job Title", "", "", "", "", "workExperience", 0, "r1"),
    ("f1", 10, "input", "text", "we0c", "x11", "Company", "", "", "", "", "workExperience", 0, "r1"),
    ("f1", 11, "input", "text", "we1", "x12", "Job Title", "", "", "", "", "workExperience", 1, "r1"),
    ("f1", 12, "input", "checkbox", "we0h", "x13", "I currently work here", "", "", "", "", "workExperience", 1, "r1"),
    ("f1", 13, "input", "text", "zzz", "x14", "Favourite colour", "", "", "", "", "", -1, "r1"),
    ("f2", 0, "select", "select", "country", "y1", "", "Country", "", "country-name", "", "", -1, "r2"),
    ("f2", 1, "input", "radio", "rb", "y2", "Female", "", "", "", "", "", -1, "r2"),
    ("f2", 2, "input", "text", "school", "y3", "School", "", "", "", "", "education", 0, "r2"),
    ("f2", 3, "input", "text", "salary", "y4", "Desired salary", "", "", "", "", "", -1, "r2"),
)


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def _pattern_sql(x: str, c: V.Canonical) -> str:
    best = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {s}" for p, s in sorted(c.patterns, key=lambda p: -p[1]))
    no = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN 0.0" for p in c.negatives)
    return f"CAST(CASE WHEN {x} = '' THEN 0.0 {no} {best} ELSE 0.0 END AS DOUBLE)"


def _kind_sql(x: str) -> str:
    exts = f"list_transform(list_filter(list_transform(string_split(lower({x}), ','), lambda e: trim(e)), lambda e: e <> ''), lambda e: CASE WHEN starts_with(e, '.') THEN e ELSE '.' || e END)"
    return f"CASE WHEN trim({x}) = '' THEN '' WHEN contains(lower({x}), 'image/') THEN 'image' WHEN regexp_matches(lower({x}), 'application/(pdf|msword)') THEN 'document' WHEN len(list_intersect({exts}, {quoted(V.DOCUMENT_EXTENSIONS)})) > 0 THEN 'document' WHEN len({exts}) > 0 AND len(list_filter({exts}, lambda e: NOT list_contains({quoted(V.IMAGE_EXTENSIONS)}, e))) = 0 THEN 'image' ELSE '' END"


def _compat_sql(c: str) -> str:
    return f"CASE WHEN {c} = 'demographic_option' THEN field_type IN ('radio', 'checkbox') WHEN field_type = 'file' THEN kind <> 'image' AND {c} IN ('resume_file', 'cover_letter') WHEN {c} IN ('resume_file', 'cover_letter') THEN true WHEN field_type = 'email' THEN {c} IN ('email', 'confirm_email') ELSE true END"


_NORMAL = f"SELECT *, {', '.join(f'{_normal_sql(a)} AS n_{a}' for a in V.ATTRIBUTE_WEIGHTS)}, replace({_normal_sql('autocomplete')}, ' ', '-') AS n_autocomplete, {_kind_sql('accept')} AS kind FROM {_FIELDS.sql}"


def _score_of(c: V.Canonical) -> str:
    score = "round(greatest(" + ", ".join(f"{_pattern_sql('n_' + a, c)} * {w}" for a, w in V.ATTRIBUTE_WEIGHTS.items()) + "), 4)"
    if c.name == "resume_file":
        score = f"CASE WHEN field_type = 'file' AND kind = 'document' THEN greatest({V.UPLOAD_CONFIDENCE}, {score}) ELSE {score} END"
    if c.name == "free_text_question":
        label = "trim(CASE WHEN label <> '' THEN label ELSE aria_label END)"
        score = f"CASE WHEN tag = 'textarea' AND {label} <> '' AND (ends_with({label}, '?') OR length({label}) >= {V.PROMPT_LENGTH}) THEN greatest({V.ESSAY_CONFIDENCE}, {score}) ELSE {score} END"
    tokens = [k for k, v in V.AUTOCOMPLETE.items() if v == c.name]
    return f"CASE WHEN n_autocomplete IN ({', '.join(map(quoted, tokens))}) THEN 1.0 ELSE {score} END" if tokens else score


_SCORES = " UNION ALL ".join(f"SELECT form_id, field_idx, '{c.name}' AS canonical, CAST({_score_of(c)} AS DOUBLE) AS confidence FROM n WHERE (grp <> '') = {str(c.row_level).lower()} AND {_compat_sql(quoted(c.name))}" for c in V.VOCABULARY)


@query(f"WITH n AS ({_NORMAL}) SELECT * FROM ({_SCORES}) WHERE confidence >= {V.THRESHOLD}")
def field_score(spark, sf_dir):
    return matching.candidates(_FIELDS.df(spark)).select("form_id", "field_idx", "canonical", "confidence")


_LABELS = Inline("id int, text string", (1, "first name"), (2, "company name"), (3, "last name of manager"), (4, "given name"), (5, "email address"), (6, "confirm email"), (7, ""), (8, "zip code"), (9, "street address"))


@query("SELECT id, " + ", ".join(f"{_pattern_sql('text', V.BY_NAME[c])} AS {c}" for c in ("first_name", "email", "postal_code", "address_line1")) + f" FROM {_LABELS.sql}")
def pattern_score(spark, sf_dir):
    return _LABELS.df(spark).select("id", *(matching.pattern_score(F.col("text"), V.BY_NAME[c]).alias(c) for c in ("first_name", "email", "postal_code", "address_line1")))


@query(f"WITH n AS ({_NORMAL}), c(canonical) AS (VALUES ('resume_file'), ('email'), ('demographic_option'), ('city')) SELECT form_id, field_idx, canonical, {_compat_sql('canonical')} AS fits FROM n, c")
def type_compat(spark, sf_dir):
    rows = matching.with_normalized(_FIELDS.df(spark)).select("form_id", "field_idx", "field_type", "kind", F.explode(F.array(*map(F.lit, ("resume_file", "email", "demographic_option", "city")))).alias("canonical"))
    return rows.select("form_id", "field_idx", "canonical", matching.type_compatible(F.col("canonical"), F.col("field_type"), F.col("kind")).alias("fits"))


_ACCEPTS = Inline("id int, accept string", (1, ".pdf, .docx"), (2, "image/*"), (3, ".png,.jpg"), (4, "png,pdf"), (5, ""), (6, "application/pdf,image/png"), (7, "audio/*"), (8, "APPLICATION/MSWORD"))


@query(f"SELECT id, {_kind_sql('accept')} AS kind FROM {_ACCEPTS.sql}")
def accept_kind(spark, sf_dir):
    return _ACCEPTS.df(spark).select("id", matching.accept_kind(F.col("accept")).alias("kind"))


_RESUMES = [
    ("r1", "Ana", "Bo", "ana@x.org", "210 555 0100", "", "Austin", "TX", "78701", "United States", "", "", "", "", ["SQL"], [("Acme", "Engineer", "Austin", "Jul 2021", "Present", "built"), ("Bolt", "Analyst", "", "01/2018", "2020", "")], [("State University", "BS", "Math", "2017", False)], "raw"),
    ("r2", "Cy", "", "", "", "", "", "", "", "", "", "", "", "", [], [], [("City College", "MS", "", "", True)], ""),
]
RESUME_SCHEMA = "resume_id string, first_name string, last_name string, email string, phone string, address_line1 string, city string, state string, postal_code string, country string, linkedin_url string, github_url string, portfolio_url string, summary string, skills array<string>, positions array<struct<company:string,title:string,location:string,start_date:string,end_date:string,description:string>>, education array<struct<school:string,degree:string,major:string,graduation_year:string,in_progress:boolean>>, raw_text string"
_PROFILE = [("r1", "demographic", "Prefer not to say"), ("r2", "desired_salary", "90k")]
_PLAN = [
    ("f1", 0, "first_name", "Ana", "filled"), ("f1", 1, "last_name", "Bo", "filled"), ("f1", 2, "email", "ana@x.org", "filled"), ("f1", 3, "confirm_email", "ana@x.org", "filled"),
    ("f1", 4, "resume_file", "/cv.pdf", "filled"), ("f1", 5, "", "", "skipped_no_match"), ("f1", 6, "free_text_question", "", "skipped_by_policy"), ("f1", 7, "demographic", "Prefer not to say", "filled"),
    ("f1", 8, "first_name", "Ana", "filled"), ("f1", 9, "entry_title", "Engineer", "filled"), ("f1", 10, "entry_company", "Acme", "filled"), ("f1", 11, "entry_title", "Analyst", "filled"),
    ("f1", 12, "entry_currently_here", "", "not_applicable"), ("f1", 13, "", "", "skipped_no_match"), ("f2", 0, "country", "", "skipped_no_value"), ("f2", 1, "demographic_option", "", "skipped_by_policy"),
    ("f2", 2, "entry_school", "City College", "filled"), ("f2", 3, "desired_salary", "90k", "filled"),
]


def _planned(spark: SparkSession) -> DataFrame:
    return fill_plan.plan(_FIELDS.df(spark), spark.createDataFrame(_RESUMES, RESUME_SCHEMA), spark.createDataFrame(_PROFILE, "resume_id string, canonical string, supplied string"), resume_path="/cv.pdf")


_PLAN_SQL = Inline("form_id string, field_idx long, canonical string, value string, status string", *_PLAN).sql


@query(f"SELECT form_id, CAST(field_idx AS BIGINT) AS field_idx, canonical, value, status FROM {_PLAN_SQL}")
def plan_status(spark, sf_dir):
    return _planned(spark).select("form_id", "field_idx", "canonical", "value", "status")


@query(f"""SELECT form_id, CAST(field_idx AS BIGINT) AS field_idx, CASE WHEN length(canonical) > 12 THEN left(canonical, 11) || '.' ELSE canonical END AS canonical, CASE WHEN length(value) > 12 THEN left(value, 11) || '.' ELSE value END AS value, status, hidden
FROM (SELECT *, count(*) FILTER (status = 'skipped_no_match') OVER (PARTITION BY form_id) AS hidden FROM {_PLAN_SQL}) WHERE status <> 'skipped_no_match'""")
def plan_table(spark, sf_dir):
    return fill_plan.plan_table(_planned(spark), 12)


_IDS = Inline("id int, ident string, want string, k int", (1, "workExperience-2--jobTitle", "workExperience", 2), (2, "education[1][school]", "education", 1), (3, "education_1_school", "education", 1), (4, "plain", "", -1), (5, "", "", -1), (6, "a-b--c", "", -1), (7, "jobs[12]title", "jobs", 12))


@query(f"SELECT id, want AS grp, k AS grp_index FROM {_IDS.sql}")
def group_parse(spark, sf_dir):
    return _IDS.df(spark).select("id", T.group_parse(F.col("ident")).alias("g")).select("id", "g.*")


_GROUPS = Inline("id int, grp string", (1, "workExperience"), (2, "education"), (3, "Employment_History"), (4, "languages"), (5, ""), (6, "schoolRows"))


@query(f"SELECT id, CASE WHEN regexp_matches(n, 'work|employment|experience|job|position') THEN 'positions' WHEN regexp_matches(n, 'education|school|degree|academic') THEN 'education' ELSE '' END AS source FROM (SELECT id, {_normal_sql('grp')} AS n FROM {_GROUPS.sql})")
def group_source(spark, sf_dir):
    return _GROUPS.df(spark).select("id", fill_plan.group_source(F.col("grp")).alias("source"))


_PARTS = Inline("id int, label string, aria string", (1, "From", "Month"), (2, "From", " Year "), (3, "From year", "Year"), (4, "", "Month"), (5, "To", "City"))


@query(f"SELECT id, CASE WHEN lower(trim(aria)) IN ('month', 'year', 'day') AND label <> '' AND NOT contains(lower(label), lower(trim(aria))) THEN label || ' ' || trim(aria) ELSE label END AS label FROM {_PARTS.sql}")
def date_part_label(spark, sf_dir):
    return _PARTS.df(spark).select("id", forms.date_part_label(F.col("label"), F.col("aria")).alias("label"))


_DATES = Inline("id int, d string, m string, y string", (1, "Jul 2021", "07", "2021"), (2, "Present", "", ""), (3, "3/2019", "03", "2019"), (4, "2018", "", "2018"), (5, "September 1999", "09", "1999"), (6, "", "", ""), (7, "Spring 2020", "", "2020"))


@query(f"SELECT id, m AS month, y AS year FROM {_DATES.sql}")
def split_date(spark, sf_dir):
    return _DATES.df(spark).select("id", T.split_date(F.col("d")).alias("x")).select("id", "x.*")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END AS shown FROM customer")
def first_non_empty(spark, sf_dir):
    a, b = F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(""), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", T.first_non_empty(a, b).alias("shown"))


_NAMES = Inline("id int, pos int, line string", (1, 0, "Resume"), (1, 1, "ANA MARIA BO"), (2, 0, "Cy Dent, PhD | cy@x.org"), (3, 0, "Senior Engineer"), (3, 1, "one two"), (4, 0, "El Fox  (210) 555-0100"))


@query("SELECT * FROM (VALUES (1, 'Ana', 'Bo'), (2, 'Cy', 'Dent'), (4, 'El', 'Fox')) t(id, first_name, last_name)")
def extract_name(spark, sf_dir):
    return resume.names(_NAMES.df(spark), "id")


_JSONS = Inline("id int, j string", (1, '{"phone": " 1 ", "city": "", "odd": "x"}'), (2, "{}"), (3, '{"country": "Peru"}'))


@query("SELECT * FROM (VALUES (1, 'odd=x|phone=1', 'odd'), (2, '', ''), (3, 'country=Peru', '')) t(id, entries, unknown)")
def profile_map(spark, sf_dir):
    rows = _JSONS.df(spark).select("id", sources.profile_map(F.col("j")).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("id", joined(entries).alias("entries"), joined(sources.unknown_keys(F.col("m"), list(V.BY_NAME))).alias("unknown"))


_CSV = Inline("Title string, URL string, Company string, Description string", ("Dev ", "http://a", "A", "x"), ("Ops", " ", "B", ""), (None, "http://c ", None, None))


@query(f"SELECT trim(coalesce(Title, '')) AS title, trim(coalesce(Company, '')) AS company, '' AS location, trim(URL) AS url, 'csv' AS source FROM {_CSV.sql} WHERE trim(URL) <> ''")
def csv_postings(spark, sf_dir):
    return sources.csv_postings(_CSV.df(spark))


_BOARD = Inline("json string", ('{"jobs":[{"title":"Dev","absolute_url":"http://a","content":"<p>x</p>","location":{"name":"Lima"}},{"title":"No","absolute_url":""},{"title":"Ops","absolute_url":"http://b","location":null}]}',))
_BOARD2 = Inline("json string", ('[{"text":"Dev","applyUrl":"","hostedUrl":"http://h","descriptionPlain":"x","categories":{"location":"Oslo"}},{"text":"Gone"},{"text":"Ops","applyUrl":"http://p","hostedUrl":"http://q"}]',))


@query("""WITH j AS (SELECT unnest(CAST(json_extract(json, '$.jobs[*]') AS JSON[])) AS j FROM """ + _BOARD.sql + """)
SELECT coalesce(j->>'$.title', '') AS title, coalesce(j->>'$.location.name', '') AS location, j->>'$.absolute_url' AS url, coalesce(j->>'$.content', '') AS description FROM j WHERE coalesce(j->>'$.absolute_url', '') <> ''""")
def board_json_nested(spark, sf_dir):
    return sources.board_jobs(_BOARD.df(spark))


@query("""WITH j AS (SELECT unnest(CAST(json_extract(json, '$[*]') AS JSON[])) AS j FROM """ + _BOARD2.sql + """), u AS (SELECT j, coalesce(nullif(j->>'$.applyUrl', ''), nullif(j->>'$.hostedUrl', '')) AS url FROM j)
SELECT coalesce(j->>'$.text', '') AS title, coalesce(j->>'$.categories.location', '') AS location, url, coalesce(j->>'$.descriptionPlain', '') AS description FROM u WHERE url IS NOT NULL""")
def board_json_array(spark, sf_dir):
    return sources.board_array(_BOARD2.df(spark))


_MESSAGES = Inline("id int, m string", (1, "This driver only supports version 99"), (2, "cannot find Chrome binary"), (3, "Connection refused"), (4, "Timed out after 15 s"), (5, "odd"), (6, None), (7, "file not found, version 3"))


@query("SELECT id, CASE " + " ".join(f"WHEN contains(lower(coalesce(m, '')), '{t}') THEN '{c}'" for t, c in decisions.MESSAGE_CLASSES) + f" ELSE 'other' END AS class FROM {_MESSAGES.sql}")
def classify_message(spark, sf_dir):
    return _MESSAGES.df(spark).select("id", decisions.classify_message(F.col("m")).alias("class"))


_FRAMES = Inline("path string, html string", ("/s/a.html", '<iframe src="https://x.org/y"></iframe><iframe src="sub/b%20c.html?x=1"></iframe><iframe src="gone.html"></iframe>'), ("/s/sub/b c.html", "<input name=q><iframe src='d.html#t'></iframe>"), ("/s/sub/d.html", "<p>end</p>"))


@query("SELECT * FROM (VALUES ('/s/a.html', '/s/a.html', ''), ('/s/a.html', '/s/sub/b c.html', '1'), ('/s/a.html', '/s/sub/d.html', '1|0')) t(root, path, frame_path)")
def frame_walk(spark, sf_dir):
    pages = _FRAMES.df(spark)
    return forms.frame_walk(pages, pages.where("path = '/s/a.html'")).select("root", "path", joined(F.col("frame_path").cast("array<string>")).alias("frame_path"))


_RESUME_TEXT = """Ana Maria Bo
Austin, TX 78701 | ana.bo@example.org | (210) 555-0100
SUMMARY
Builds data systems.
Professional Experience
Staff Engineer, Acme    Jul 2021 - Present
Built pipelines
Page 1 | 2
Bolt Labs, San Antonio, Texas  2018 to 2020
Data Analyst
Wrote reports
Education
Master of Science in Computer Science
State University, 2017
Technical Skills
Languages: SQL, Python, sql; Spark"""


@query("""SELECT 'r' AS resume_id, 'Ana' AS first_name, 'Bo' AS last_name, 'ana.bo@example.org' AS email, '(210) 555-0100' AS phone, 'Austin' AS city, 'TX' AS state, '78701' AS postal_code, 'United States' AS country, 'Builds data systems.' AS summary, 'SQL|Python|Spark' AS skills,
'Staff Engineer@Acme@Jul 2021@Present@Built pipelines|Data Analyst@Bolt Labs@2018@2020@Wrote reports' AS positions, 'Master of Science@State University@Computer Science@2017' AS education""")
def resume_parse(spark, sf_dir):
    docs = spark.createDataFrame([("r", _RESUME_TEXT)], "resume_id string, raw_text string")
    got = resume.parse_resumes(docs)
    at = lambda c, *fs: joined(F.transform(c, lambda x: F.concat_ws("@", *(x[f] for f in fs))))
    return got.select("resume_id", "first_name", "last_name", "email", "phone", "city", "state", "postal_code", "country", "summary", joined("skills").alias("skills"), at("positions", "title", "company", "start_date", "end_date", "description").alias("positions"), at("education", "degree", "school", "major", "graduation_year").alias("education"))


@query(f"SELECT doc_id AS resume_id, lower(text || ' summary sql spark dev acme built bs math state') AS corpus FROM {_D} WHERE text <> ''")
def resume_corpus(spark, sf_dir):
    job, study = '[{"title":"Dev","company":"Acme","description":"built"}]', '[{"degree":"BS","major":"Math","school":"State"}]'
    rows = _docs(spark, sf_dir).where("text != ''").select(
        F.col("doc_id").alias("resume_id"), F.col("text").alias("raw_text"), F.lit("Summary").alias("summary"), F.array(F.lit("SQL"), F.lit("Spark")).alias("skills"),
        F.from_json(F.lit(job), "array<struct<title:string,company:string,description:string>>").alias("positions"), F.from_json(F.lit(study), "array<struct<degree:string,major:string,school:string>>").alias("education"),
    )
    return resume.corpus(rows)


@query("SELECT * FROM (VALUES ('/s/a.html', '1', 0, 'q')) t(form_id, frame_path, field_idx, name)")
def frame_scan(spark, sf_dir):
    pages = _FRAMES.df(spark)
    found = forms.scan_with_frames(pages, pages.where("path = '/s/a.html'"))
    return found.select("form_id", joined(F.col("frame_path").cast("array<string>")).alias("frame_path"), "field_idx", "name")

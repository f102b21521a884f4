"""Source queries: file scans, dispatch, envelopes, statements, fallback,
JSON extraction and text functions (S1-S4, S8, S9, S11, S13, S14, J2, U3,
K7, C36, F9, F14)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerline.functions import parsing as P
from ledgerline.plans import variant_sql as V
from ledgerline.plans.ingest_queries import MU, PU, sql_money, sql_period
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import with_panel
from ledgerline.session import job_folder
from ledgerline.sources import files, variants
from ledgerline.sources.panel import panel
from ledgerline.sources.tables import read_table
from ledgerline.streaming.ingest import MEASURE_SOURCES, run_upload_stream


def uploads_root(spark, sf_dir):
    return files.land_uploads(spark, sf_dir)


REC_SQL = '''upload_id, row_pos, upper(true_ticker) as upload_ticker, "Symbol", "Period", "Total Revenue",
  "Net Profit", "Operating Profit", "Total Assets", "Total Liabilities", "Cash From Operations"'''
CSV_SQL = REC_SQL.replace('"Symbol"', """nullif("Symbol", '') as "Symbol\"""")  # an empty field of a CSV file
TYPE_SQL = "case upload_id % 2 when 0 then 'csv' else 'json' end"


@query("scan_csv", with_panel(f"select {CSV_SQL} from mu where upload_id % 2 = 0", MU))
def scan_csv_q(spark, sf_dir):
    """Header CSV uploads read as text."""
    return files.scan_csv(spark, os.path.join(uploads_root(spark, sf_dir), "csv")).select(*files.RECORD_COLS)


@query("scan_json", with_panel(
    f"select {REC_SQL} from mu where upload_id % 2 = 1 and (upload_id // 2) % 3 = 0", MU))
def scan_json_q(spark, sf_dir):
    """JSON array-of-records uploads."""
    return files.scan_json(spark, os.path.join(uploads_root(spark, sf_dir), "json", "array")) \
        .select(*files.RECORD_COLS)


@query("scan_json_flex", with_panel(f"select {REC_SQL} from mu where upload_id % 2 = 1", MU))
def scan_json_flex_q(spark, sf_dir):
    """S3: shape-tolerant JSON uploads (array / object with a list member /
    single record) through VARIANT."""
    return files.scan_json_flex(spark, os.path.join(uploads_root(spark, sf_dir), "json")) \
        .select(*files.RECORD_COLS)


@query("ingest_dispatch", with_panel(f"""select {CSV_SQL}, 'csv' as source_type from mu where upload_id % 2 = 0
union all select {REC_SQL}, 'json' from mu where upload_id % 2 = 1""", MU))
def ingest_dispatch_q(spark, sf_dir):
    """Reader chosen by source type over all landed uploads."""
    return files.ingest_dispatch(spark, uploads_root(spark, sf_dir))


ENVELOPE_SQL = f"""select 'upload_' || upload_id || '.' || {TYPE_SQL} as source_name,
  arg_min(upper(trim("Symbol")), row_pos) filter (trim("Symbol") <> '') as ticker,
  count(*) as record_count, upload_id
from mu group by upload_id"""


@query("upload_envelope", with_panel(ENVELOPE_SQL, MU))
def upload_envelope_q(spark, sf_dir):
    """Per upload: name, ticker, record count."""
    return files.upload_envelope(files.ingest_dispatch(spark, uploads_root(spark, sf_dir)))


@query("upload_listing", with_panel(f"select * from ({ENVELOPE_SQL}) e where upload_id % 3 = 1", MU))
def upload_listing_q(spark, sf_dir):
    """A user's uploads (u1): file, ticker, records, newest first."""
    env = files.upload_envelope(files.ingest_dispatch(spark, uploads_root(spark, sf_dir)))
    return env.filter(files.upload_user() == "u1").orderBy(F.col("upload_id").desc())


def _best_candidate_sql() -> str:
    strip = "regexp_replace(val, '^\\s+|\\s+$', '', 'g')"
    cols = ("Symbol", "Period", "Total Revenue", "Net Profit", "Operating Profit", "Total Assets",
            "Total Liabilities", "Cash From Operations")
    stmt = "\n    union all ".join(
        f"select upload_id, 0 as cand, '{c}' as col, \"{c}\" as val from recs" for c in cols)
    return with_panel(f"""
, recs as (select * from mu),
cells as (
    {stmt}
    union all select upload_id, 1, 'note', concat_ws(' ', "Symbol", "Period") from recs
    union all select upload_id, 2, 'Period', "Period" from recs
    union all select upload_id, 2, 'Net Profit', "Net Profit" from recs),
colstat as (
  select upload_id, cand, col,
    count(*) filter (where val is not null and trim(val) <> '') as filled,
    count(*) filter (where try_cast({strip} as double) is not null) as numeric
  from cells group by upload_id, cand, col),
score as (
  select upload_id, cand, count(*) filter (where filled > 0 and numeric = filled) as numeric_columns
  from colstat group by upload_id, cand)
select upload_id, arg_max(cand, (numeric_columns, -cand)) as best_candidate,
  max(numeric_columns) as numeric_columns
from score group by upload_id""", MU)


@query("best_candidate_table", _best_candidate_sql())
def best_candidate_table_q(spark, sf_dir):
    """S14 (re-aimed): among candidate tables of a workbook — the statement
    table, a notes table and a two-column summary — pick the one with most
    numeric columns (first on ties).  Numeric = every non-empty value parses."""
    recs = files.ingest_dispatch(spark, uploads_root(spark, sf_dir))
    statement = recs.select("upload_id", F.lit(0).alias("cand"),
                            F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("val"))
                                                for c in files.UPLOAD_COLS])).alias("cv"))
    notes = recs.select("upload_id", F.lit(1).alias("cand"), F.explode(F.array(
        F.struct(F.lit("note").alias("col"), F.concat_ws(" ", "Symbol", "Period").alias("val")))).alias("cv"))
    summary = recs.select("upload_id", F.lit(2).alias("cand"), F.explode(F.array(
        F.struct(F.lit("Period").alias("col"), F.col("Period").alias("val")),
        F.struct(F.lit("Net Profit").alias("col"), F.col("`Net Profit`").alias("val")))).alias("cv"))
    cells = statement.unionByName(notes).unionByName(summary) \
        .select("upload_id", "cand", "cv.col", "cv.val")
    cols = cells.groupBy("upload_id", "cand", "col").agg(
        F.count_if(F.col("val").isNotNull() & (F.trim("val") != "")).alias("filled"),
        F.count_if(P.strip_ws("val").try_cast("double").isNotNull()).alias("numeric"))
    score = cols.groupBy("upload_id", "cand").agg(
        F.count_if((F.col("filled") > 0) & (F.col("numeric") == F.col("filled"))).alias("numeric_columns"))
    return score.groupBy("upload_id").agg(
        F.max_by("cand", F.struct("numeric_columns", (-F.col("cand")).alias("o"))).alias("best_candidate"),
        F.max("numeric_columns").alias("numeric_columns"))


# ------------------------------------------------------------ statements

def _sv_sql() -> str:
    flows = {"totalRevenue": "revenue", "operatingIncome": "operating_income", "netIncome": "net_income",
             "operatingCashflow": "operating_cashflow"}
    stocks = {"totalAssets": "total_assets", "totalLiabilities": "total_liabilities"}
    q = ", ".join(f"cast(cast({s} as decimal(38,6)) as double) as {f}" for f, s in {**flows, **stocks}.items())
    a = ", ".join([f"cast(sum(cast({s} as decimal(38,6))) as double) as {f}" for f, s in flows.items()]
                  + [f"cast(arg_max(cast({s} as decimal(38,6)), date) as double) as {f}" for f, s in stocks.items()])
    bad = f"{V._pm(f'{V.TN} * 5 + year(date) + month(date)', 17)} = 0"
    return f"""
sv0 as (select ticker, date, 1 as rk, {q} from panel
        union all
        select ticker, make_date(year(date), 12, 31), 0, {a} from panel group by ticker, year(date)),
sv as (select ticker, date, case rk when 0 then 'annual' else 'quarterly' end as report_type,
         totalRevenue, netIncome, operatingCashflow, totalAssets, totalLiabilities,
         case when {bad} then null else operatingIncome end as operatingIncome
       from (select *, row_number() over (partition by ticker, date order by rk) as rn from sv0) x where rn = 1)"""


SV = _sv_sql()
_FIELDS = ("netIncome", "operatingCashflow", "operatingIncome", "totalAssets", "totalLiabilities",
           "totalRevenue")


def _flat_sql() -> str:
    parts = []
    for fn, fs in files.STATEMENTS.items():
        cols = ", ".join(f if f in fs else f"null::double as {f}" for f in _FIELDS)
        parts.append(f"select ticker as symbol, '{fn}' as function, date as fiscal_date, report_type, {cols} from sv")
    return "\nunion all ".join(parts)


def flat(spark, sf_dir):
    return files.statement_flatten(spark, files.land_statements(spark, sf_dir))


@query("statement_flatten", with_panel(_flat_sql(), SV))
def statement_flatten_q(spark, sf_dir):
    """Flatten annual ++ quarterly reports, annual wins per fiscal date."""
    f = flat(spark, sf_dir)
    return f.select("symbol", "function", "fiscal_date", "report_type",
                    *[F.col(c).try_cast("double").alias(c) for c in _FIELDS])


@query("merge_statements", with_panel("""
select ticker as symbol, date as fiscal_date, totalRevenue as revenue, coalesce(operatingIncome, 0.0) as operating_income,
  netIncome as net_income, totalAssets as total_assets, totalLiabilities as total_liabilities,
  operatingCashflow as operating_cashflow from sv""", SV))
def merge_statements_q(spark, sf_dir):
    """Income ⋈ balance ⋈ cash flow on (symbol, date), bad -> 0."""
    return files.merge_statements(flat(spark, sf_dir))


@query("common_dates", with_panel("select distinct ticker as symbol, date as fiscal_date from sv", SV))
def common_dates_q(spark, sf_dir):
    """Fiscal dates common to the three statements."""
    return files.common_dates(flat(spark, sf_dir))


# ------------------------------------------------------------ fallback

FALLBACK_BODY = f"""
select upper(true_ticker) as ticker, {sql_period('"Period"')} as date, {sql_money('"Total Revenue"')} as revenue,
  {sql_money('"Net Profit"')} as net_income, {sql_money('"Operating Profit"')} as operating_income,
  {sql_money('"Total Assets"')} as total_assets, {sql_money('"Total Liabilities"')} as total_liabilities,
  {sql_money('"Cash From Operations"')} as operating_cashflow, 'raw_upload' as source
from mu where upload_id % 3 = 1
union all
select ticker, date, revenue, net_income, operating_income, total_assets, total_liabilities, operating_cashflow,
  'standard_table' from pu
where (user_id = 'u1' or user_id = 'predefined')
  and upper(ticker) not in (select distinct upper(true_ticker) from mu where upload_id % 3 = 1)"""


@query("source_fallback", with_panel(FALLBACK_BODY, MU, PU))
def source_fallback_q(spark, sf_dir):
    """A user's raw upload when one exists for the ticker, else the
    user-scoped standard panel, tagged with the source."""
    m = variants.messy_upload(panel(spark, sf_dir)).filter(files.upload_user() == "u1")
    raw = m.select(F.upper("true_ticker").alias("ticker"), P.parse_period_date("Period").alias("date"),
                   *[P.parse_money(src).alias(dst) for dst, src in MEASURE_SOURCES.items()],
                   F.lit("raw_upload").alias("source"))
    keys = raw.select(F.col("ticker").alias("_t")).distinct()
    std = variants.with_users(panel(spark, sf_dir))
    std = std.filter(F.col("user_id").isin("u1", "predefined"))
    std = std.join(keys, F.upper(std["ticker"]) == keys["_t"], "left_anti") \
        .select("ticker", "date", *MEASURE_SOURCES, F.lit("standard_table").alias("source"))
    return raw.unionByName(std)


# ------------------------------------------------------------ JSON and text

def _rec_extract_sql() -> str:
    from ledgerline.plans.scoring_queries import NORM, ssql
    from ledgerline.plans.sqlparts import R
    return ssql(f"""select ticker,
  cast(case when len(reasons) > 0 then least(final_score, 4) else final_score end as bigint) as performance_score,
  case when len(reasons) > 0 and lower(trim(overall_risk)) = 'low' then 'Medium' else overall_risk end as overall_risk,
  {R('predicted_period')} as predicted_growth_rate
from gt""", NORM)


@query("recommendation_extract", _rec_extract_sql())
def recommendation_extract_q(spark, sf_dir):
    """K7: store the recommendation as JSON text and extract the score, the
    overall risk and the predicted growth rate from it (records of the models that SQL
    can state)."""
    from ledgerline.operators import score
    from ledgerline.plans.scoring_queries import fallback_records
    rec = score.normalized_record(*fallback_records(spark, sf_dir))
    js = rec.select("ticker", F.to_json(F.struct(*[c for c in rec.columns if c != "ticker"])).alias("j"))
    return js.select("ticker",
                     F.get_json_object("j", "$.performance_score").cast("bigint").alias("performance_score"),
                     F.get_json_object("j", "$.risk_assessment.overall_risk").alias("overall_risk"),
                     F.get_json_object("j", "$.growth_outlook.predicted_growth_rate").cast("double")
                     .alias("predicted_growth_rate"))


def sql_unfenced(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '^```[A-Za-z]*\\s*', '')"
    return f"regexp_replace(regexp_replace({s}, '\\s*```$', ''), '^\\s+|\\s+$', '', 'g')"


@query("parse_fenced_json", f"""
select conv_id, turn, coalesce(json_valid(t), false) as is_json, case when json_valid(t) then json_type(t) end as json_type
from (select conv_id, turn, {sql_unfenced('text')} as t from conversations) x""")
def parse_fenced_json_q(spark, sf_dir):
    """Strip code fences from every conversation turn and parse it as
    JSON (invalid -> NULL), reporting the top-level type."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    v = F.try_parse_json(P.strip_code_fences("text"))
    return c.select("conv_id", "turn", v.isNotNull().alias("is_json"),
                    F.when(v.isNotNull(), F.schema_of_variant(v)).alias("json_type"))


@query("fenced_records", with_panel("""
select upload_id, row_pos, k < 3 as is_json, case k when 1 then 'ARRAY' when 3 then null else 'OBJECT' end as kind,
  case when k < 3 then "Total Revenue" end as revenue
from (select *, (upload_id + row_pos) % 4 as k from mu) x""", MU))
def fenced_records_q(spark, sf_dir):
    """C36 on answers that hold records: fenced as JSON, fenced as an array, bare, and cut
    off in the middle (no JSON); the revenue is read from what was parsed."""
    m = variants.messy_upload(panel(spark, sf_dir))
    k = F.pmod(F.col("upload_id") + F.col("row_pos"), F.lit(4))
    rec = F.to_json(F.struct(*[F.col(c) for c in files.UPLOAD_COLS]))
    text = (F.when(k == 0, F.concat(F.lit("```json\n"), rec, F.lit("\n```")))
            .when(k == 1, F.concat(F.lit("  ```\n["), rec, F.lit("]\n```\n"))).when(k == 2, rec)
            .otherwise(F.concat(F.lit("```json\n"), F.substring(rec, F.lit(1), F.length(rec) - 3), F.lit("\n```"))))
    d = m.select("upload_id", "row_pos", F.try_parse_json(P.strip_code_fences(text)).alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    return d.select("upload_id", "row_pos", F.col("v").isNotNull().alias("is_json"), F.when(F.col("v").isNotNull(), kind).alias("kind"),
                    F.coalesce(F.variant_get("v", "$['Total Revenue']", "string"),
                               F.variant_get("v", "$[0]['Total Revenue']", "string")).alias("revenue"))


@query("safe_cast", with_panel("""select upload_id, row_pos,
  coalesce(try_cast(regexp_replace("Cash From Operations", '^\\s+|\\s+$', '', 'g') as double), 0.0) as operating_cashflow,
  try_cast(regexp_replace("Net Profit", '^\\s+|\\s+$', '', 'g') as double) as net_income from mu""", MU))
def safe_cast_q(spark, sf_dir):
    """tolerant float parsing with and without a default."""
    m = variants.messy_upload(panel(spark, sf_dir))
    return m.select("upload_id", "row_pos",
                    P.safe_float("Cash From Operations", 0.0).alias("operating_cashflow"),
                    P.safe_float("Net Profit").alias("net_income"))


FLAGS = ("true", " Yes ", "T", "1", "false", "N", "0", "maybe", "", None)


@query("safe_bool", with_panel("""select upload_id, row_pos, flag,
  case when lower(trim(flag)) in ('true', '1', 'yes', 'y', 't') then true
       when lower(trim(flag)) in ('false', '0', 'no', 'n', 'f') then false else false end as strict,
  case when lower(trim(flag)) in ('true', '1', 'yes', 'y', 't') then true
       when lower(trim(flag)) in ('false', '0', 'no', 'n', 'f') then false else true end as lenient
from (select upload_id, row_pos, ([""" + ", ".join("null" if f is None else f"'{f}'" for f in FLAGS)
    + "])[(upload_id + row_pos) % " + str(len(FLAGS)) + """ + 1] as flag from mu) x""", MU))
def safe_bool_q(spark, sf_dir):
    """tolerant booleans, default false and default true, on a flag text per record."""
    m = variants.messy_upload(panel(spark, sf_dir))
    flag = F.get(F.array(*[F.lit(f).cast("string") for f in FLAGS]),
                 F.pmod(F.col("upload_id") + F.col("row_pos"), F.lit(len(FLAGS))).cast("int"))
    m = m.select("upload_id", "row_pos", flag.alias("flag"))
    return m.select("*", P.safe_bool("flag").alias("strict"), P.safe_bool("flag", True).alias("lenient"))


@query("ascii_safe", """select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') as ascii_text,
  length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as replaced
from documents""")
def ascii_safe_q(spark, sf_dir):
    """every non-ASCII character of every whole document -> '?'."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", P.ascii_safe("text").alias("ascii_text"),
                    (F.length("text") - F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")))
                    .cast("bigint").alias("replaced"))


def _stream_sql() -> str:
    from ledgerline.plans.ingest_queries import sql_clean_ticker
    cols = ", ".join(f"{sql_money(chr(34) + src + chr(34))} as {dst}" for dst, src in MEASURE_SOURCES.items())
    return with_panel(f"""
select ticker, date, {", ".join(MEASURE_SOURCES)}, user_id, load_seq from (
  select *, row_number() over (partition by ticker, date, user_id order by load_seq desc) as rn from (
    select coalesce({sql_clean_ticker('"Symbol"')}, upper(true_ticker)) as ticker, {sql_period('"Period"')} as date, {cols},
      case upload_id % 3 when 0 then 'predefined' when 1 then 'u1' else 'u2' end as user_id,
      cast(upload_id as bigint) as load_seq
    from mu) x
  where ticker is not null and date is not null) y
where rn = 1""", MU)


@query("stream_ingest", _stream_sql())
def stream_ingest_q(spark, sf_dir):
    """Incremental upload ingest: Structured Streaming over all landed uploads
    -> normalise -> append -> keep-last per (ticker, date, user) on read."""
    root = uploads_root(spark, sf_dir)
    return run_upload_stream(spark, root, job_folder(spark, "stream_" + os.path.basename(root)))


def _unique_sql() -> str:
    from ledgerline.plans.ingest_queries import CANON
    return with_panel("""
select upload_id, user_id, upper(ticker) as ticker, content_hash, (select count(*) from mu where mu.upload_id = c.upload_id) as records
from canon c where upload_id % 2 = 1 and cast(floor(upload_id / 2) as bigint) % 3 < 2""", MU, CANON)


@query("stream_unique_uploads", _unique_sql())
def stream_unique_uploads_q(spark, sf_dir):
    """A24 in the stream: all landed documents, then all of them landed again under other
    names and the stream restarted; each content is accepted once."""
    import uuid

    from ledgerline.streaming import ingest as stream
    root = uploads_root(spark, sf_dir)
    work = job_folder(spark, "unique_") + uuid.uuid4().hex[:12]
    for _ in range(2):
        for shape in files.JSON_SHAPES[:2]:
            spark.read.text(os.path.join(root, "json", shape)).write.mode("append").text(
                os.path.join(work, "landing", "json", shape))
        stream.append_unique(stream.document_stream(spark, os.path.join(work, "landing")), work)
    u = stream.unique_uploads(spark, work)
    return u.select("upload_id", "user_id", "ticker", "content_hash", F.size("records").cast("bigint").alias("records"))

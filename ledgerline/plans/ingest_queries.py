"""Ingest, table-maintenance and validation queries (C3-C13, C42, F1, K3-K11,
U2, C26, A21-A24, V1-V5) over deterministic variants of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import parsing as P
from ledgerline.functions.numeric import exact_sum, rnd
from ledgerline.operators import ingest, tables, validate
from ledgerline.operators.peers import first_last, latest_row
from ledgerline.plans import variant_sql as V
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, XSUM, with_panel
from ledgerline.sources import variants
from ledgerline.sources.files import UPLOAD_COLS, upload_user
from ledgerline.sources.panel import engineer_features, panel

# ------------------------------------------------------------------ SQL parsers


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_money(x: str) -> str:
    s0 = sql_strip(x)
    s1 = f"(case when {s0} in ('', 'nan', 'none', 'null') then null else {s0} end)"
    s2 = f"regexp_replace({s1}, '^\\((.*)\\)$', '-\\1')"
    s3 = f"replace(regexp_replace({s2}, '[,$€£₹\\s]', '', 'g'), '%', '')"
    suf = f"upper(regexp_extract({s3}, '([KMBTkmbt])$', 1))"
    mult = (f"(case {suf} when 'K' then 1000.0 when 'M' then 1000000.0 when 'B' then 1000000000.0 "
            f"when 'T' then 1000000000000.0 else 1.0 end)")
    s5 = f"regexp_replace({s3}, '[KMBTkmbt]$', '')"
    return f"(try_cast({s5} as double) * {mult})"


def sql_period(x: str) -> str:
    s = sql_strip(x)
    p1, p2 = "'^(\\d{4})[-\\s]?Q([1-4])$'", "'^Q([1-4])[-\\s]?(\\d{4})$'"

    def qe(y, q):
        return f"last_day(make_date(cast({y} as integer), cast({q} as integer) * 3, 1))"
    fmts = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S"]
    general = "coalesce(" + ", ".join(f"cast(try_strptime({s}, '{f}') as date)" for f in fmts) + ")"
    return f"""(case when regexp_matches({s}, {p1}) then {qe(f"regexp_extract({s}, {p1}, 1)", f"regexp_extract({s}, {p1}, 2)")}
      when regexp_matches({s}, {p2}) then {qe(f"regexp_extract({s}, {p2}, 2)", f"regexp_extract({s}, {p2}, 1)")}
      when regexp_matches({s}, '^\\d{{4}}$') then make_date(cast({s} as integer), 12, 31)
      else {general} end)"""


def sql_clean_ticker(x: str) -> str:
    t = f"upper({sql_strip(x)})"
    return f"(case when {t} in ('', 'NAN', 'NONE') then null else {t} end)"


def messy(spark, sf_dir):
    return variants.messy_upload(panel(spark, sf_dir))


MU = V.messy_cte()

# ------------------------------------------------------------------ parsing


@query("parse_money", with_panel(f"""select upload_id, row_pos, "Total Revenue" as raw,
  {sql_money('"Total Revenue"')} as revenue from mu""", MU))
def parse_money_q(spark, sf_dir):
    """C11: financial number parser on every revenue string."""
    m = messy(spark, sf_dir)
    return m.select("upload_id", "row_pos", F.col("Total Revenue").alias("raw"),
                    P.parse_money("Total Revenue").alias("revenue"))


@query("parse_period_date", with_panel(f"""select upload_id, row_pos, "Period" as raw,
  {sql_period('"Period"')} as date from mu""", MU))
def parse_period_date_q(spark, sf_dir):
    """period/quarter/ISO date parser."""
    m = messy(spark, sf_dir)
    return m.select("upload_id", "row_pos", F.col("Period").alias("raw"),
                    P.parse_period_date("Period").alias("date"))


@query("clean_ticker", with_panel(f"""select upload_id, row_pos, "Symbol" as raw,
  {sql_clean_ticker('"Symbol"')} as ticker from mu""", MU))
def clean_ticker_q(spark, sf_dir):
    """ticker normalisation."""
    m = messy(spark, sf_dir)
    return m.select("upload_id", "row_pos", F.col("Symbol").alias("raw"),
                    P.clean_ticker("Symbol").alias("ticker"))


@query("fill_ticker", with_panel("""select upload_id, row_pos,
  case when "Symbol" is null or "Symbol" = '' then true_ticker else "Symbol" end as ticker from mu""", MU))
def fill_ticker_q(spark, sf_dir):
    """Empty / NULL ticker -> the upload's ticker parameter."""
    m = ingest.normalize_headers(messy(spark, sf_dir))
    m = ingest.alias_map(m)
    t = F.col("ticker")
    return m.select("upload_id", "row_pos",
                    F.when(t.isNull() | (t == ""), F.col("true_ticker")).otherwise(t).alias("ticker"))


@query("fill_ticker_first", with_panel(f"""select upload_id, row_pos,
  coalesce(t, first(t ignore nulls) over (partition by upload_id order by row_pos
           rows between unbounded preceding and unbounded following), 'UNKNOWN') as ticker
from (select *, {sql_clean_ticker('"Symbol"')} as t from mu) x""", MU))
def fill_ticker_first_q(spark, sf_dir):
    """NULL ticker -> first valid ticker of its upload, else a parameter."""
    m = messy(spark, sf_dir).select("upload_id", "row_pos",
                                    P.clean_ticker("Symbol").alias("ticker"))
    return ingest.fill_ticker_first(m, "upload_id", "row_pos", "UNKNOWN").select(
        "upload_id", "row_pos", "ticker")


def _norm_cols_sql(money: bool) -> str:
    conv = sql_money if money else (lambda x: f"try_cast({sql_strip(x)} as double)")
    return ", ".join([
        "upload_id", "row_pos",
        "case when \"Symbol\" is null or \"Symbol\" = '' then true_ticker else \"Symbol\" end as ticker",
        f"{sql_period('\"Period\"')} as date",
        f"{conv('\"Total Revenue\"')} as revenue", f"{conv('\"Net Profit\"')} as net_income",
        f"{conv('\"Operating Profit\"')} as operating_income",
        f"{conv('\"Total Assets\"')} as total_assets",
        f"{conv('\"Total Liabilities\"')} as total_liabilities",
        f"{conv('\"Cash From Operations\"')} as operating_cashflow"])


NORM_OUT = ("upload_id", "row_pos", "ticker", "date", "revenue", "net_income", "operating_income",
            "total_assets", "total_liabilities", "operating_cashflow")


def normalized(spark, sf_dir, *extra):
    """C13 over all uploads; ``extra`` columns of the upload are carried along."""
    m = messy(spark, sf_dir)
    d = ingest.alias_map(ingest.normalize_headers(m))
    d = ingest.fill_ticker(d, "__param__")
    d = d.withColumn("ticker", F.when(F.col("ticker") == "__param__", F.col("true_ticker"))
                     .otherwise(F.col("ticker")))
    cols = {"date": P.parse_period_date("date")}
    cols.update({c: P.parse_money(c) for c in NORM_OUT[4:]})
    return d.withColumns(cols).select(*NORM_OUT, *extra)


@query("normalize_raw", with_panel(f"select {_norm_cols_sql(True)} from mu", MU))
def normalize_raw_q(spark, sf_dir):
    """C13 (C3 + C4 + C5 + C12 + C11): whole raw normalisation."""
    return normalized(spark, sf_dir)


@query("coerce_types", with_panel(f"select {_norm_cols_sql(False)} from mu", MU))
def coerce_types_q(spark, sf_dir):
    """Plain type coercion (unparseable -> NULL, no money rules)."""
    m = messy(spark, sf_dir)
    d = ingest.alias_map(ingest.normalize_headers(m))
    t = F.col("ticker")
    d = d.withColumn("ticker", F.when(t.isNull() | (t == ""), F.col("true_ticker")).otherwise(t))
    return ingest.coerce_types(d).select(*NORM_OUT)


@query("normalize_headers", with_panel("""select upload_id, row_pos, true_ticker, "Symbol" as ticker, "Period" as date,
  "Total Revenue" as revenue, "Net Profit" as net_income, "Operating Profit" as operating_income,
  "Total Assets" as total_assets, "Total Liabilities" as total_liabilities,
  "Cash From Operations" as operating_cashflow from mu""", MU))
def normalize_headers_q(spark, sf_dir):
    """C3 + C4: header rule and alias resolution on the raw upload (schema
    only; the rows pass through)."""
    return ingest.alias_map(ingest.normalize_headers(messy(spark, sf_dir)))


@query("scale_units", with_panel(f"""select ticker, date,
  case {V._pm(V.TN, 4)} when 0 then 'units' when 1 then 'thousands' when 2 then 'millions' else 'billions' end as unit,
  revenue * (case {V._pm(V.TN, 4)} when 0 then 1.0 when 1 then 1000.0 when 2 then 1000000.0 else 1000000000.0 end) as revenue,
  net_income * (case {V._pm(V.TN, 4)} when 0 then 1.0 when 1 then 1000.0 when 2 then 1000000.0 else 1000000000.0 end) as net_income
from panel"""))
def scale_units_q(spark, sf_dir):
    """Declared units -> full currency units."""
    p = panel(spark, sf_dir)
    r = F.pmod(variants.ticker_no(), F.lit(4))
    p = p.withColumn("unit", F.when(r == 0, "units").when(r == 1, "thousands")
                     .when(r == 2, "millions").otherwise("billions"))
    return ingest.scale_units(p).select("ticker", "date", "unit", "revenue", "net_income")


@query("infer_ticker", with_panel("""
select upload_id, ticker, 'file data' as source from (
  select upload_id, v as ticker, row_number() over (partition by upload_id order by n desc, v) as rn
  from (select upload_id, v, count(*) as n from (
          select upload_id, upper(regexp_replace("Symbol", '^\\s+|\\s+$', '', 'g')) as v from mu) x
        where v is not null and v <> '' and length(v) <= 12 and not contains(v, ' ')
        group by upload_id, v) y) z
where rn = 1
union all
select upload_id, 'UNKNOWN', 'fallback' from mu group by upload_id
having count(*) filter (where length(upper(regexp_replace("Symbol", '^\\s+|\\s+$', '', 'g'))) between 1 and 12
                        and not contains(upper(regexp_replace("Symbol", '^\\s+|\\s+$', '', 'g')), ' ')) = 0""", MU))
def infer_ticker_q(spark, sf_dir):
    """Ticker vote per upload (no file name here -> UNKNOWN fallback)."""
    m = ingest.normalize_headers(messy(spark, sf_dir))
    return ingest.infer_ticker(m, "upload_id")


@query("upload_summary", with_panel(f"""
select upload_id, count(*) as records, 8 as columns, 6 as numeric_fields,
  {R(XSUM('revenue'), 2)} as total_revenue
from (select upload_id, {sql_money('"Total Revenue"')} as revenue from mu) x group by upload_id""", MU))
def upload_summary_q(spark, sf_dir):
    """Records, columns, numeric fields and total revenue per upload."""
    d = normalized(spark, sf_dir)
    ncols = len(NORM_OUT) - 2
    nnum = len(NORM_OUT) - 4
    return d.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("records"), F.lit(ncols).alias("columns"),
        F.lit(nnum).alias("numeric_fields"), rnd(exact_sum("revenue"), 2).alias("total_revenue"))


# ------------------------------------------------------------ table maintenance

PU = V.users_cte()
PUD = V.users_cte("pd2", "pud")
PD2 = V.dup_cte()
_PCOLS = "ticker, sector, date, revenue, operating_income, net_income, total_assets, total_liabilities, operating_cashflow"


def users_dups(spark, sf_dir):
    return variants.with_users(variants.with_duplicates(panel(spark, sf_dir)))


@query("dedupe_keep_last", with_panel(f"""
select {_PCOLS}, load_seq, user_id from (
  select *, row_number() over (partition by ticker, date, user_id order by load_seq desc) as rn from pud) x
where rn = 1""", PD2, PUD))
def dedupe_keep_last_q(spark, sf_dir):
    """K5: keep-last dedupe on (ticker, date, user_id)."""
    return tables.dedupe_keep_last(users_dups(spark, sf_dir))


@query("upsert_panel", with_panel(f"""
select {_PCOLS}, user_id, 1 as load_seq from pu e
where not exists (select 1 from pud n where n.load_seq = 2 and n.ticker = e.ticker and n.date = e.date
                  and n.user_id = e.user_id)
union all select {_PCOLS}, user_id, load_seq from pud where load_seq = 2""", PU, PD2, PUD))
def upsert_panel_q(spark, sf_dir):
    """K3: keep-last merge of re-delivered rows into the panel."""
    p = panel(spark, sf_dir)
    existing = variants.with_users(p).withColumn("load_seq", F.lit(1))
    new = users_dups(spark, sf_dir).filter(F.col("load_seq") == 2)
    return tables.upsert(existing, new).select(*_PCOLS.split(", "), "user_id", "load_seq")


@query("user_scope", with_panel(f"select {_PCOLS}, user_id from pu where user_id = 'u1' or user_id = 'predefined'", PU))
def user_scope_q(spark, sf_dir):
    """Own rows ∪ predefined rows."""
    return tables.user_scope(variants.with_users(panel(spark, sf_dir)), "u1") \
        .select(*_PCOLS.split(", "), "user_id")


UPLOADS = f"""
up as (select distinct {V.TN} as upload_id, ticker,
         case {V._pm(V.TN, 3)} when 0 then 'predefined' when 1 then 'u1' else 'u2' end as user_id
       from panel)"""


def uploads(spark, sf_dir):
    p = panel(spark, sf_dir)
    return variants.with_users(p).select(variants.ticker_no().alias("upload_id"), "ticker",
                                         "user_id").distinct()


@query("accessible_tickers", with_panel("""
select ticker from pu where user_id = 'predefined'
union select ticker from up where user_id = 'u1'""", PU, UPLOADS))
def accessible_tickers_q(spark, sf_dir):
    """Predefined tickers ∪ the user's upload tickers."""
    return tables.accessible_tickers(variants.with_users(panel(spark, sf_dir)),
                                     uploads(spark, sf_dir), "u1")


@query("delete_scope", with_panel("""
select 'standard_table' as table_name, count(*) as deleted from pu
  where user_id = 'u1' and upper(ticker) = 'SUPPLIER#000000001'
union all select 'uploaded_files', count(*) from up
  where user_id = 'u1' and upper(ticker) = 'SUPPLIER#000000001'""", PU, UPLOADS))
def delete_scope_q(spark, sf_dir):
    """K8: rows removed per table by a (user, ticker) delete."""
    return tables.delete_scope({"standard_table": variants.with_users(panel(spark, sf_dir)),
                                "uploaded_files": uploads(spark, sf_dir)},
                               "u1", "Supplier#000000001")


@query("reload_verify", with_panel("select ticker, count(*) as row_count from panel group by ticker"))
def reload_verify_q(spark, sf_dir):
    """K9: per-ticker row counts after a reload."""
    return tables.reload_verify(panel(spark, sf_dir))


@query("replace_by_ticker", with_panel(f"""
select ticker, date, revenue, null::varchar as source from (
  select ticker, date, revenue, row_number() over (partition by ticker order by date desc) as rn from panel) l
where rn = 1 and {V._pm(V.TN, 5)} <> 0
union all
select ticker, min(date), arg_min(revenue, date), 'refresh' from panel where {V._pm(V.TN, 5)} = 0 group by ticker"""))
def replace_by_ticker_q(spark, sf_dir):
    """Replace a report's rows for a set of tickers (case-insensitive)."""
    p = panel(spark, sf_dir)
    report = latest_row(p).select("ticker", "date", "revenue")
    fl = first_last(p.filter(F.pmod(variants.ticker_no(), F.lit(5)) == 0))
    new = fl.select(F.lower("ticker").alias("ticker_l"), "ticker", F.col("first_date").alias("date"),
                    F.col("first_revenue").alias("revenue"), F.lit("refresh").alias("source"))
    out = tables.replace_by_ticker(report, new.drop("ticker_l"), new.select(F.col("ticker_l").alias("ticker")))
    return out.select("ticker", "date", "revenue", "source")


@query("duplicate_keys", with_panel("""select ticker, date, count(*) as n from pd2
group by ticker, date having count(*) > 1""", PD2))
def duplicate_keys_q(spark, sf_dir):
    """V5: (ticker, date) keys occurring more than once."""
    return tables.duplicate_keys(variants.with_duplicates(panel(spark, sf_dir)))


CANON = """
canon as (select upload_id, ticker, user_id,
            sha256(cast(to_json(list(rec order by row_pos)) as varchar)) as content_hash
          from (select upload_id, row_pos, true_ticker as ticker,
                  case {u} when 0 then 'predefined' when 1 then 'u1' else 'u2' end as user_id,
                  {{{fields}}} as rec
                from mu) x
          group by upload_id, ticker, user_id)""".format(
    u=V._pm("upload_id", 3), fields=", ".join(f"'{c}': \"{c}\"" for c in sorted(UPLOAD_COLS)))


def canonical_hashes(spark, sf_dir):
    m = messy(spark, sf_dir).withColumnRenamed("true_ticker", "ticker").withColumn("user_id", upload_user())
    return tables.content_hash(m, ["upload_id", "ticker", "user_id"], "row_pos", UPLOAD_COLS)


@query("content_hash", with_panel("select * from canon", MU, CANON))
def content_hash_q(spark, sf_dir):
    """SHA-256 fingerprint of each upload's canonical JSON (keys sorted,
    NULL fields kept, records in upload order)."""
    return canonical_hashes(spark, sf_dir)


@query("duplicate_uploads", with_panel("""
select c.upload_id, c.ticker, c.user_id from canon c
where exists (select 1 from canon e where e.user_id = c.user_id and e.ticker = c.ticker
              and e.content_hash = c.content_hash and e.upload_id % 4 = 0)""", MU, CANON))
def duplicate_uploads_q(spark, sf_dir):
    """Uploads matching an already stored (user, ticker, hash); stored
    set = every 4th upload (full semi-join, no row cap)."""
    h = canonical_hashes(spark, sf_dir)
    existing = h.filter(F.pmod("upload_id", F.lit(4)) == 0)
    return tables.duplicate_uploads(h, existing).select("upload_id", "ticker", "user_id")


# ------------------------------------------------------------------ validation

PN = V.nulls_cte()
PNE = V.engineered_cte("pn", "pne")
PND = V.dup_cte("pn", "pnd")


def nulls_std(spark, sf_dir):
    return engineer_features(variants.with_nulls(panel(spark, sf_dir)))


def _pct0_sql(p: str) -> str:
    return f"cast(round(({p}) * 100) as bigint) || '%'"


def _v1_sql() -> str:
    def null_pct(f):
        return f"(count(*) filter (where {f} is null) / count(*))"
    parts = [f"""select ticker as batch, 'CRITICAL' as severity, 'records' as field, null::double as pct,
      printf('CRITICAL: Only %d records found. Need at least %d periods for trend analysis.', count(*), 3) as message
      from pnd group by ticker having count(*) < 3"""]
    for f in validate.REQUIRED_FOR_ML:
        parts.append(f"""select ticker, 'CRITICAL', '{f}', {R(null_pct(f), 6)},
          printf('CRITICAL: ''%s'' is null in %s of records — SVR pipeline will fail.', '{f}', {_pct0_sql(null_pct(f))})
          from pnd group by ticker having {null_pct(f)} > 0.3""")
    for f in validate.REQUIRED_FOR_ANALYSIS:
        parts.append(f"""select ticker, 'WARNING', '{f}', {R(null_pct(f), 6)},
          printf('WARNING: ''%s'' is null in %s of records — some analysis modules will be skipped.', '{f}', {_pct0_sql(null_pct(f))})
          from pnd group by ticker having {null_pct(f)} > 0.5""")
    parts.append("""select ticker, 'WARNING', 'ticker,date', null::double,
      printf('WARNING: %d duplicate (ticker, date) pairs detected.', count(*))
      from (select ticker, date from pnd where date is not null group by ticker, date having count(*) > 1) d
      group by ticker""")
    parts.append("""select ticker, 'CRITICAL', 'revenue', null::double,
      'CRITICAL: All revenue values are zero — data extraction likely failed.'
      from pnd group by ticker having count(revenue) > 0 and max(abs(revenue)) = 0""")
    return "\nunion all ".join(parts)


@query("validate_records", with_panel(_v1_sql(), PN, PND))
def validate_records_q(spark, sf_dir):
    """V1: record gate per ticker batch on the NULL + duplicate variant."""
    d = variants.with_duplicates(variants.with_nulls(panel(spark, sf_dir)))
    return validate.validate_records(d)


def _v2_sql() -> str:
    parts = []
    for f in validate.ENGINEERED:
        lim = 0.5 if f in validate.GROWTH else 0.3
        p = f"(count(*) filter (where {f} is null) / count(*))"
        parts.append(f"""select ticker as batch, case when {p} > {lim} then 'CRITICAL' else 'INFO' end as severity,
          '{f}' as field, {R(p, 6)} as pct,
          case when {p} > {lim} then printf('CRITICAL: ''%s'' is null in %s of records (max allowed: %d%%).', '{f}', {_pct0_sql(p)}, {int(lim * 100)})
               else printf('Feature ''%s'': %d/%d rows NULL (%s)', '{f}', count(*) filter (where {f} is null), count(*), {_pct0_sql(p)}) end as message
          from pne group by ticker having {p} > 0""")
    req = " and ".join(f"{f} is not null" for f in validate.REQUIRED_FOR_ML + validate.ENGINEERED)
    parts.append(f"""select ticker, case when clean < 3 then 'CRITICAL' else 'OK' end, 'records', null::double,
      case when clean < 3 then printf('CRITICAL: After removing rows with any NULL values, only %d records remain (need ≥%d).', clean, 3)
           when clean < n then printf('Data ready: Using %d clean records (%d rows with NULL values will be skipped)', clean, n - clean)
           else printf('All %d records are complete with no NULL values', clean) end
      from (select ticker, count(*) as n, count(*) filter (where {req}) as clean from pne group by ticker) c""")
    return "\nunion all ".join(parts)


@query("validate_features", with_panel(_v2_sql(), PN, PNE))
def validate_features_q(spark, sf_dir):
    """V2: engineered-feature gate per ticker."""
    return validate.validate_features(nulls_std(spark, sf_dir))


@query("prepare_training", with_panel("""
select ticker, coalesce(case when date is null then 'date' when ticker is null then 'ticker'
  when revenue is null then 'revenue' when net_income is null then 'net_income'
  when operating_income is null then 'operating_income' when total_assets is null then 'total_assets'
  when total_liabilities is null then 'total_liabilities' when operating_cashflow is null then 'operating_cashflow'
  end, '(kept)') as field, count(*) as rows
from pn group by all""", PN))
def prepare_training_q(spark, sf_dir):
    """V3: rows removed per first-missing required field, and rows kept."""
    return validate.prepare_training(variants.with_nulls(panel(spark, sf_dir)))


# ------------------------------------------------------------ committed changes


def _stored(spark, name: str, df, key=tables.PANEL_KEY):
    """A fresh stored table with `df` in it."""
    import uuid

    from ledgerline.session import job_folder
    from ledgerline.sources.store import StoredTable
    t = StoredTable(spark, f"{job_folder(spark, name)}-{uuid.uuid4().hex[:12]}", key, 16)
    t.reload(df)
    return t


def _stored_users(spark, sf_dir, name):
    p = variants.with_users(panel(spark, sf_dir)).withColumn("load_seq", F.lit(1))
    return _stored(spark, name, p.select(*_PCOLS.split(", "), "user_id", "load_seq"))


@query("committed_upsert", with_panel(f"""
select {_PCOLS}, user_id, 1 as load_seq from pu e
where not exists (select 1 from pud n where n.load_seq = 2 and n.ticker = e.ticker and n.date = e.date
                  and n.user_id = e.user_id)
union all select {_PCOLS}, user_id, load_seq from pud where load_seq = 2""", PU, PD2, PUD))
def committed_upsert_q(spark, sf_dir):
    """K3 on a stored table: re-delivered rows are committed to their buckets and the
    folder is read back."""
    t = _stored_users(spark, sf_dir, "upsert")
    t.upsert(users_dups(spark, sf_dir).filter(F.col("load_seq") == 2).select(*_PCOLS.split(", "), "user_id", "load_seq"))
    return t.read()


@query("committed_delete", with_panel("""
select 'standard_table' as table_name, ticker, user_id, count(*) as row_count from pu
  where not (user_id = 'u1' and upper(ticker) = 'SUPPLIER#000000001') group by ticker, user_id
union all select 'uploaded_files', ticker, user_id, count(*) from up
  where not (user_id = 'u1' and upper(ticker) = 'SUPPLIER#000000001') group by ticker, user_id""", PU, UPLOADS))
def committed_delete_q(spark, sf_dir):
    """K8 on stored tables: a user's ticker is deleted from each, and the folders are
    read back."""
    from ledgerline.sources.store import delete_user_ticker
    stored = {"standard_table": _stored_users(spark, sf_dir, "delete"),
              "uploaded_files": _stored(spark, "delete_uploads", uploads(spark, sf_dir), ("upload_id",))}
    delete_user_ticker(stored, "u1", "Supplier#000000001")
    parts = [t.read().groupBy("ticker", "user_id").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(n).alias("table_name"), "ticker", "user_id", "row_count") for n, t in stored.items()]
    return parts[0].unionByName(parts[1])


@query("committed_replace", with_panel(f"""
select ticker, date, revenue, null::varchar as source from (
  select ticker, date, revenue, row_number() over (partition by ticker order by date desc) as rn from panel) l
where rn = 1 and {V._pm(V.TN, 5)} <> 0
union all
select ticker, min(date), arg_min(revenue, date), 'refresh' from panel where {V._pm(V.TN, 5)} = 0 group by ticker"""))
def committed_replace_q(spark, sf_dir):
    """K11 on a stored report: the rows of some tickers are replaced and the folder is
    read back."""
    p = panel(spark, sf_dir)
    report = latest_row(p).select("ticker", "date", "revenue", F.lit(None).cast("string").alias("source"))
    t = _stored(spark, "replace", report, ("ticker",))
    fl = first_last(p.filter(F.pmod(variants.ticker_no(), F.lit(5)) == 0))
    new = fl.select("ticker", F.col("first_date").alias("date"), F.col("first_revenue").alias("revenue"),
                    F.lit("refresh").alias("source"))
    t.replace_tickers(new, new.select(F.lower("ticker").alias("ticker")))
    return t.read()


@query("committed_reload", with_panel("""
select count(*) as written, count(distinct ticker) as tickers, count(*) as stored from panel"""))
def committed_reload_q(spark, sf_dir):
    """K9 on a stored table: the rows counted while they are written, against the folder."""
    p = panel(spark, sf_dir)
    t = _stored(spark, "reload", p, ("ticker", "date"))
    seen = t.reload(p)
    return t.read().agg(F.lit(int(seen["rows"])).cast("bigint").alias("written"), F.count_distinct("ticker").alias("tickers"),
                        F.count(F.lit(1)).alias("stored"))


@query("prepared_rows", with_panel("""
select coalesce(case when date is null then 'date' when ticker is null then 'ticker'
  when revenue is null then 'revenue' when net_income is null then 'net_income'
  when operating_income is null then 'operating_income' when total_assets is null then 'total_assets'
  when total_liabilities is null then 'total_liabilities' when operating_cashflow is null then 'operating_cashflow'
  end, '(kept)') as field, count(*) as rows
from pn group by all""", PN))
def prepared_rows_q(spark, sf_dir):
    """V3 while writing: the kept rows go to a table, and how many each required field
    removed is observed in the same pass."""
    import uuid

    from ledgerline.session import job_folder
    path = f"{job_folder(spark, 'prepared')}-{uuid.uuid4().hex[:12]}"
    counts = validate.write_prepared(variants.with_nulls(panel(spark, sf_dir)), path)
    return spark.createDataFrame([(f, n) for f, n in counts.items() if n], "field string, rows long")


@query("batch_gate", with_panel("""
select count(*) as n, count(*) filter (where revenue is null) as nulls_revenue,
  count(*) filter (where net_income is null) as nulls_net_income,
  count(*) filter (where total_assets is null) as nulls_total_assets,
  count(*) filter (where date is null) as nulls_date, count(*) filter (where ticker is null) as nulls_ticker,
  count(*) filter (where operating_income is null) as nulls_operating_income,
  count(*) filter (where total_liabilities is null) as nulls_total_liabilities,
  count(*) filter (where operating_cashflow is null) as nulls_operating_cashflow,
  count(*) >= 3 and not coalesce(max(abs(revenue)) = 0, false) and count(*) filter (where revenue is null) <= 0.3 * count(*)
    and count(*) filter (where net_income is null) <= 0.3 * count(*)
    and count(*) filter (where total_assets is null) <= 0.3 * count(*) and count(*) filter (where date is null) <= 0.3 * count(*)
    and count(*) filter (where ticker is null) <= 0.3 * count(*) as valid
from pn""", PN))
def batch_gate_q(spark, sf_dir):
    """V1 while landing: the counts of the record gate for a whole batch, observed while
    the batch is written."""
    import uuid

    from ledgerline.session import job_folder
    path = f"{job_folder(spark, 'landed')}-{uuid.uuid4().hex[:12]}"
    got = validate.land_batch(variants.with_nulls(panel(spark, sf_dir)), path)
    return spark.createDataFrame([got])

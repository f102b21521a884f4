"""Deterministic scoring and recommendations.

Everything is column expressions over one row per ticker (signals joined on
the ticker key); arrays of texts are built with ``array_compact(array(when
...))``.  The language-model step of the reference is replaced by the
deterministic fallback rule set (R7) as the base recommendation that R3
normalises.  Numbers shown in texts are rounded before formatting so the
text is engine-independent.  Labels, thresholds and texts below are fixed
values of the reference behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.finance import clip01
from ledgerline.functions.numeric import col_, rnd

GATE_MIN_R2 = 0.20
GATE_MIN_TEST_SIZE = 12
GATE_WARNING = ("Forecast reliability gate is active. Recommendations are intentionally restricted "
                "to conservative guidance (HOLD + validation actions) until model quality improves.")
GATE_WARNING_2 = ("Forecast reliability is low; recommendation confidence is constrained "
                  "until model fit improves and beats naive baseline.")
COMPONENTS = ("growth_quality", "target_attainment", "model_fit", "naive_lift", "stability",
              "risk_quality")
BASE_WEIGHTS = {"growth_quality": 0.22, "target_attainment": 0.18, "model_fit": 0.24,
                "naive_lift": 0.16, "stability": 0.10, "risk_quality": 0.10}
QUALITY_SCALED = ("growth_quality", "target_attainment")
ANOMALY_KEYWORDS = r"drop|anomal|decline|risk"


def fmt1(x) -> Column:
    return F.format_string("%.1f", rnd(col_(x), 1))


def fmt2(x) -> Column:
    return F.format_string("%.2f", rnd(col_(x), 2))


def confidence_from_r2(r2) -> Column:
    r = col_(r2)
    return F.when(r >= 0.7, "High").when(r >= 0.4, "Medium").otherwise("Low")


def risk_component(risk) -> Column:
    r = F.lower(F.trim(F.coalesce(col_(risk), F.lit("Medium"))))
    return F.when(r == "low", 0.85).when(r == "high", 0.25).otherwise(0.55)


def calibrated_score(df: DataFrame, pred_annual="predicted_annual", gap_annual="gap_annual",
                     r2="r2", risk="overall_risk", mae="mae", naive_mae="naive_mae",
                     residual_std="residual_std", rmse="rmse") -> DataFrame:
    """Six clipped components, quality-scaled weights normalised to 1,
    raw = 1 + 9·Σ w·c, final = clamp(round-half-even(raw), 1, 10)."""
    r = F.col(r2)
    comp = {
        "growth_quality": clip01((F.col(pred_annual) + 15.0) / 30.0),
        "target_attainment": clip01((F.col(gap_annual) + 10.0) / 20.0),
        "model_fit": clip01((r + 0.25) / 0.75),
        "naive_lift": F.when(F.col(naive_mae).isNotNull() & (F.abs(naive_mae) > 1e-9)
                             & F.col(mae).isNotNull(),
                             clip01((F.col(naive_mae) - F.col(mae)) / F.abs(naive_mae) + 0.5))
        .otherwise(F.lit(0.5)),
        "stability": F.when(F.col(residual_std).isNotNull() & F.col(rmse).isNotNull(),
                            clip01(1.0 - F.abs(residual_std) /
                                   F.greatest(F.abs(rmse) * 1.5, F.lit(1e-6))))
        .otherwise(F.lit(0.5)),
        "risk_quality": risk_component(F.col(risk)),
    }
    qf = clip01(r + 0.5)
    w = {k: (F.lit(v) * qf if k in QUALITY_SCALED else F.lit(v)) for k, v in BASE_WEIGHTS.items()}
    wsum = sum(w.values())
    cols = {f"c_{k}": v for k, v in comp.items()}
    cols.update({f"w_{k}": w[k] / wsum for k in COMPONENTS})
    cols["quality_factor"] = qf
    d = df.withColumns(cols)
    raw = 1.0 + 9.0 * sum(F.col(f"w_{k}") * F.col(f"c_{k}") for k in COMPONENTS)
    d = d.withColumn("raw_score", raw)
    return d.withColumn("final_score", F.least(F.lit(10), F.greatest(
        F.lit(1), F.bround("raw_score", 0).cast("int"))))


def gate_reasons(reliability="model_reliability", r2="r2", test_size="test_size",
                 beats_naive="beats_naive") -> Column:
    """R2: reliability-gate reasons (empty array = gate not triggered)."""
    return F.array_compact(F.array(
        F.when(F.lower(F.trim(F.col(reliability))) == "low", F.lit("model_reliability_low")),
        F.when(F.col(r2) < GATE_MIN_R2, F.lit("r2_below_threshold")),
        F.when(F.col(test_size) < GATE_MIN_TEST_SIZE, F.lit("insufficient_holdout_samples")),
        F.when(~F.coalesce(F.col(beats_naive), F.lit(False)), F.lit("does_not_beat_naive"))))


# ------------------------------------------------------------------ R6 / R7


def yearly_rows(frame: DataFrame) -> DataFrame:
    """Last row of every (ticker, year) plus the previous such row's revenue
    (the last row of the latest earlier year)."""
    g = frame.groupBy("ticker", F.year("date").alias("year")).agg(
        F.max_by(F.struct("date", "revenue", "profit_margin", "debt_ratio",
                          "operating_cashflow", "net_income"), "date").alias("r"))
    g = g.select("ticker", "year", "r.*")
    w = Window.partitionBy("ticker").orderBy("year")
    return g.withColumn("prev_revenue", F.lag("revenue").over(w))


def light_recommendation(frame: DataFrame) -> DataFrame:
    """R6 for every ticker-year: strengths / risks / actions and status.
    ``frame`` carries fractional ``profit_margin`` and ``debt_ratio``."""
    return _rules(yearly_rows(frame))


def latest_recommendation(frame: DataFrame) -> DataFrame:
    """R6 for the latest year of each ticker: the year is chosen before any text is built."""
    y = yearly_rows(frame)
    rest = [c for c in y.columns if c != "ticker"]
    return _rules(y.groupBy("ticker").agg(F.max_by(F.struct(*rest), "year").alias("l")).select("ticker", "l.*"))


def _rules(y: DataFrame) -> DataFrame:
    pm, dr = F.coalesce("profit_margin", F.lit(0.0)), F.coalesce("debt_ratio", F.lit(0.0))
    ni, ocf = F.coalesce("net_income", F.lit(0.0)), F.coalesce("operating_cashflow", F.lit(0.0))
    cash_ratio = F.when(ni != 0, ocf / F.abs(ni)).otherwise(F.lit(0.0))
    pr = F.col("prev_revenue")
    rg = F.when(pr.isNotNull() & (pr != 0), (F.col("revenue") - pr) / F.abs(pr) * 100)
    strengths = F.array_compact(F.array(
        F.when(pm >= 0.15, F.concat(F.lit("Healthy profitability with ~"), fmt1(pm * 100), F.lit("% margin.")))
        .when(pm >= 0.05, F.concat(F.lit("Positive profitability ("), fmt1(pm * 100), F.lit("%), room to expand."))),
        F.when(dr <= 0.4, F.concat(F.lit("Manageable leverage (debt ratio "), fmt1(dr * 100), F.lit("%)."))),
        F.when(cash_ratio >= 1.0, F.lit("Operating cashflow sufficiently supports earnings.")),
        F.when(rg > 8, F.concat(F.lit("Strong YoY revenue momentum (+"), fmt1(rg), F.lit("%)."))),
    ))
    risks = F.array_compact(F.array(
        F.when(pm < 0.05, F.concat(F.lit("Weak profitability ("), fmt1(pm * 100), F.lit("%)."))),
        F.when((dr > 0.4) & (dr <= 0.6), F.concat(F.lit("Moderate leverage pressure (debt ratio "), fmt1(dr * 100), F.lit("%).")))
        .when(dr > 0.6, F.concat(F.lit("High leverage risk (debt ratio "), fmt1(dr * 100), F.lit("%)."))),
        F.when(cash_ratio < 1.0, F.lit("Cash conversion is weak relative to reported net income.")),
        F.when(rg < 0, F.concat(F.lit("Revenue contraction detected ("), fmt1(rg), F.lit("% YoY)."))),
    ))
    actions = F.array_compact(F.array(
        F.when((pm >= 0.05) & (pm < 0.15), F.lit("Improve gross margin mix and operating efficiency."))
        .when(pm < 0.05, F.lit("Prioritize cost control and low-margin segment review.")),
        F.when((dr > 0.4) & (dr <= 0.6), F.lit("Limit new debt and improve debt servicing from operating cashflow."))
        .when(dr > 0.6, F.lit("Create a debt reduction plan and consider refinancing.")),
        F.when(cash_ratio < 1.0, F.lit("Tighten receivables and working-capital cycles.")),
        F.when(rg < 0, F.lit("Investigate demand, pricing, and product-mix drivers.")),
    ))
    status = F.when((ni > 0) & (pm >= 0.05), "Profitable").when(pm >= 0, "Break-Even").otherwise("Loss")
    return y.select("ticker", F.col("year").cast("bigint").alias("year"), status.alias("status"),
                    strengths.alias("strengths"), risks.alias("risks"), actions.alias("actions"))


# The texts of the fallback record and of the reliability gate.
SUMMARY = ("Fallback recommendations generated for %s because the LLM provider is rate-limited. "
           "Current financial signals indicate status: %s with predicted growth %s%%.")
OUTLOOK = ("Predicted growth is %s%% with a %s of %s%% vs 10%% target. "
           "Forecast confidence is based on available SVR evaluation metrics.")
CONCERN = "Growth shortfall persists versus target; prioritize margin and efficiency improvements."
NO_CONCERN = "No immediate structural concern detected in fallback analysis."
NO_DRIVERS = "Data loaded successfully; awaiting richer model interpretation."
NO_RISKS = "No major risks flagged by fallback analysis."
RISK_FACTOR = "Profitability and leverage trend"
ACTION_RATIONALE = "Derived from financial ratio and trend checks in fallback mode."
ACTION_TIMELINE = "6-months"
NO_ACTION = ("Medium", "Maintain current operating plan and monitor margin/debt trends monthly.",
             "Fallback mode found no critical actions but recommends active monitoring.", "immediate")
SHORTFALL_RATIONALE = ("Improve revenue momentum and margin quality through pricing, mix, and execution discipline.")
SURPLUS_RATIONALE = "Protect forecast outperformance with capacity planning and operating controls."
GATE_PREFIX = "Low-confidence mode:"
GATE_SUMMARY = "Low-confidence mode: model reliability is currently below threshold. "
GATE_OPPORTUNITY = (
    "Model validation before directional action",
    "Current forecast reliability is below threshold. Prioritize data quality checks, "
    "retraining diagnostics, and benchmark improvement before directional investment actions.",
    "Improved forecast trust and lower decision risk")
GATE_ACTION = (
    "High", "Run model remediation checklist: data drift scan, benchmark retraining, and hyperparameter retune",
    "Reliability gate is active; model quality must be improved before directional recommendations.", "immediate")
ACTION_FIELDS = ("priority", "action", "rationale", "timeline")
OPPORTUNITY_FIELDS = ("title", "rationale", "estimated_upside")


def _record(names, values) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, values)])


def fallback_record(latest: DataFrame, forecast: DataFrame, r2: Column) -> DataFrame:
    """R7 as the nested record of a ticker: summary, outlook, risks, opportunities and
    action items from the latest year's rules (R6) and the forecast gap."""
    j = latest.join(forecast.select("ticker", "predicted_growth_rate", "gap_vs_target"), "ticker", "left")
    pg = F.coalesce("predicted_growth_rate", F.lit(0.0))
    gap = F.coalesce("gap_vs_target", pg - 10)
    risk = (F.when((F.col("status") == "Profitable") & (gap >= 0), "Low")
            .when((F.col("status") == "Loss") | (gap < -5), "High").otherwise("Medium"))
    d = j.withColumns({"pg": pg, "gap": gap, "risk": risk})
    pg, gap, risk, short = F.col("pg"), F.col("gap"), F.col("risk"), F.col("gap") < 0
    status = F.when(short, "shortfall").otherwise("surplus")
    points = (F.lit(6) + F.when(F.col("status") == "Profitable", 2).otherwise(0) + F.when(~short, 1).otherwise(0)
              - F.when(risk == "High", 2).otherwise(0))
    worst = F.slice("risks", 1, 2)
    items = F.transform("actions", lambda a: _record(ACTION_FIELDS, (
        F.when(F.lower(a).contains("debt") | F.lower(a).contains("cost"), "High").otherwise("Medium"), a,
        ACTION_RATIONALE, ACTION_TIMELINE)))
    better = F.when(short, _record(OPPORTUNITY_FIELDS, (
        "Close growth gap to 10% target", SHORTFALL_RATIONALE, F.concat(fmt1(F.abs(gap)), F.lit("% toward target"))))) \
        .otherwise(_record(OPPORTUNITY_FIELDS, (
            "Sustain above-target growth", SURPLUS_RATIONALE, "Maintain momentum with lower volatility")))
    return d.select(
        "ticker", "year", "status",
        F.format_string(SUMMARY, "ticker", "status", fmt2(pg)).alias("executive_summary"),
        F.least(F.lit(10), F.greatest(F.lit(1), points)).alias("performance_score"),
        F.struct(F.format_string(OUTLOOK, fmt2(pg), status, fmt2(gap)).alias("forecast"),
                 rnd(pg, 2).alias("predicted_growth_rate"), rnd(gap, 2).alias("gap_vs_target"),
                 status.alias("gap_status"), confidence_from_r2(F.coalesce(r2, F.lit(0.0))).alias("confidence"),
                 F.when(F.size("strengths") > 0, F.slice("strengths", 1, 3)).otherwise(F.array(F.lit(NO_DRIVERS)))
                 .alias("key_drivers"),
                 F.when(short, CONCERN).otherwise(NO_CONCERN).alias("critical_concern")).alias("growth_outlook"),
        F.struct(risk.alias("overall_risk"),
                 F.array(F.struct(F.lit(RISK_FACTOR).alias("factor"), risk.alias("severity"),
                                  F.when(F.size(worst) > 0, F.array_join(worst, "; ")).otherwise(NO_RISKS)
                                  .alias("explanation"))).alias("risk_factors"),
                 worst.alias("critical_warnings"), F.lit("stable").alias("risk_trend")).alias("risk_assessment"),
        F.array(better).alias("opportunities"),
        F.when(F.size("actions") > 0, items).otherwise(F.array(_record(ACTION_FIELDS, NO_ACTION)))
        .alias("action_items"),
        F.when(risk == "Medium", "HOLD").when(risk == "Low", "BUY").otherwise("REDUCE").alias("investment_verdict"))


def fallback_recommendation(latest: DataFrame, forecast: DataFrame, r2: Column) -> DataFrame:
    """R7 as one flat row per ticker: the main fields of :func:`fallback_record`."""
    r = fallback_record(latest, forecast, r2)
    g, k = F.col("growth_outlook"), F.col("risk_assessment")
    return r.select(
        "ticker", "year", "status", g["predicted_growth_rate"].alias("predicted_growth_rate"),
        g["gap_vs_target"].alias("gap_vs_target"), g["gap_status"].alias("gap_status"),
        g["confidence"].alias("confidence"), k["overall_risk"].alias("overall_risk"), "performance_score",
        "investment_verdict", F.col("opportunities")[0]["title"].alias("opportunity_title"),
        F.col("opportunities")[0]["estimated_upside"].alias("estimated_upside"),
        F.size("action_items").cast("bigint").alias("action_count"),
        F.col("action_items")[0]["priority"].alias("top_action_priority"),
        F.array_join(g["key_drivers"], " | ").alias("key_drivers"),
        F.array_join(k["critical_warnings"], " | ").alias("critical_warnings"))


def normalized_record(base: DataFrame, signals: DataFrame) -> DataFrame:
    """R3 (+R1, R2) on nested records.  The outlook takes the model's signals and the
    score is calibrated.  Where the reliability gate has reasons the record is
    rewritten in place: score capped at 4, confidence Low, verdict HOLD, Low risk raised
    to Medium, both warnings appended once, the summary prefixed once, one conservative
    opportunity, the first two action items at medium priority and a remediation item."""
    s = calibrated_score(base.withColumn("overall_risk", F.col("risk_assessment.overall_risk")).join(signals, "ticker"))
    s = s.withColumn("reasons", gate_reasons()).withColumn("gated", F.size("reasons") > 0)
    g = F.col("gated")

    def gated(when, otherwise):
        return F.when(g, when).otherwise(otherwise)

    def once(a, text):
        return F.when(F.array_contains(a, text), a).otherwise(F.array_append(a, F.lit(text)))

    risk, score = F.col("risk_assessment"), gated(F.least(F.col("final_score"), F.lit(4)), F.col("final_score"))
    warnings = F.coalesce(risk["critical_warnings"], F.array().cast("array<string>"))
    summary = F.coalesce("executive_summary", F.lit(""))
    level = risk["overall_risk"]
    conservative = F.concat(
        F.transform(F.slice("action_items", 1, 2), lambda a: a.withField("priority", F.lit("Medium"))),
        F.array(_record(ACTION_FIELDS, GATE_ACTION)))
    outlook = F.col("growth_outlook")
    for name, value in (("predicted_growth_rate", rnd("predicted_period", 6)), ("target_growth_rate", rnd("target_period", 6)),
                        ("gap_vs_target", rnd("gap_period", 6)),
                        ("gap_status", F.when(F.col("gap_period") >= 0, "surplus").otherwise("shortfall")),
                        ("confidence", gated(F.lit("Low"), confidence_from_r2("r2"))),
                        ("periods_per_year", rnd("periods_per_year", 2)),
                        ("predicted_growth_rate_annualized_pct", rnd("predicted_annual", 6)),
                        ("target_growth_rate_annualized_pct", rnd("target_annual", 6)),
                        ("gap_vs_target_annualized_pct", rnd("gap_annual", 6)), ("low_confidence_mode", g)):
        outlook = outlook.withField(name, value)
    return s.select(
        "ticker",
        gated(F.when(F.contains(summary, F.lit(GATE_PREFIX)), summary).otherwise(
            F.trim(F.concat(F.lit(GATE_SUMMARY), summary))), summary).alias("executive_summary"),
        score.cast("bigint").alias("performance_score"),
        F.struct(rnd("raw_score", 6).alias("raw_score"), score.cast("bigint").alias("final_score"),
                 F.when(g, F.struct(F.lit("low_confidence_cap").alias("type"), score.cast("bigint").alias("capped_to"),
                                    F.lit("model_reliability_gate").alias("reason"))).alias("cap_applied"))
        .alias("score_breakdown"),
        outlook.alias("growth_outlook"),
        risk.withField("critical_warnings", gated(once(once(warnings, GATE_WARNING_2), GATE_WARNING), warnings))
        .withField("overall_risk", gated(F.when(F.lower(F.trim(F.coalesce(level, F.lit("Medium")))) == "low", F.lit("Medium"))
                                         .otherwise(level), level)).alias("risk_assessment"),
        gated(F.array(_record(OPPORTUNITY_FIELDS, GATE_OPPORTUNITY)), F.col("opportunities")).alias("opportunities"),
        gated(conservative, F.col("action_items")).alias("action_items"),
        gated(F.lit("HOLD"), F.col("investment_verdict")).alias("investment_verdict"),
        F.struct("model_reliability", "beats_naive", "r2", "test_size", g.alias("low_confidence_mode"),
                 gated(F.lit(GATE_WARNING), F.lit("")).alias("gate_message")).alias("model_reliability"),
        F.struct(g.alias("triggered"), F.col("reasons").alias("reasons")).alias("reliability_gate"))


def flat_record(records: DataFrame) -> DataFrame:
    """A normalised record as one flat row: lists joined by ' | ', an item's fields by ' / '."""
    def items(column, names):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(" / ", *[x[n] for n in names])), " | ")

    return records.select(
        "ticker", "executive_summary", "performance_score", "investment_verdict",
        F.col("growth_outlook.confidence").alias("confidence"), F.col("risk_assessment.overall_risk").alias("overall_risk"),
        F.array_join("risk_assessment.critical_warnings", " | ").alias("critical_warnings"),
        items("opportunities", OPPORTUNITY_FIELDS).alias("opportunities"),
        items("action_items", ACTION_FIELDS).alias("action_items"),
        F.col("score_breakdown.cap_applied.capped_to").alias("capped_to"),
        F.col("model_reliability.gate_message").alias("gate_message"))


def normalize_recommendation(base: DataFrame, signals: DataFrame) -> DataFrame:
    """R3 (+R1, R2): align the base recommendation with the model signals,
    add the calibrated score, apply the reliability gate (score capped at 4,
    confidence Low, verdict HOLD, Low risk raised to Medium, conservative
    opportunity and an extra remediation action)."""
    j = base.select("ticker", "overall_risk", "investment_verdict", "action_count") \
        .join(signals, "ticker")
    s = calibrated_score(j)
    reasons = gate_reasons()
    s = s.withColumn("gate_reasons", reasons).withColumn("gated", F.size("gate_reasons") > 0)
    g = F.col("gated")
    return s.select(
        "ticker",
        rnd("predicted_period", 6).alias("predicted_growth_rate"),
        rnd("target_period", 6).alias("target_growth_rate"),
        rnd("gap_period", 6).alias("gap_vs_target"),
        F.when(F.col("gap_period") >= 0, "surplus").otherwise("shortfall").alias("gap_status"),
        rnd("periods_per_year", 2).alias("periods_per_year"),
        rnd("predicted_annual", 6).alias("predicted_growth_rate_annualized_pct"),
        rnd("target_annual", 6).alias("target_growth_rate_annualized_pct"),
        rnd("gap_annual", 6).alias("gap_vs_target_annualized_pct"),
        F.when(g, "Low").otherwise(confidence_from_r2("r2")).alias("confidence"),
        F.when(g, F.least(F.col("final_score"), F.lit(4))).otherwise(F.col("final_score"))
        .cast("bigint").alias("performance_score"),
        rnd("raw_score", 6).alias("raw_score"),
        F.when(g & (F.lower(F.trim("overall_risk")) == "low"), "Medium").otherwise(F.col("overall_risk"))
        .alias("overall_risk"),
        F.when(g, "HOLD").otherwise(F.col("investment_verdict")).alias("investment_verdict"),
        g.alias("low_confidence_mode"),
        F.array_join("gate_reasons", ",").alias("gate_reasons"),
        F.when(g, F.least(F.col("action_count"), F.lit(2)) + 1).otherwise(F.col("action_count"))
        .cast("bigint").alias("action_count"),
        F.when(g, F.lit("Model validation before directional action")).alias("gated_opportunity"))


def score_breakdown(scored: DataFrame) -> DataFrame:
    """(ticker, component, value, weight, contribution) rows."""
    items = [F.struct(F.lit(k).alias("component"), F.col(f"c_{k}").alias("value"),
                      F.col(f"w_{k}").alias("weight")) for k in COMPONENTS]
    e = scored.select("ticker", F.inline(F.array(*items)))
    return e.select("ticker", "component", rnd("value", 8).alias("value"),
                    rnd("weight", 8).alias("weight"),
                    rnd(F.col("value") * F.col("weight"), 8).alias("contribution"))


def latest_ratios(std: DataFrame) -> DataFrame:
    """Latest ratios per ticker, rounded as displayed (2 / 4 dp)."""
    g = std.groupBy("ticker").agg(F.max_by(F.struct(
        "date", "profit_margin", "operating_margin", "debt_to_asset", "asset_efficiency",
        "revenue_growth", "net_income_growth"), "date").alias("r")).select("ticker", "r.*")
    z = F.lit(0.0)
    return g.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("fiscal_year"),
                    rnd(F.coalesce("profit_margin", z), 2).alias("profit_margin"),
                    rnd(F.coalesce("operating_margin", z), 2).alias("operating_margin"),
                    rnd(F.coalesce("debt_to_asset", z), 4).alias("debt_to_asset"),
                    rnd(F.coalesce("asset_efficiency", z), 4).alias("asset_efficiency"),
                    rnd(F.coalesce("revenue_growth", z), 2).alias("revenue_growth"),
                    rnd(F.coalesce("net_income_growth", z), 2).alias("net_income_growth"))


def peer_block(std: DataFrame, k: int = 4) -> DataFrame:
    """R4 peers: the k largest companies by latest revenue (a top-k report)
    with their latest margin, growth and leverage."""
    g = std.groupBy("ticker").agg(F.max_by(F.struct(
        "revenue", "profit_margin", "revenue_growth", "debt_to_asset"), "date").alias("r")) \
        .select("ticker", "r.*")
    top = g.orderBy(F.col("revenue").desc(), F.col("ticker")).limit(k)
    z = F.lit(0.0)
    return top.select(F.col("ticker").alias("peer"),
                      rnd(F.coalesce("profit_margin", z), 2).alias("profit_margin"),
                      rnd(F.coalesce("revenue_growth", z), 2).alias("revenue_growth"),
                      rnd(F.coalesce("debt_to_asset", z), 4).alias("debt_to_asset"))


def anomaly_lines(lines: DataFrame, k: int = 5) -> DataFrame:
    """The first k insight lines of a ticker, in report order, that mention
    a drop / anomaly / decline / risk (per-ticker window, k lines per group)."""
    hit = lines.filter((F.col("ticker") != "") & F.lower("message").rlike(ANOMALY_KEYWORDS))
    w = Window.partitionBy("ticker").orderBy("section", "item", "message")
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k) \
        .select("ticker", F.col("n").cast("bigint").alias("n"), "message")

"""Queries over the cost log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.operators import costs, metrics
from lorespark.plans import standins as S
from lorespark.plans.registry import query

_M = "CAST(sum(CAST(round({0} * 1e6) AS BIGINT)) AS BIGINT)"
m = _M.format
_TRAD = f"coalesce(t.tokens, {K.TRADITIONAL_DEFAULT})"
four = "floor(({0} + 50) / 100.0) / 10000.0".format
_PARTS = ", ".join(f"{m(p)} / 1e6 AS {p}" for p in metrics.PARTS)


@query("a06_jsonl_metric_source", S.sql("fact", "SELECT event_id, query_type, tokens_in, cost FROM fact WHERE day >= '2024-01-10'"))
def a06(spark, sf):
    return S.fact(spark, sf).filter("day >= '2024-01-10'").select("event_id", "query_type", "tokens_in", "cost")


@query("b18_time_window", S.sql("fact", f"SELECT event_id, query_type, cost FROM fact WHERE timestamp >= TIMESTAMP '{S.AS_OF}' - INTERVAL 7 DAY"))
def b18(spark, sf):
    return S.fact(spark, sf).filter(F.col("timestamp") >= F.expr(f"timestamp'{S.AS_OF}' - interval 7 days")).select("event_id", "query_type", "cost")


@query("b22_known_fields", S.sql("fact", "SELECT event_id, query_type, model, cost FROM fact"))
def b22(spark, sf):
    return S.fact(spark, sf).select("event_id", "query_type", "model", "cost")


@query("c13_traditional_tokens_join", S.sql("fact dim_trad", f"SELECT event_id, query_type, CAST({_TRAD} AS BIGINT) AS traditional_tokens FROM fact f LEFT JOIN dim_trad t USING (query_type)"))
def c13(spark, sf):
    return costs.with_traditional(S.fact(spark, sf)).select("event_id", "query_type", "traditional_tokens")


@query("c14_cost_dimension_join", S.sql("fact", "SELECT event_id, embedding_cost, llm_input_cost, llm_output_cost, cost FROM fact"))
def c14(spark, sf):
    return S.fact(spark, sf).select("event_id", *metrics.PARTS, "cost")


@query("d01_summary", S.sql("fact dim_trad", f"SELECT n AS total_queries, {four('c')} AS total_cost, {four('t')} AS traditional_cost, {four('(t - c)')} AS savings, round(CASE WHEN t > 0 THEN (t - c)::DOUBLE / t * 100 ELSE 0 END, 1) AS savings_percent FROM (SELECT count(*) AS n, {m('cost')} AS c, CAST(sum({_TRAD}) AS BIGINT) AS t FROM fact f LEFT JOIN dim_trad t USING (query_type))"))
def d01(spark, sf):
    return metrics.summary(S.fact(spark, sf))


@query("d02_by_type", S.sql("fact", f"SELECT query_type, count(*) AS count, {four(m('cost'))} AS cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, {_PARTS} FROM fact GROUP BY 1"))
def d02(spark, sf):
    return metrics.by_type(S.fact(spark, sf))


@query("d03_component_totals", S.sql("fact", f"SELECT {_PARTS}, {m('cost')} / 1e6 AS total_cost FROM fact"))
def d03(spark, sf):
    return metrics.component_totals(S.fact(spark, sf))


_DAILY = f"SELECT day AS date, count(*) AS queries, {four(m('cost'))} AS cost, {four(f'CAST(sum({_TRAD}) AS BIGINT)')} AS traditional_cost, {_PARTS} FROM fact f LEFT JOIN dim_trad t USING (query_type) GROUP BY day"


@query("d04_daily", S.sql("fact dim_trad", _DAILY))
def d04(spark, sf):
    return metrics.daily(S.fact(spark, sf))


@query("f04_daily_ascending", S.sql("fact dim_trad", f"SELECT date, queries, row_number() OVER (ORDER BY date) AS pos FROM ({_DAILY}) ORDER BY date"))
def f04(spark, sf):
    from pyspark.sql.window import Window

    return metrics.daily(S.fact(spark, sf)).select("date", "queries", F.row_number().over(Window.orderBy("date")).cast("long").alias("pos")).orderBy("date")


@query("h22_day_extraction", S.sql("fact", "SELECT event_id, day FROM fact"))
def h22(spark, sf):
    return S.fact(spark, sf).select("event_id", "day")


@query("d05_server_summary", S.sql("fact dim_trad_srv", f"SELECT n AS total_queries, c / 1e6 AS total_cost, round(c / 1e6 / n, 9) AS avg_cost_per_query, tokens_in, tokens_out, t / 1e6 AS traditional_cost, (t - c) / 1e6 AS savings, round((t - c)::DOUBLE / t * 100, 6) AS savings_percent, n * 28.0::DOUBLE AS time_saved_secs FROM (SELECT count(*) AS n, {m('cost')} AS c, CAST(sum({_TRAD}) AS BIGINT) AS t, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM fact f LEFT JOIN dim_trad_srv t USING (query_type))"))
def d05(spark, sf):
    return metrics.server_summary(S.fact(spark, sf))


@query("d06_server_by_type", S.sql("fact", f"SELECT query_type, count(*) AS count, {m('cost')} / 1e6 AS total_cost, round({m('cost')} / 1e6 / count(*), 9) AS avg_cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(duration_ms)::DOUBLE / count(*), 6) AS avg_duration_ms, round(sum(docs_retrieved)::DOUBLE / count(*), 6) AS avg_docs_retrieved FROM fact GROUP BY 1"))
def d06(spark, sf):
    return metrics.server_by_type(S.fact(spark, sf))


@query("d07_server_daily", S.sql("fact dim_trad_srv", f"SELECT day AS date, CAST(count(*) AS BIGINT) AS queries, {m('cost')} / 1e6 AS cost, CAST(sum({_TRAD}) AS BIGINT) / 1e6 AS traditional_cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM fact f LEFT JOIN dim_trad_srv t USING (query_type) GROUP BY 1"))
def d07(spark, sf):
    return metrics.server_daily(S.fact(spark, sf))


_BREAKDOWN = f"SELECT query_type, n AS count, c / 1e6 AS cost, round(c / 1e6 / n, 9) AS avg_cost, embedding_cost, llm_input_cost, llm_output_cost, t / 1e6 AS traditional_cost, (t - c) / 1e6 AS savings FROM (SELECT query_type, count(*) AS n, {m('cost')} AS c, CAST(sum({_TRAD}) AS BIGINT) AS t, {_PARTS} FROM fact f LEFT JOIN dim_trad_srv t USING (query_type) GROUP BY 1)"


@query("d08_server_breakdown", S.sql("fact dim_trad_srv", _BREAKDOWN))
def d08(spark, sf):
    return metrics.server_breakdown(S.fact(spark, sf))


@query("d09_server_components", S.sql("fact", f"SELECT {_PARTS}, {m('cost')} / 1e6 AS total_cost, count(*) AS count FROM fact"))
def d09(spark, sf):
    return metrics.component_totals(S.fact(spark, sf), count=True)


@query("d22_roi_by_type", S.sql("fact dim_trad_srv", f"SELECT query_type, CASE WHEN cost > 0 THEN round(traditional_cost / cost, 1) ELSE 0.0 END AS roi FROM ({_BREAKDOWN})"))
def d22(spark, sf):
    return metrics.roi(metrics.server_breakdown(S.fact(spark, sf)))


@query("d23_savings_projection", S.sql("fact dim_trad_srv", f"SELECT query_type, round(savings / traditional_cost * 100, 0) AS savings_percent, round(savings * (365.0::DOUBLE / 30), 4) AS projected_annual_savings, round(least(100.0::DOUBLE, cost / 10.0::DOUBLE * 100), 4) AS budget_percent FROM ({_BREAKDOWN})"))
def d23(spark, sf):
    return metrics.projections(metrics.server_breakdown(S.fact(spark, sf)), 30)


@query("e05_waterfall", S.sql("fact dim_trad_srv", f"SELECT query_type, round(savings, 6) AS bar, round((SELECT sum(traditional_cost) FROM ({_BREAKDOWN})) - sum(savings) OVER (ORDER BY query_type ROWS UNBOUNDED PRECEDING), 6) AS \"offset\" FROM ({_BREAKDOWN}) WHERE savings > 0"))
def e05(spark, sf):
    return metrics.waterfall(metrics.server_breakdown(S.fact(spark, sf)))


_METHOD = "CASE query_type WHEN 'search' THEN 'neural' WHEN 'query' THEN 'neural' WHEN 'rag' THEN 'llm' ELSE 'keyword' END"
_USD = f"(neural * {K.LLM_COST - K.NEURAL_COST!r}::DOUBLE + keyword * {K.LLM_COST!r}::DOUBLE)"


@query("d21_classification_savings", S.sql("fact", f"SELECT total AS total_queries, neural AS neural_classifications, llm AS llm_fallbacks, keyword AS keyword_fallbacks, round(neural::DOUBLE / total * 100, 1) AS neural_usage_pct, round({_USD}, 4) AS total_saved_usd, round({_USD} * (36500::DOUBLE / total), 2) AS estimated_annual_savings FROM (SELECT count(*) AS total, count(*) FILTER ({_METHOD} = 'neural') AS neural, count(*) FILTER ({_METHOD} = 'llm') AS llm, count(*) FILTER ({_METHOD} = 'keyword') AS keyword FROM fact)"))
def d21(spark, sf):
    return metrics.classification_savings(S.fact(spark, sf).select(F.expr(_METHOD).alias("method")))


_NANO = "(tokens_in * CAST(round(m.rate_in * 1e6) AS BIGINT) + tokens_out * CAST(round(m.rate_out * 1e6) AS BIGINT))"


@query("h12_cost_from_tokens", S.sql("raw_fact dim_models", f"SELECT event_id, floor(({_NANO} + 500) / 1000.0) / 1e6 AS cost FROM raw_fact f JOIN dim_models m ON m.model = CASE WHEN f.model IN (SELECT model FROM dim_models) THEN f.model ELSE '{K.DEFAULT_MODEL}' END"))
def h12(spark, sf):
    return costs.with_rates(S.fact(spark, sf)).select("event_id", costs.raw_cost(F.col("tokens_in"), F.col("tokens_out")).alias("cost"))


_RATE = S.double(K.MODEL_COSTS[K.EMBEDDING_MODEL][0])
_ACT = "event_id % 2 = 0"


@query("h13_recorded_cost", S.sql("raw_fact dim_models dim_estimates", (
    f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 77 WHEN {_ACT} THEN k * 7 + 100 ELSE embedding_tokens + context_tokens + llm_in + e.llm_out END AS tokens_in, CASE WHEN {_ACT} THEN k * 3 + 1 ELSE e.llm_out END AS tokens_out, "
    "embedding_cost, llm_input_cost, llm_output_cost, round(embedding_cost + llm_input_cost + llm_output_cost, 6) AS cost FROM (SELECT f.*, e.*, "
    f"round(CASE WHEN {_ACT} THEN 100 ELSE e.embedding_tokens END / 1000.0::DOUBLE * {_RATE}, 6) AS embedding_cost, "
    f"round(CASE WHEN {_ACT} THEN k * 7 ELSE e.llm_in END / 1000.0::DOUBLE * m.rate_in, 6) AS llm_input_cost, round(CASE WHEN {_ACT} THEN k * 3 + 1 ELSE e.llm_out END / 1000.0::DOUBLE * m.rate_out, 6) AS llm_output_cost "
    f"FROM raw_fact f JOIN dim_estimates e ON e.type = CASE WHEN f.query_type IN (SELECT type FROM dim_estimates) THEN f.query_type ELSE '{K.DEFAULT_ESTIMATE}' END JOIN dim_models m ON m.model = CASE WHEN f.model IN (SELECT model FROM dim_models) THEN f.model ELSE '{K.DEFAULT_MODEL}' END) e"
)))
def h13(spark, sf):
    f = S.fact(spark, sf).drop(*metrics.PARTS, "cost").withColumns({
        "tokens_in": F.when(F.col("event_id") % 3 == 0, F.lit(77)).otherwise(F.lit(0)).cast("long"), "tokens_out": F.lit(0).cast("long"),
        **{f"actual_{c}": F.when(F.col("event_id") % 2 == 0, v.cast("long")) for c, v in (("prompt", F.col("k") * 7), ("completion", F.col("k") * 3 + 1), ("embedding", F.lit(100)))},
    })
    return costs.recorded(f).select("event_id", "tokens_in", "tokens_out", *metrics.PARTS, "cost")


@query("h14_backfill_components", S.sql("fact", "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 0.001::DOUBLE ELSE embedding_cost END AS embedding_cost, CASE WHEN event_id % 5 = 1 THEN 0.0::DOUBLE ELSE llm_input_cost END AS llm_input_cost, CASE WHEN event_id % 5 = 1 THEN 0.0::DOUBLE ELSE llm_output_cost END AS llm_output_cost, cost FROM fact"))
def h14(spark, sf):
    """A third kind of rows lacks components; those of remainder 1 have one component, which is kept."""
    f, r = S.fact(spark, sf), F.col("event_id") % 5
    gone = {p: F.when(r == 2, F.lit(0.0)).when(r == 1, F.lit(0.001 if p == "embedding_cost" else 0.0)).otherwise(F.col(p)) for p in metrics.PARTS}
    return costs.backfilled(f.withColumns(gone)).select("event_id", *metrics.PARTS, "cost")


@query("h35_json_field_default", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def h35(spark, sf):
    return S.read(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("i14_session_token_usage", S.sql("fact", "SELECT user_id AS session, CAST(sum(tokens_in) AS BIGINT) AS prompt_tokens, CAST(sum(tokens_out) AS BIGINT) AS completion_tokens, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, count(*) AS calls FROM fact GROUP BY 1"))
def i14(spark, sf):
    return metrics.session_usage(S.fact(spark, sf))


@query("i16_classification_log", S.sql("fact", f"SELECT event_id, {_METHOD} AS method FROM fact QUALIFY row_number() OVER (ORDER BY timestamp DESC, event_id DESC) <= 100"))
def i16(spark, sf):
    """The last hundred tracked calls: a top-k report."""
    return S.fact(spark, sf).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(100).select("event_id", F.expr(_METHOD).alias("method"))


@query("h30_display_formatters", S.sql("fact", "SELECT event_id, '$' || printf('%.5f', cost) AS cost_text, CASE WHEN s < 60 THEN printf('%.0f', s) || 's' WHEN s < 3600 THEN printf('%.0f', floor(s / 60)) || 'm' ELSE printf('%.1f', floor(s / 360) / 10) || 'h' END AS time_text FROM (SELECT event_id, cost, (event_id * 7 % 9000)::DOUBLE AS s FROM fact)"))
def h30(spark, sf):
    s = (F.col("event_id") * 7 % 9000).cast("double")
    text = F.when(s < 60, F.concat(F.format_string("%.0f", s), F.lit("s"))).when(s < 3600, F.concat(F.format_string("%.0f", F.floor(s / 60).cast("double")), F.lit("m"))).otherwise(F.concat(F.format_string("%.1f", F.floor(s / 360).cast("double") / 10), F.lit("h")))
    return S.fact(spark, sf).select("event_id", F.concat(F.lit("$"), F.format_string("%.5f", "cost")).alias("cost_text"), text.alias("time_text"))


@query("d24_evaluation_summary", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS passed, round(count(*) FILTER (quality = 1)::DOUBLE / count(*) * 100, 1) AS passed_pct FROM labels")
def d24(spark, sf):
    a = S.read(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))
    return a.select("n", "passed", F.round(F.col("passed") / F.col("n") * 100, 1).alias("passed_pct"))


@query("d25_accuracy", "SELECT round(avg(CASE WHEN (CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END) = quality THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def d25(spark, sf):
    j = S.read(spark, sf, "labels").join(S.read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.agg(F.round(F.avg(F.when((F.col("n_chars") >= 300).cast("int") == F.col("quality"), 1.0).otherwise(0.0)), 6).alias("accuracy"))

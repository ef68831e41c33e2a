"""Roll-ups of the cost log. Every one is a partial and a final hash aggregate; dimensions are broadcast.

Sums of money are taken in whole millionths, so they do not depend on the order of rows or on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark import constants as K
from lorespark.operators.costs import with_traditional

PARTS = ("embedding_cost", "llm_input_cost", "llm_output_cost")


def micros(c: str) -> Column:
    """The sum of an amount, in millionths."""
    return F.coalesce(F.sum(F.round(F.col(c) * 1e6).cast("long")), F.lit(0))


def money(m: Column, digits: int = 6) -> Column:
    """Millionths as an amount, rounded half up to 4 or 6 digits."""
    return m / 1e6 if digits == 6 else F.floor((m + 50) / 100) / 1e4


def traditional(tokens: Column) -> Column:
    """What tokens cost at the traditional price, in millionths (a token costs one)."""
    return (tokens * int(K.TRADITIONAL_PRICE * 1000)).cast("long")


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))


def summary(fact: DataFrame) -> DataFrame:
    """One row: queries, cost, traditional cost, savings and their share (client rounding)."""
    a = with_traditional(fact).agg(F.count("*").alias("n"), micros("cost").alias("m"), F.coalesce(F.sum("traditional_tokens"), F.lit(0)).alias("t"))
    t, s = traditional(F.col("t")), traditional(F.col("t")) - F.col("m")
    return a.select(
        F.col("n").alias("total_queries"), money(F.col("m"), 4).alias("total_cost"), money(t, 4).alias("traditional_cost"),
        money(s, 4).alias("savings"), F.round(percent(s, t), 1).alias("savings_percent"),
    )


def by_type(fact: DataFrame) -> DataFrame:
    """Count, cost, tokens and component costs of each type (client rounding)."""
    a = fact.groupBy("query_type").agg(F.count("*").alias("count"), micros("cost").alias("m"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), *[micros(p).alias(f"m_{p}") for p in PARTS])
    return a.select("query_type", "count", money(F.col("m"), 4).alias("cost"), "tokens_in", "tokens_out", *[money(F.col(f"m_{p}")).alias(p) for p in PARTS])


def component_totals(fact: DataFrame, count: bool = False) -> DataFrame:
    a = fact.agg(*[micros(c).alias(c) for c in (*PARTS, "cost")], F.count("*").alias("count"))
    out = a.select(*[money(F.col(p)).alias(p) for p in PARTS], money(F.col("cost")).alias("total_cost"), "count")
    return out if count else out.drop("count")


def daily(fact: DataFrame) -> DataFrame:
    """One row a day (client rounding)."""
    a = with_traditional(fact).groupBy("day").agg(F.count("*").alias("queries"), micros("cost").alias("m"), F.sum("traditional_tokens").alias("t"), *[micros(p).alias(f"m_{p}") for p in PARTS])
    return a.select(
        F.col("day").alias("date"), "queries", money(F.col("m"), 4).alias("cost"), money(traditional(F.col("t")), 4).alias("traditional_cost"), *[money(F.col(f"m_{p}")).alias(p) for p in PARTS]
    )


def server_summary(fact: DataFrame) -> DataFrame:
    """One row with averages, tokens and time saved (server dialect)."""
    a = with_traditional(fact, server=True).agg(
        F.count("*").alias("n"), micros("cost").alias("m"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum("traditional_tokens"), F.lit(0)).alias("t")
    )
    t, s = traditional(F.col("t")), traditional(F.col("t")) - F.col("m")
    return a.select(
        F.col("n").alias("total_queries"), money(F.col("m")).alias("total_cost"), F.round(F.when(F.col("n") > 0, F.col("m") / 1e6 / F.col("n")).otherwise(0.0), 9).alias("avg_cost_per_query"),
        "tokens_in", "tokens_out", money(t).alias("traditional_cost"), money(s).alias("savings"), F.round(percent(s, t), 6).alias("savings_percent"),
        (F.col("n") * float(K.MANUAL_SECONDS - K.ASSISTED_SECONDS)).alias("time_saved_secs"),
    )


def server_by_type(fact: DataFrame) -> DataFrame:
    a = fact.groupBy("query_type").agg(
        F.count("*").alias("count"), micros("cost").alias("m"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("duration_ms").alias("d"), F.sum("docs_retrieved").alias("r"),
    )
    n = F.col("count")
    return a.select("query_type", "count", money(F.col("m")).alias("total_cost"), F.round(F.col("m") / 1e6 / n, 9).alias("avg_cost"), "tokens_in", "tokens_out", F.round(F.col("d") / n, 6).alias("avg_duration_ms"), F.round(F.col("r") / n, 6).alias("avg_docs_retrieved"))


def server_daily(fact: DataFrame) -> DataFrame:
    """Two levels: per day and type, then per day; the traditional cost follows the counts of types."""
    per_type = fact.groupBy("day", "query_type").agg(F.count("*").alias("n"), micros("cost").alias("m"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    a = with_traditional(per_type, server=True).groupBy("day").agg(
        F.sum("n").alias("queries"), F.sum("m").alias("m"), F.sum(F.col("traditional_tokens") * F.col("n")).alias("t"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
    return a.select(F.col("day").alias("date"), "queries", money(F.col("m")).alias("cost"), money(traditional(F.col("t"))).alias("traditional_cost"), "tokens_in", "tokens_out")


def server_breakdown(fact: DataFrame) -> DataFrame:
    a = fact.groupBy("query_type").agg(F.count("*").alias("count"), micros("cost").alias("m"), *[micros(p).alias(f"m_{p}") for p in PARTS])
    a = with_traditional(a, server=True).withColumn("t", traditional(F.col("traditional_tokens") * F.col("count")))
    return a.select(
        "query_type", "count", money(F.col("m")).alias("cost"), F.round(F.col("m") / 1e6 / F.col("count"), 9).alias("avg_cost"), *[money(F.col(f"m_{p}")).alias(p) for p in PARTS],
        money(F.col("t")).alias("traditional_cost"), money(F.col("t") - F.col("m")).alias("savings"),
    )


def roi(breakdown: DataFrame) -> DataFrame:
    """How many times a type's traditional cost is its cost, to one decimal."""
    return breakdown.select("query_type", F.when(F.col("cost") > 0, F.round(F.col("traditional_cost") / F.col("cost"), 1)).otherwise(F.lit(0.0)).alias("roi"))


def projections(breakdown: DataFrame, days: int, budget: float = 10.0) -> DataFrame:
    """Savings share of each type in percent, its yearly savings from a period of days, and its share of a budget."""
    return breakdown.select(
        "query_type",
        F.round(percent(F.col("savings"), F.col("traditional_cost")), 0).alias("savings_percent"),
        F.round(F.col("savings") * (365.0 / max(days, 1)), 4).alias("projected_annual_savings"),
        F.round(F.least(F.lit(100.0), F.col("cost") / budget * 100), 4).alias("budget_percent"),
    )


def waterfall(breakdown: DataFrame) -> DataFrame:
    """From the traditional total down by each type's positive savings, in the order of types; one row for each type."""
    total = breakdown.agg(F.sum("traditional_cost").alias("base"))
    w = Window.orderBy("query_type").rowsBetween(Window.unboundedPreceding, 0)  # a row for each query type: a handful
    down = breakdown.filter("savings > 0").withColumn("below", F.sum("savings").over(w))
    return down.join(F.broadcast(total)).select("query_type", F.round("savings", 6).alias("bar"), F.round(F.col("base") - F.col("below"), 6).alias("offset"))


def classification_savings(calls: DataFrame) -> DataFrame:
    """Savings report over calls (method): neural, llm or keyword."""
    saved = {"neural": K.LLM_COST - K.NEURAL_COST, "llm": 0.0, "keyword": K.LLM_COST}
    n = lambda m: F.count_if(F.col("method") == m)
    a = calls.agg(F.count("*").alias("total"), *[n(m).alias(m) for m in saved])
    usd = F.col("neural") * saved["neural"] + F.col("keyword") * saved["keyword"]
    return a.select(
        F.col("total").alias("total_queries"), F.col("neural").alias("neural_classifications"), F.col("llm").alias("llm_fallbacks"), F.col("keyword").alias("keyword_fallbacks"),
        F.round(F.when(F.col("total") > 0, F.col("neural") / F.col("total") * 100).otherwise(0.0), 1).alias("neural_usage_pct"),
        F.round(usd, 4).alias("total_saved_usd"), F.round(usd * (365 * 100 / F.greatest("total", F.lit(1))), 2).alias("estimated_annual_savings"),
    )


def session_usage(fact: DataFrame, session: str = "user_id") -> DataFrame:
    """Token usage summed up for each session."""
    return fact.groupBy(F.col(session).alias("session")).agg(F.sum("tokens_in").alias("prompt_tokens"), F.sum("tokens_out").alias("completion_tokens"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"), F.count("*").alias("calls"))

"""Query costs: prices by model and token estimates by type, joined as broadcast dimensions (a few fixed rows each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark import constants as K


def dim_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *r) for m, r in K.MODEL_COSTS.items()], "model string, rate_in double, rate_out double")


def dim_estimates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *r) for t, r in K.TOKEN_ESTIMATES.items()], "query_type string, embedding_tokens long, context_tokens long, llm_in long, llm_out long")


def dim_traditional(spark: SparkSession, server: bool = False) -> DataFrame:
    rows = K.TRADITIONAL_TOKENS_SERVER if server else K.TRADITIONAL_TOKENS
    return spark.createDataFrame(list(rows.items()), "query_type string, traditional_tokens long")


def known(c: Column, names: list[str], default: str) -> Column:
    """c where it is one of the names, else the default's name."""
    return F.when(c.isin(*names), c).otherwise(F.lit(default))


def with_rates(fact: DataFrame) -> DataFrame:
    """fact with rate_in and rate_out of its model, or of the default model."""
    models = F.broadcast(dim_models(fact.sparkSession).withColumnRenamed("model", "_model"))
    return fact.join(models, known(F.col("model"), list(K.MODEL_COSTS), K.DEFAULT_MODEL) == F.col("_model")).drop("_model")


def with_estimates(fact: DataFrame) -> DataFrame:
    """fact with the token estimates of its type, or of the default type."""
    est = F.broadcast(dim_estimates(fact.sparkSession).withColumnRenamed("query_type", "_type"))
    return fact.join(est, known(F.col("query_type"), list(K.TOKEN_ESTIMATES), K.DEFAULT_ESTIMATE) == F.col("_type")).drop("_type")


def with_traditional(fact: DataFrame, server: bool = False) -> DataFrame:
    """fact with traditional_tokens: what its type would take without an index."""
    dim = F.broadcast(dim_traditional(fact.sparkSession, server))
    return fact.join(dim, "query_type", "left").withColumn("traditional_tokens", F.coalesce("traditional_tokens", F.lit(K.TRADITIONAL_DEFAULT)).cast("long"))


def tokens_cost(tokens: Column, rate: Column | float) -> Column:
    """Tokens at a rate for 1,000, to six decimals."""
    return F.round(tokens / 1000.0 * rate, 6)


def raw_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Both token counts at the rates of rate_in and rate_out, rounded half up to six decimals; exact, in 1e-9 steps."""
    rate = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return F.floor((tokens_in * rate("rate_in") + tokens_out * rate("rate_out") + 500) / 1000) / 1e6


def priced_by_estimate(fact: DataFrame) -> DataFrame:
    """fact with embedding_cost, llm_input_cost, llm_output_cost and cost from the estimates of its type."""
    rate = K.MODEL_COSTS[K.EMBEDDING_MODEL][0]
    p = with_rates(with_estimates(fact)).withColumns({
        "embedding_cost": tokens_cost(F.col("embedding_tokens"), rate),
        "llm_input_cost": tokens_cost(F.col("llm_in"), F.col("rate_in")),
        "llm_output_cost": tokens_cost(F.col("llm_out"), F.col("rate_out")),
    })
    p = p.withColumn("cost", F.round(F.col("embedding_cost") + F.col("llm_input_cost") + F.col("llm_output_cost"), 6))
    return p.drop("embedding_tokens", "context_tokens", "llm_in", "llm_out", "rate_in", "rate_out")


def recorded(fact: DataFrame) -> DataFrame:
    """fact with the tokens and costs that recording stores: actual usage where there is any, else estimates.

    fact has tokens_in, tokens_out (what the caller said; 0: nothing) and actual_prompt, actual_completion, actual_embedding.
    """
    total = F.coalesce(F.col("actual_prompt") + F.col("actual_completion") + F.col("actual_embedding"), F.lit(0))
    real = total > 0
    rate = K.MODEL_COSTS[K.EMBEDDING_MODEL][0]
    p = with_rates(with_estimates(fact))
    use = lambda a, e: F.when(real, F.col(a)).otherwise(F.col(e))
    all_estimates = F.col("embedding_tokens") + F.col("context_tokens") + F.col("llm_in") + F.col("llm_out")
    used_in = F.when(real, F.col("actual_prompt") + F.col("actual_embedding")).otherwise(all_estimates)
    p = p.withColumns({
        "embedding_cost": tokens_cost(use("actual_embedding", "embedding_tokens"), rate),
        "llm_input_cost": tokens_cost(use("actual_prompt", "llm_in"), F.col("rate_in")),
        "llm_output_cost": tokens_cost(use("actual_completion", "llm_out"), F.col("rate_out")),
        "tokens_in": F.when(F.col("tokens_in") != 0, F.col("tokens_in")).otherwise(used_in),
        "tokens_out": F.when(F.col("tokens_out") != 0, F.col("tokens_out")).otherwise(use("actual_completion", "llm_out")),
    })
    p = p.withColumn("cost", F.round(F.col("embedding_cost") + F.col("llm_input_cost") + F.col("llm_output_cost"), 6))
    return p.drop("embedding_tokens", "context_tokens", "llm_in", "llm_out", "rate_in", "rate_out")


def backfilled(fact: DataFrame) -> DataFrame:
    """Rows of the first format, with a cost but no component costs, with components from the estimates of their type."""
    priced = priced_by_estimate(fact.withColumnsRenamed({c: f"_{c}" for c in ("embedding_cost", "llm_input_cost", "llm_output_cost", "cost")}))
    bare = (F.col("_embedding_cost") == 0) & (F.col("_llm_input_cost") == 0) & (F.col("_llm_output_cost") == 0) & (F.col("_cost") > 0)
    parts = {c: F.when(bare, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("embedding_cost", "llm_input_cost", "llm_output_cost")}
    return priced.withColumns(parts).withColumn("cost", F.col("_cost")).drop("_embedding_cost", "_llm_input_cost", "_llm_output_cost", "_cost")

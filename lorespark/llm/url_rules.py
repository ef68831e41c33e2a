"""URL filters by association rules: FP-growth over URL tokens and labels, matched through an inverted index.

A URL becomes a set of tokens: host labels with their place from the right, the words of a label with hyphens, path
segments (numbers as one token), query keys and fragment. Tokens that occur in exactly the same URLs are one token, the
least of them, so that long fixed paths do not multiply combinations. Spark's FP-growth mines the token combinations
that occur with a label; a rule `tokens => block` stays if it reaches the support, the confidence and the lift (the
confidence as a multiple of the share of `block` in all labels), and no rule with fewer of its tokens is as sure. A
blocked URL is mined by FP-growth by the MAX_TOKENS of its tokens that are surest of `block`, so that it has at most
2 ** MAX_TOKENS combinations there; where a URL has more, its other combinations are found level by level (`_longer`),
with all tokens and without those that cannot be a rule. Support and confidence are counted on whole token sets. With `held_out`, one in so many URLs, by its hash,
is kept from mining, and a rule stays only if those of them that it matches confirm its confidence.

`page_labels` makes labels from outside the URL: a page's main text, as the extraction by tag paths finds it, is judged
by the adaptive quality rules. `seed_labels` adds those of hosts that a list names.

Rules are matched by an inverted index from each rule's rarest token: URLs are exploded to the tokens that index a rule
and joined with it, and a candidate is verified by array containment. A token that most URLs have indexes a rule only
if all of the rule's tokens are as common; the join has plain exchanges, so adaptive execution can split a hot token.

Explicit rules come first: a rule fits its host and all subdomains where the URL's path starts with the rule's path, and
the longest one (host and path together, then host) wins; of one host and path with both verdicts, block. They are a
table of any size, joined with the suffixes of the different hosts.

Defined results: a null URL or one without :// has empty host and path, fits no explicit rule and has no tokens, so it
is allowed; an empty table gives an empty result; with no labelled URLs no rule is learned; null labels count as not
`block`; repeated rows are judged one by one; URLs of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules, tag_paths
from .common import ascii_lower, cut, pick

#: Tokens by which FP-growth mines a blocked URL; combinations with further ones are found level by level
MAX_TOKENS = 14
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def explicit_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(h, p, verdict) rows of rules given as (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "h string, p string, verdict string")


def named(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, host, path and fits (rule, verdict) of the longest fitting one of rules (h, p, verdict), else null.

    Only different hosts meet the rules, by their suffixes; each row then tries its host's few candidates.
    """
    p = pick(pages, "page_id", "url")
    p = p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = p.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.struct(F.length(F.concat("h", "p")).alias("long"), F.length("h").alias("host_long"), "verdict", "h", "p")
    known = hosts.select("host", F.explode(suffixes).alias("h")).join(rules, "h").groupBy("host").agg(F.collect_set(rule).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"])))
    best = F.when(best.isNotNull(), F.struct(F.concat(best["h"], best["p"]).alias("rule"), best["verdict"].alias("verdict")))
    return p.join(known, "host", "left").select("page_id", "url", "host", "path", best.alias("fits"))


def host_words(host: Column) -> Column:
    """The words of the host's labels that have hyphens."""
    labels = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    return F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path, rest = host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    words = host_words(host)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    number = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    keys = F.filter(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: x != "")
    parts = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
        F.transform(words, lambda x: F.concat(F.lit("w:"), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), number(x))),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.coalesce(parts, F.array().cast("array<string>")))


RULES = T.StructType([T.StructField("rule_id", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _classes(sets: DataFrame) -> DataFrame:
    """(token, least, n, bad): tokens that occur in the same rows have one least token; n of those rows, bad of them blocked."""
    row = F.xxhash64("row", F.lit("a")).cast("decimal(38,0)"), F.xxhash64("row", F.lit("b")).cast("decimal(38,0)")
    each = sets.select("row", "bad", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.sum(row[0]).alias("a"), F.sum(row[1]).alias("b"))
    least = each.groupBy("n", "a", "b").agg(F.min("token").alias("least"))
    return each.join(least, ["n", "a", "b"]).select("token", "least", "n", "bad")


def mine(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules (rule_id, tokens, key, confidence) for the label `block` from labelled (url, label); key: the rarest token.

    Only the blocked URLs are mined, by FP-growth with at most MAX_TOKENS tokens of each, and those with more level by
    level with all of them; one join counts the frequent combinations in all labelled URLs with all their tokens, again
    through each combination's rarest token.
    """
    spark = labelled.sparkSession
    sets = cut(labelled.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("items"), F.coalesce(F.col("label") == "block", F.lit(False)).alias("bad")), "urls")
    n, bad = sets.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return spark.createDataFrame([], RULES)
    support = max(min_support * n, float(min_count)) / bad  # of all labelled URLs, as a share of the blocked ones
    if support > 1:
        return spark.createDataFrame([], RULES)
    # tokens too rare for a rule cannot be in one
    counts = cut(_classes(sets).filter(F.col("token") == F.col("least")).filter(F.col("n") >= support * bad * (1 - 1e-9)).select("token", "n", (F.col("bad") / F.col("n")).alias("sure")), "tokens")
    ranked = F.array_sort(F.collect_set(F.struct((-F.col("sure")).alias("a"), (-F.col("n")).alias("b"), "token")))["token"]
    sets = cut(sets.select("row", "bad", F.explode("items").alias("token")).join(counts, "token").groupBy("row", "bad").agg(ranked.alias("items")), "sets")
    blocked = sets.filter("bad").select(F.slice("items", 1, MAX_TOKENS).alias("items"))
    share = min(1.0, support * bad / max(1, blocked.count()))  # rows without any token are not among them
    frequent = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(blocked).freqItemsets
    frequent = frequent.select(F.array_sort("items").alias("items"))
    long = cut(sets.filter(F.col("bad") & (F.size("items") > MAX_TOKENS)).select("row", "items"), "long")
    if not long.isEmpty():
        frequent = frequent.unionByName(_longer(sets, long, counts, support * bad * (1 - 1e-9))).distinct()
    frequent = cut(frequent, "frequent")
    rarest = (
        frequent.select("items", F.explode("items").alias("token"))
        .join(counts, "token")
        .groupBy("items")
        .agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    )
    indexed = cut(frequent.join(rarest, "items").select(F.xxhash64("items").alias("rule_id"), "items", "key"), "indexed")
    among = _fits(sets.select("bad", "items"), indexed.select("rule_id", F.col("items").alias("tokens"), "key")).groupBy("rule_id").agg(F.avg(F.col("bad").cast("int")).alias("confidence"))
    scored = indexed.join(among, "rule_id").select("rule_id", F.col("items").alias("tokens"), "key", "confidence")
    sure = cut(scored.filter(F.col("confidence") >= max(min_confidence, min_lift * bad / n)), "sure")
    # a rule falls if one with one token less is as sure; by induction that covers all smaller ones
    smaller = sure.filter(F.size("tokens") > 1).select("rule_id", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"))
    beaten = smaller.join(sure.select("tokens", F.col("confidence").alias("as_sure")), "tokens").filter("as_sure >= confidence").select("rule_id")
    return sure.join(beaten, "rule_id", "left_anti").select("rule_id", "tokens", "key", "confidence")


def _longer(sets: DataFrame, long: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """items: the combinations of tokens of long (row, items) that may be rules: in `least` blocked rows of sets or more.

    Level by level, a combination gets one token more. None grows that only blocked rows have, since what holds it is
    not surer; none counts that is in as many rows as one with a token less, since it is as sure. Every combination that
    holds such a one falls with it, so no rule is lost, however many tokens a URL has.
    """
    def counted(tries: DataFrame) -> DataFrame:
        keys = tries.select("items", F.explode("items").alias("token")).join(counts, "token").groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
        rules = cut(keys.select("items", F.xxhash64("items").alias("rule_id"), "key"), "tries")
        seen = _fits(sets.select("bad", "items"), rules.select("rule_id", F.col("items").alias("tokens"), "key")).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
        return rules.join(seen.filter(F.col("b") >= least), "rule_id").select("items", "n", "b")

    each = long.select("row", F.explode("items").alias("token"))
    level = cut(counted(each.select(F.array("token").alias("items")).distinct()), "level")
    found, size = level.select("items"), 1
    each = cut(each.join(level.filter("b < n").select(F.col("items")[0].alias("token")), "token"), "each")
    held = each.select("row", F.array("token").alias("items"))  # the combinations that may grow, with the rows of long that have them
    while not (level := level.filter("b < n")).isEmpty():
        wider = held.join(each, "row").filter(F.col("token") > F.element_at("items", -1)).select("row", F.concat("items", F.array("token")).alias("items"))
        wider = cut(wider, "wider")
        size += 1
        parts = wider.select("items").distinct().select("items", F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("part"))
        known = parts.join(level.select(F.col("items").alias("part"), "n"), "part").groupBy("items").agg(F.count("*").alias("c"), F.min("n").alias("most")).filter(F.col("c") == size)
        known = cut(known.select("items", "most"), "known")
        level = cut(counted(known.select("items")).join(known, "items").filter("n < most").select("items", "n", "b"), "level")
        found = found.unionByName(level.select("items"))
        held = cut(wider.join(level.filter("b < n").select("items"), "items", "left_semi"), "held")
    return found


def _fits(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of sets (items, ...), each with the rules (rule_id, tokens, key, ...) that it holds all tokens of."""
    each = sets.withColumn("key", F.explode("items")).join(rules.withColumnRenamed("tokens", "rule"), "key")
    return each.filter(F.size(F.array_except("rule", "items")) == 0).drop("key", "rule", "items")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row_id, n_rules, confidence) of the urls (row_id, url) that at least one rule matches."""
    each = urls.select("row_id", tokens(F.col("url")).alias("items"))
    return _fits(each, rules).groupBy("row_id").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def confirm(rules: DataFrame, labelled: DataFrame, min_confidence: float) -> DataFrame:
    """rules with n_held and held, the share of `block` of the labelled (url, label) that a rule matches; those it is enough for.

    A rule that matches none of them is not confirmed.
    """
    sets = labelled.select(tokens(F.col("url")).alias("items"), F.coalesce(F.col("label") == "block", F.lit(False)).alias("bad"))
    seen = _fits(sets, rules.select("rule_id", "tokens", "key")).groupBy("rule_id").agg(F.count("*").alias("n_held"), F.avg(F.col("bad").cast("int")).alias("held"))
    return rules.join(seen.filter(F.col("held") >= min_confidence), "rule_id")


def learn(labelled: DataFrame, min_support: float = 0.0005, min_count: int = 3, min_confidence: float = 0.8, min_lift: float = 1.2, held_out: int = 0) -> DataFrame:
    """The rules mined from labelled (url, label); with held_out, from all but one in so many URLs, and confirmed by these."""
    labelled = pick(labelled, "url", "label")
    if not held_out:
        return cut(mine(labelled, min_support, min_count, min_confidence, min_lift), "rules")
    labelled = cut(labelled, "labels")  # the evidence is looked at once
    held = F.coalesce(F.pmod(F.xxhash64("url", F.lit("held")), F.lit(held_out)) == 0, F.lit(False))
    mined = cut(mine(labelled.filter(~held), min_support, min_count, min_confidence, min_lift), "rules")
    return cut(confirm(mined, labelled.filter(held), min_confidence), "confirmed")


def judge(
    pages: DataFrame, labelled: DataFrame, explicit: DataFrame,
    min_support: float = 0.0005, min_count: int = 3, min_confidence: float = 0.8, min_lift: float = 1.2,
    held_out: int = 0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_rules (mined rules that match) and confidence of every page."""
    rules = learn(labelled, min_support, min_count, min_confidence, min_lift, held_out)
    each = named(pages, explicit)
    # equal URLs have equal matches: each distinct one is matched once
    distinct = each.filter("url is not null").select(F.col("url").alias("row_id"), "url").distinct()
    matched = cut(match(distinct, rules), "matched").withColumnRenamed("row_id", "url")
    out = each.join(matched, "url", "left")
    return out.select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce(F.col("fits.verdict"), F.when(F.col("n_rules") > 0, F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "confidence",
    )


def page_labels(pages: DataFrame) -> DataFrame:
    """(url, label) by what the pages say: `block` where a page's main text fails the quality rules, else `allow`.

    The thresholds are those of all pages together; a page without main text fails.
    """
    p = pick(pages, "url", "html").filter("url is not null").select(F.lit(0).alias("page_id"), "url", "html")
    main = tag_paths.extract_pages(p).select("url", "text", F.lit("").alias("lang"), F.lit("").alias("source"))
    judged = quality_rules.judged(main, ["url", "lang", "source"], min_group=50, fence=3)
    return judged.select("url", F.when(F.col("_kept"), "allow").otherwise("block").alias("label"))


def seed_labels(labelled: DataFrame, seeds: list[str]) -> DataFrame:
    """labelled (url, label) with `block` where a word of the host is one of seeds."""
    seeded = F.exists(host_words(host_of(F.col("url"))), lambda w: w.isin(seeds))
    return labelled.select("url", F.when(seeded, "block").otherwise(F.col("label")).alias("label"))

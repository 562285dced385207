"""URL filter: given rules first, then association rules mined by FP-growth.

Labels come from a labelled table or, by default, from the given rules' verdicts and a few seed words.  A url is a set of
tokens (words of host and path, without numbers) and its label.  Rules say that a set of tokens means `block`; they reach
support and confidence, and no part of one is a rule itself, as it would fire wherever the whole does.

Mining: single tokens are rules by their counts and leave the blocked urls.  Of the others, those that stand in the very same
blocked urls count as one, all of them: no part of such a group blocks more, and the whole allows least.  Spark's FP-growth
mines sets of these groups, so a url of many tokens that is repeated ever so often is a single item, not 2 to their number.
What is left of that number is in the tokens of one url that are each frequent, not telling alone and spread differently.
Kept rules are an inverted index from a rule's rarest token: urls join it by token and a rule fires if the url has its others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import materialize, small_side

# The given rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Tokens that label a url as unwanted where no rule fits and no labels are given.
SEEDS = ("casino", "bets", "betting", "poker", "porn", "xxx", "viagra", "warez")
SUPPORT = 0.0005
#: Urls that a rule must hold for at least, however few there are.
LEAST_URLS = 5
CONFIDENCE = 0.9


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without a `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest given rule that fits, as a struct (length, rule, verdict), or null."""
    fits = []
    for verdict, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits.append(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _words(text: Column, mark: str) -> Column:
    """Words with a letter, marked by where they stand."""
    return F.transform(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t.rlike("[a-z]")), lambda t: F.concat(F.lit(mark), t))


def url_rows(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    low = F.translate(F.col("path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumn("given", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.array_distinct(F.concat(_words(F.col("host"), "h:"), _words(low, "p:"))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS) -> DataFrame:
    """Rules (rule, items, anchor, confidence, support) from rows (tokens, label); sets of any size.

    The table is bounded by support, and not by the number of urls.
    """
    rows = labelled.select("tokens", (F.col("label") == "block").alias("bad"))
    blocked = materialize(rows.filter("bad").select(F.monotonically_increasing_id().alias("id"), "tokens"))
    total, n_blocked = rows.count(), blocked.count()
    least = max(support * total, least_urls)
    empty = labelled.sparkSession.createDataFrame([], "rule string, items array<string>, anchor string, confidence double, support double")
    if n_blocked < least:
        return empty
    # frequent tokens with the blocked urls that hold them, and all urls that do
    cover = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    frequent = materialize(blocked.select("id", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("freq"), *cover).filter(F.col("freq") >= least))
    everywhere = rows.select(F.explode("tokens").alias("t")).join(small_side(frequent.select("t")), "t").groupBy("t").agg(F.count("*").alias("n"))
    tokens = materialize(frequent.join(everywhere, "t"))
    singles = tokens.filter(F.col("freq") >= confidence * F.col("n"))
    groups = materialize(tokens.filter(F.col("freq") < confidence * F.col("n")).groupBy("freq", "x1", "x2").agg(F.min("t").alias("t"), F.array_sort(F.collect_list("t")).alias("members")).select("t", "members"))
    bags = materialize(blocked.select("id", F.explode("tokens").alias("t")).join(small_side(groups.select("t")), "t").groupBy("id").agg(F.collect_list("t").alias("items")))
    n_bags = bags.count()
    good = singles.select(F.array("t").alias("items"), F.col("t").alias("anchor"), "freq", "n")
    if n_bags >= least:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_bags)).fit(bags.select("items")).freqItemsets
        whole = sets.select(F.array_sort("items").alias("set"), "freq", F.explode("items").alias("t")).join(small_side(groups), "t").groupBy("set", "freq").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
        # all urls with these tokens, found by the rarest token among them
        each = tokens.select("t", F.col("n").alias("k"))
        anchored = materialize(whole.filter("freq > 0 AND size(items) > 1").select("items", "freq", F.explode("items").alias("t")).join(small_side(each), "t").groupBy("items", "freq").agg(F.min_by("t", F.struct("k", "t")).alias("anchor")))
        seen = rows.select(F.col("tokens").alias("url"), F.explode("tokens").alias("anchor")).join(small_side(anchored), "anchor").filter(F.size(F.array_except("items", "url")) == 0).groupBy("items", "anchor", "freq").agg(F.count("*").alias("n"))
        good = good.unionByName(seen.filter(F.col("freq") >= confidence * F.col("n")))
    good = materialize(good)
    part = good.select(F.col("items").alias("sub"), F.col("anchor").alias("t"))
    longer = good.select("items", F.explode("items").alias("t")).join(part, "t").filter((F.size("sub") < F.size("items")) & (F.size(F.array_except("sub", "items")) == 0)).select("items").distinct()
    return good.join(longer, "items", "left_anti").select(F.array_join("items", "+").alias("rule"), "items", "anchor", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / total).alias("support"))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence for each row of pages.

    labels (page_id, label) replaces the default labels; a label other than block counts as allow.  A null url or one
    without `://` has empty host and path, no rule and the verdict allow.  Ids may be null or repeat.  Other columns are
    not read; no rows give no rows.  verdict is the rule's where one fits, else block if a mined rule fires, else allow.
    """
    urls = materialize(url_rows(pages, id_col, url_col, rules).withColumn("row", F.monotonically_increasing_id()))
    if labels is None:
        seeds = F.array(*[F.lit(f"{m}:{s}") for s in SEEDS for m in "hp"])
        labelled = urls.select("tokens", F.coalesce("given.verdict", F.when(F.arrays_overlap("tokens", seeds), "block").otherwise("allow")).alias("label"))
    else:
        labelled = urls.join(labels.select(F.col(id_col).alias("page_id"), F.col("label")), "page_id").select("tokens", "label")
    index = materialize(mine(labelled))
    fired = urls.select("row", "tokens", F.explode("tokens").alias("anchor")).join(small_side(index), "anchor").filter(F.size(F.array_except("items", "tokens")) == 0).groupBy("row").agg(F.max_by(F.struct("rule", "confidence"), F.struct("confidence", "support", "rule")).alias("best"))
    return urls.join(fired, "row", "left").select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.col("best.rule").alias("mined"), F.col("best.confidence").alias("confidence"))

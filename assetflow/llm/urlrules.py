"""URL verdicts: a given list of host and path rules, else association rules mined from labels.

A labelled url is a transaction of its tokens and, if it is bad, of one more item. FP-growth finds
the frequent sets; those with that item give rules "these tokens, then bad". Rules of enough
support and confidence are kept, unless part of their tokens gives a rule at least as sure. Tokens
of the same labelled urls are one item, as any of them stands for the others: else the sets double
with each such token. A rule is filed under the tokens of its rarest item, and a url is tested only
against the rules filed under its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.shared import broadcast_if_small, stage

# Fixed list: rule (host and path), verdict.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
# Of all labelled urls, the share that has to hold a rule's tokens and be bad, and at least so many
# urls, below which a share says little; of those with the tokens, the share that has to be bad.
MIN_SUPPORT = 0.001
MIN_URLS = 25
MIN_CONFIDENCE = 0.6
BAD_LABEL = "toxic = 1 or quality = 0"
_BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_known(url), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_known(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _known(url: str) -> Column:
    return F.coalesce(F.col(url).cast("string"), F.lit(""))


def listed_rule(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rule_path = rule.partition("/")
        of_host = (F.col(host) == rule_host) | F.endswith(F.col(host), F.lit("." + rule_host))
        found = F.when(of_host & F.startswith(F.col(path), F.lit("/" + rule_path)), rule).otherwise(found)
    return found


def tokens_of(url: str) -> Column:
    """Sorted distinct tokens: scheme, host labels, whole host, path parts, query fields, fragment.

    Runs of digits count as one token, so that numbered pages look alike.
    """
    u = _known(url)
    host, path = host_of(url), path_of(url)

    def marked(mark: str, text: Column, pattern: str) -> Column:
        parts = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), pattern)
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))

    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = [
        marked("scheme:", F.regexp_extract(u, r"(?s)^(.*?)://", 1), ":"),
        marked("label:", host, "[.]"),
        marked("host:", host, "/"),
        marked("path:", path, "/"),
        marked("query:", query, "[&;]"),
        marked("at:", F.regexp_extract(u, r"(?s)#(.*)$", 1), "#"),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _alike(baskets: DataFrame) -> DataFrame:
    """``token``, ``item``, the least token of the same baskets, and ``members``, all of these."""
    of = baskets.select("basket", F.explode("tokens").alias("token"))
    # Equal sets of baskets have equal counts and sums of two hashes.
    sums = [F.sum(F.xxhash64("basket", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    signed = of.groupBy("token").agg(F.count("*").alias("n"), *sums)
    groups = signed.groupBy("n", "s1", "s2").agg(F.array_sort(F.collect_set("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members", "n")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules from ``labelled`` (``tokens``, ``bad``): ``rule``, its items, each named by its least
    token, ``members``, the tokens of each item, ``confidence``, ``support`` and ``filed``, the tokens
    of its rarest item. Fewer than ``MIN_URLS`` urls give no rule.

    The cost grows with the frequent sets of items. Tokens that occur in the same labelled urls only,
    as those of one long url that is labelled often, count as one item."""
    spark = labelled.sparkSession
    empty = (
        "rule array<string>, members array<array<string>>, confidence double, support double, filed array<string>"
    )
    baskets = stage(
        labelled.select(F.array_distinct("tokens").alias("tokens"), "bad").withColumn(
            "basket", F.monotonically_increasing_id()
        ),
        "baskets",
    )
    total = baskets.count()
    if total < MIN_URLS:
        return spark.createDataFrame([], empty)
    support = min(1.0, max(min_support, MIN_URLS / total))
    # Tokens of frequent sets: at most 1 / min_support times the mean number of tokens of a url.
    alike = stage(_alike(baskets).where(F.col("n") >= int(support * total)), "alike")
    items = (
        baskets.select("basket", "bad", F.explode_outer("tokens").alias("token"))
        .join(broadcast_if_small(alike.select("token", "item")), "token", "left")
        .groupBy("basket", "bad")
        .agg(F.collect_set("item").alias("items"))
        .select(F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(
        stage(items, "items")
    )
    rules = model.associationRules.where(F.col("consequent")[0] == _BAD).select(
        F.array_sort("antecedent").alias("rule"), "confidence", "support"
    )
    rules = stage(rules, "rules")
    # A rule goes when one of its subsets, found by its first item, is as sure.
    by_item = rules.select(F.explode("rule").alias("item"), "rule", "confidence")
    part = rules.select(
        F.col("rule")[0].alias("item"), F.col("rule").alias("part"), F.col("confidence").alias("part_confidence")
    )
    beaten = (
        by_item.join(part, "item")
        .where(
            (F.size("part") < F.size("rule"))
            & (F.size(F.array_except("part", "rule")) == 0)
            & (F.col("part_confidence") >= F.col("confidence"))
        )
        .select("rule")
        .distinct()
    )
    kept = rules.join(beaten, "rule", "left_anti")
    described = (
        kept.select("rule", F.explode("rule").alias("item"))
        .join(alike.where("token = item").select("item", "members", "n"), "item")
        .groupBy("rule")
        .agg(
            F.min(F.struct("n", "item", "members")).alias("rarest"),
            F.array_sort(F.collect_list("members")).alias("members"),
        )
    )
    return kept.join(described, "rule").select(
        "rule", "members", "confidence", "support", F.col("rarest.members").alias("filed")
    )


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``token_sets`` (distinct ``tokens``) that hold a token of each of a rule's items, with the
    surest rule in the tokens of the url."""
    filed = rules.select("members", "confidence", F.explode("filed").alias("filed"))
    own = F.transform("members", lambda some: F.array_max(F.array_intersect(some, "tokens")))
    return (
        token_sets.select("tokens", F.explode("tokens").alias("filed"))
        .join(filed, "filed")
        .where(F.forall("members", lambda some: F.arrays_overlap(some, "tokens")))
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", F.array_sort(own).alias("rule"))).alias("best"))
        .select("tokens", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    rules=RULES,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule``, ``confidence`` of each page.

    A label belongs to the page whose page_id is its doc_id. Urls without any mined rule are
    allowed; null urls and urls without ``://`` have empty host and path and fit no rule. Repeated
    rows get equal results. Other columns are not read.
    """
    urls = stage(
        pages.select("page_id", "url")
        .withColumns({"host": host_of("url"), "path": path_of("url")})
        .withColumns({"rule": listed_rule("host", "path", rules), "tokens": tokens_of("url")})
        .drop("url"),
        "urls",
    )
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.expr(f"coalesce({BAD_LABEL}, false)")).alias("bad")
    )
    labelled = urls.join(known, F.col("page_id") == F.col("doc_id")).select("tokens", "bad")
    mined = stage(mine(labelled, min_support, min_confidence), "mined")
    # Urls of one shape are tested once; the hot ones are few rows here.
    sets = urls.where("rule is null").select("tokens").distinct()
    matched = match(sets, mined)
    given = F.lit(None).cast("string")
    for rule, verdict in rules:
        given = F.when(F.col("rule") == rule, verdict).otherwise(given)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    judged = urls.join(broadcast_if_small(stage(matched, "matched")), "tokens", "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce(given, method).alias("verdict"), "mined_rule", "confidence"
    )


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))

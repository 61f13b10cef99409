"""URL filtering by mined association rules.

A URL becomes a set of tokens: its host's labels with their place, its path's words, its query's keys. Spark's
FP-growth mines the tokens of labelled pages together with their class (quality 0 is bad); rules ``tokens ->
bad`` stay if support, confidence and evidence reach their thresholds and no rule with fewer of the same tokens is
as confident. No token is cut off. What bounds the mining is support, in share and in pages, and that of tokens
found on exactly the same pages only the first takes part, as the others add nothing to any rule. Rules are matched by an inverted index: each is filed
under its rarest token, so a URL looks only at rules of its own tokens. Listed rules come first: they
fit a host and its subdomains where the path starts with the rule's, and the longest wins.

Defined cases: null URLs, and those without ``://``, have an empty host and path and fit no listed rule; pages
without label are judged, not mined; contradicting labels of a page count each; no labelled pages means no mined rules, and all is allowed; repeated
rows are each judged; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import lower_ascii, make_importable, stored, table

#: Verdict and place (host/path) of the listed rules.
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: A rule needs this share of the labelled pages, and so many of them, to be bad pages with its tokens.
MIN_SUPPORT, MIN_PAGES = 0.002, 5
MIN_CONFIDENCE = 0.5
#: In nats, that a rule's pages are bad more often than others by chance: token sets are tried by the thousand.
MIN_EVIDENCE = 9.0
BAD = "class=bad"


def tokens_of(url: str | None) -> list[str]:
    """All tokens; digits only ever count as ``#``, so ids of single pages don't matter."""
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host, path, query = re.match(r"([^/?#]*)([^?#]*)\??([^#]*)", rest).groups()
    labels = host.lower().split(".")
    out = {f"host{-k}={x}" for k, x in enumerate(reversed(labels)) if x}
    parts = [re.sub(r"\d+", "#", x.lower()) for x in path.split("/") if x]
    out |= {f"path={x}" for x in parts if x != "#"}
    out |= {f"key={x.split('=', 1)[0].lower()}" for x in query.split("&") if x}
    if "#" in rest:
        out.add("fragment")
    return sorted(out)


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Sequence[tuple[Sequence[str], float]]):
        often: dict[str, int] = {}
        for tokens, _ in rules:
            for t in tokens:
                often[t] = often.get(t, 0) + 1
        self.by_token: dict[str, list[tuple[frozenset[str], float]]] = {}
        for tokens, confidence in rules:
            self.by_token.setdefault(min(tokens, key=lambda t: (often[t], t)), []).append((frozenset(tokens), confidence))

    def match(self, tokens: Sequence[str]) -> float | None:
        """The highest confidence of the rules whose tokens are all there."""
        have = set(tokens)
        return max((c for t in have for rule, c in self.by_token.get(t, ()) if rule <= have), default=None)


def prune(rules: Sequence[tuple[tuple[str, ...], float]]) -> list[tuple[tuple[str, ...], float]]:
    """Without rules to which tokens were added that don't raise the confidence."""
    kept: list[tuple[tuple[str, ...], float]] = []
    index: dict[frozenset[str], float] = {}
    for tokens, confidence in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        inside = set(tokens)
        if not any(small <= inside and c >= confidence for small, c in index.items() if len(small) < len(inside)):
            index[frozenset(tokens)] = confidence
            kept.append((tokens, confidence))
    return kept


def evidence(bad: float, pages: float, share: float) -> float:
    """Log likelihood of a rule's own share of bad pages against the share among all."""
    own = bad / pages
    return bad * math.log(own / share) + ((pages - bad) * math.log((1 - own) / (1 - share)) if bad < pages else 0.0)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """Rules ``tokens, confidence`` from rows ``url, bad``. What comes to the driver is the rules that reach the thresholds."""
    from pyspark.ml.fpm import FPGrowth

    @F.pandas_udf("array<string>")
    def items(urls: pd.Series) -> pd.Series:
        return urls.map(tokens_of, na_action=None)

    spark = labelled.sparkSession
    made = stored(spark, labelled.select(items("url").alias("tokens"), F.col("bad").alias("bad"), F.monotonically_increasing_id().alias("page")).filter(F.size("tokens") > 0), "url-tokens")
    sizes = made.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).collect()[0]
    if not sizes["n"] or not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return []
    share = sizes["bad"] / sizes["n"]
    least = max(MIN_PAGES, math.ceil(min_support * sizes["n"]))
    # Tokens on exactly the same pages have equal numbers and sums of hashes.
    single = made.select(F.explode("tokens").alias("token"), "page", "bad").groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"), F.sum(F.xxhash64("page").cast("decimal(38,0)")).alias("pages"))
    chosen = single.filter(F.col("bad") >= least).groupBy("n", "bad", "pages").agg(F.min("token").alias("token")).select("token")
    kept = made.select("page", "bad", F.explode("tokens").alias("token")).join(chosen, "token").groupBy("page", "bad").agg(F.collect_list("token").alias("kept"))
    rows = made.select("page", "bad").join(kept.select("page", "kept"), "page", "left").select(F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    rows = stored(spark, rows, "url-items")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / sizes["n"], minConfidence=min_confidence, numPartitions=max(16, spark.sparkContext.defaultParallelism)).fit(rows)
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") > 1)).select(F.sort_array("antecedent").alias("tokens"), "confidence", "support").collect()
    sure = [(tuple(r["tokens"]), float(r["confidence"])) for r in rules if evidence(r["support"] * sizes["n"], r["support"] * sizes["n"] / r["confidence"], share) >= MIN_EVIDENCE]
    return prune(sure)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, listed: Sequence[tuple[str, str]] = LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, place in sorted(listed, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, tail = place.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{tail}"))
        rule, verdict = F.when(fits, place).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, listed: Sequence[tuple[str, str]] = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for each page; confidence: the mined rule's."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 0).alias("bad")).filter("id is not null and bad is not null").distinct()
    rules = mine(pages.select("page_id", "url").join(known, F.col("page_id") == F.col("id")).select("url", "bad"), min_support, min_confidence)
    index = RuleIndex(rules)

    @F.pandas_udf("double")
    def confidence(urls: pd.Series) -> pd.Series:
        return pd.Series([index.match(tokens_of(u)) for u in urls], dtype="Float64")

    host, path = host_and_path(F.col("url"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    judged = found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), confidence("url").alias("confidence"))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "confidence")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")

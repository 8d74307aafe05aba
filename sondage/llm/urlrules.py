"""URL filters: curated rules, and association rules that Spark's FP-growth mines from labelled URLs.

A URL becomes a set of tokens: its host's suffixes (``tld:``, ``site:``), the words
of its host, the first and second directory of its path, the names of its query
fields. FP-growth over the labelled URLs, each with its label as one more token,
gives rules "tokens -> label"; those below ``SUPPORT`` or ``CONFIDENCE`` are pruned, and
so is a rule whose tokens hold those of another with its label and no less confidence.
Matching goes through an inverted index: each rule stands under its rarest token, a
URL looks up its own tokens and keeps the rules whose other tokens it also has. Of
these the most confident wins, then the one with more tokens, then with more support,
then block before allow.

Only distinct token sets are matched, so a host with a third of all pages is one set
per kind of path, not one row per page.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule
and no tokens, and is allowed; so is every URL that no mined rule fits.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..ordering import Lookup, lookup_join
from .frames import pick, saved

SUPPORT = 0.002
CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK, _ALLOW = "label:block", "label:allow"

# Fixed values: (verdict, host, path).
CURATED = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def curated(rules: list[tuple[str, str, str]] = CURATED) -> Column:
    """(rule, verdict) of the longest rule that fits the columns host and path; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: str = "url") -> Column:
    """Distinct tokens of the columns host, path and ``url``."""
    labels = F.split("host", r"\.")
    site = F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))
    words = F.transform(F.filter(F.split("host", r"[.\-]"), lambda w: w != ""), lambda w: F.concat(F.lit("host:"), w))
    folders = F.split("path", "/")
    fields = F.transform(F.regexp_extract_all(F.regexp_extract(F.col(url), r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)="), 1),
                         lambda f: F.concat(F.lit("field:"), f))
    one = F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)), F.concat(F.lit("site:"), F.array_join(site, ".")))
    dirs = F.filter(F.array(F.concat(F.lit("dir:"), F.get(folders, F.lit(1))),
                            F.when(F.size(folders) > 3, F.concat(F.lit("sub:"), F.get(folders, F.lit(2))))),
                    lambda d: d.isNotNull() & (d != "dir:"))
    return F.when(F.col("host") != "", F.array_sort(F.array_distinct(F.concat(one, words, dirs, F.coalesce(fields, F.array()))))
                  ).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules of (tokens, label) rows: ``tokens, verdict, confidence, support, key`` (key: the rarest token)."""
    baskets = labelled.where("size(tokens) > 0 and label in ('allow', 'block')").select(
        F.concat("tokens", F.array(F.concat(F.lit("label:"), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    sets = model.freqItemsets
    alone = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("label"), "confidence", "support")
    rules = rules.where(F.col("label").isin(_BLOCK, _ALLOW) & ~F.array_contains("tokens", _BLOCK) & ~F.array_contains("tokens", _ALLOW))
    keyed = rules.withColumn("token", F.explode("tokens")).join(alone, "token")
    return keyed.groupBy("tokens", "label", "confidence", "support").agg(
        F.min(F.struct("token_freq", "token"))["token"].alias("key")).select(
        "tokens", F.substring_index("label", ":", -1).alias("verdict"), "confidence", "support", "key")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that say what a shorter one says with no less confidence.

    A rule looks up the subsets of its own tokens, of which a URL has about ten at most.
    """
    subsets = F.aggregate("tokens", F.array(F.array().cast("array<string>")), lambda done, token: F.concat(
        done, F.transform(done, lambda some: F.concat(some, F.array(token)))))
    named = rules.withColumn("part", F.explode(F.filter(subsets, lambda some: F.size(some) < F.size("tokens"))))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    repeated = named.join(shorter, ["part", "verdict"]).where("as_sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(repeated, ["tokens", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict and rule of each distinct ``tokens`` that a mined rule fits."""
    posted = rules.select("key", F.col("tokens").alias("need"), "verdict", "confidence", "support")
    looked_up = sets.withColumn("key", F.explode("tokens")).join(posted, "key")
    fitting = looked_up.where(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.size("need").alias("size"), "support", "verdict", "need"))
    return fitting.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.verdict", F.col("best.need").alias("mined"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url",
          rules: list[tuple[str, str, str]] = CURATED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, mined`` (the token set of the mined rule, if one decided).

    ``labelled`` has columns ``url, label`` (allow or block). Without it the URLs that a
    curated rule decides are the labelled ones; mining then says again what those rules say
    of the tokens they look at.
    """
    def prepared(df: DataFrame) -> DataFrame:
        return df.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns(
            {"tokens": tokens(), "chosen": curated(rules)})

    rows = saved(prepared(pick(pages, page_id=page_id, url=url)).drop("url"), "url-tokens")
    if labelled is None:
        known = rows.where("chosen is not null").select("tokens", F.col("chosen.verdict").alias("label"))
    else:
        known = prepared(pick(labelled, url="url", label="label")).select("tokens", "label")
    mined = saved(pruned(saved(mine(known, support=support, confidence=confidence), "url-rules")), "url-rules")
    sets = saved(rows.where("chosen is null and size(tokens) > 0").groupBy("tokens").count(), "token-sets")
    verdicts = saved(match(sets.select("tokens"), mined).join(sets, "tokens"), "url-verdicts")
    sums = verdicts.agg(F.count(F.lit(1)), F.sum("count")).first()
    # A host with very many pages of one kind is a hot key of this look-up.
    open_rows = lookup_join(rows.where("chosen is null"), Lookup(verdicts, sums[0], sums[1] or 0), F.col("tokens"), "tokens",
                            ["verdict", "mined"], "count").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined")
    decided = rows.where("chosen is not null").select(
        "page_id", "host", "path", "chosen.rule", "chosen.verdict", F.lit(None).cast("array<string>").alias("mined"))
    return decided.unionByName(open_rows)

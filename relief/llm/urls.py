"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks teach two variable-order Markov models over
characters (contexts of up to three), smoothed by Witten-Bell back-off to ever
shorter contexts. A URL's score is the mean over its characters of the
difference of their log-likelihoods, so length does not matter. The threshold
is calibrated on ruled URLs that the models have not seen: the score bin with
the largest gap between allowed and blocked URLs above it.

All work is DataFrame operations; the models are tables of character n-grams,
whose size is bounded by the alphabet.

Defined results: a null URL, or one without "://", has an empty host and path
and fits no rule; a null or empty URL scores 0; without ruled URLs to calibrate
on the threshold is 0; a URL scoring at the threshold is allowed; rows that
repeat are judged each. Columns other than the URL and the kept ones are unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from relief.session import materialise

# fixed values: verdict, host and path of each rule
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ORDER = 4  # characters of the longest n-gram
PAD = "^" * (ORDER - 1)
BIN = 0.01
SYMBOLS = 256  # the shortest context backs off to a uniform choice of this many


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where "://" is missing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as struct<verdict, rule>, or null."""
    fitting = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        fitting = F.when(fits, value).otherwise(fitting)
    return fitting


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character: the n-gram of ORDER characters that ends there."""
    padded = F.concat(F.lit(PAD), F.col("_url"))
    return (
        urls.where(F.length("_url") > 0)
        .select(*keep, padded.alias("_p"), F.explode(F.sequence(F.lit(1), F.length("_url"))).alias("_i"))
        .select(*keep, F.substring("_p", F.col("_i"), F.lit(ORDER)).alias("gram"))
    )


def _sums(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def gram_ratios(counted: DataFrame) -> DataFrame:
    """Log-likelihood ratio of the last character of each n-gram: (gram, ratio).

    `counted` holds (gram, good, bad): how often either class has the n-gram.
    """
    levels = {ORDER: counted}
    for size in range(ORDER - 1, 0, -1):
        levels[size] = _sums(levels[size + 1], F.substring("gram", 2, size), "gram")
    total = levels[1].agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "bad")),
        *(F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("good", "bad")),
    ).first()

    def smoothed(seen: Column, all_: Column, kinds: Column, shorter: Column) -> Column:
        return F.when(all_ + kinds > 0, (seen + kinds * shorter) / (all_ + kinds)).otherwise(shorter)

    uniform = F.lit(1.0 / SYMBOLS)
    model = levels[1].select(
        "gram",
        *(
            smoothed(F.col(c), F.lit(total[c]), F.lit(total[f"{c}_kinds"]), uniform).alias(f"p_{c}")
            for c in ("good", "bad")
        ),
    )
    for size in range(2, ORDER + 1):
        grams = levels[size]
        context = grams.groupBy(F.substring("gram", 1, size - 1).alias("_context")).agg(
            *(F.sum(c).alias(f"{c}_all") for c in ("good", "bad")),
            *(F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("good", "bad")),
        )
        shorter = model.withColumnRenamed("gram", "_shorter")
        model = (
            grams.withColumn("_context", F.substring("gram", 1, size - 1))
            .withColumn("_shorter", F.substring("gram", 2, size - 1))
            .join(context, "_context")
            .join(shorter, "_shorter")
            .select(
                "gram",
                *(
                    smoothed(F.col(c), F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col(f"p_{c}")).alias(f"p_{c}")
                    for c in ("good", "bad")
                ),
            )
        )
    return model.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The score from which on allowed URLs outweigh blocked ones most.

    Reads (score, verdict) of ruled URLs; scores are counted in bins, of which a
    mean log-ratio of bounded models has a few thousand at most.
    """
    bins = scored.groupBy(F.round(F.col("score") / BIN).cast("long").alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")
    )
    above, every = Window.orderBy(F.desc("bin")), Window.partitionBy()

    def share(kind: str) -> Column:
        return F.try_divide(F.sum(kind).over(above), F.sum(kind).over(every))

    gap = share("good") - share("bad")
    # half way to the next lower score that was seen
    middle = (F.col("bin") + F.coalesce(F.lead("bin").over(above), F.col("bin") - 1)) / 2
    best = (
        bins.select("bin", middle.alias("middle"), gap.alias("gap"))
        .agg(F.max(F.struct("gap", -F.abs("bin"), "bin", "middle")).alias("b"))
        .first()["b"]
    )
    return 0.0 if best is None or best["gap"] is None else best["middle"] * BIN


def judge(pages: DataFrame, url: str = "url", keep: tuple = ("page_id",), rules: tuple = RULES) -> DataFrame:
    """Judge every URL: the kept columns, host, path, rule, verdict and score."""
    host, path = url_parts(F.col(url))
    parts = (
        pages.select(*keep, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
        .withColumns(dict(zip(("host", "path"), url_parts(F.col("_url")), strict=True)))
        .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    )
    urls = materialise(
        parts.groupBy("_url", F.col("_rule.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))
    ).withColumn("held_out", F.substring(F.md5("_url"), 1, 1) < "3")
    taught = F.col("verdict").isNotNull() & ~F.col("held_out")
    counted = _grams(urls, "verdict", "held_out", "rows").groupBy("gram").agg(
        F.sum(F.when(taught & (F.col("verdict") == "allow"), F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(taught & (F.col("verdict") == "block"), F.col("rows")).otherwise(0)).alias("bad"),
    )
    ratios = materialise(gram_ratios(materialise(counted)))
    # the n-grams of one URL lie together, so their mean is formed before the shuffle
    scores = materialise(
        _grams(urls, "_url").join(ratios, "gram").groupBy("_url").agg(F.avg("ratio").alias("score"))
    )
    threshold = calibrate(urls.where("held_out and verdict is not null").join(scores, "_url").select("score", "verdict"))
    score = F.coalesce("score", F.lit(0.0))
    return parts.join(scores, "_url", "left").select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(score >= threshold, "allow").otherwise("block")).alias("verdict"),
        score.alias("score"),
    )

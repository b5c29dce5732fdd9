"""URL verdicts: longest matching rule, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, exceeds, spread_join

#: Labelled URLs that the trees are fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, SEED = 12, 3, 7
FEATURES = ("url_length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "escapes", "has_fragment", "https", "suffix_rate",
            "suffix_share")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits. Only the distinct characters are counted."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, F.round(total, 6)).otherwise(0.0)


def lexical_features(frame: DataFrame, url: str) -> DataFrame:
    """Add the features that need no other rows."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    double = {
        "url_length": F.log1p(F.length(u)), "host_length": F.length("host"), "depth": F.length(F.regexp_replace("path", "[^/]", "")),
        "labels": F.length(F.regexp_replace("host", "[^.]", "")), "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / n, "entropy": entropy(u),
        "parameters": F.when(query == "", 0).otherwise(F.length(F.regexp_replace(query, "[^&;]", "")) + 1),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")), "escapes": F.length(F.regexp_replace(u, "[^%]", "")) / n,
        "has_fragment": F.instr(u, "#") > 0, "https": F.lower(F.substring(u, 1, 8)) == "https://"}
    return frame.withColumns({k: v.cast("double") for k, v in double.items()})


def apply_rules(frame: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` and ``action`` of the longest rule that fits (host, path), or NULL.

    A rule is a host and the begin of a path, like ``example.com/en/``; it fits the host and all its
    subdomains. Every distinct (host, path) is looked up under each of its parent hosts by a join.
    """
    spark = frame.sparkSession
    listed = spark.createDataFrame([(r, a, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for a, r in rules],
                                   "rule string, action string, rule_host string, rule_path string")
    distinct = frame.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    looked = distinct.withColumn("rule_host", F.explode(parents))
    if exceeds(listed):
        found = spread_join(looked, listed, ["rule_host"])
    else:
        found = looked.join(F.broadcast(listed), "rule_host")
    best = found.where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("r")).select("host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    return frame.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Give every URL a verdict, allow or block.

    The longest rule that fits decides. Other URLs are judged by gradient-boosted trees on lexical
    features: lengths, path depth, digit ratio, entropy, parameters, and two statistics of the host's
    last label (its share of blocked among labelled URLs, smoothed, and its share of all). The trees are
    fitted on the URLs that rules label, at most ``sample`` of them in order of a hash, so each run
    takes the same; statistics of suffixes cover all rows. With labels of one kind only, that kind is
    the verdict of the rest, and without labels all of the rest is allowed.

    Returns the columns of pages, then host, path, rule, verdict and p_block (NULL where a rule
    decided), which take the place of columns so named. A NULL URL, or one without ://, has an empty
    host and path; no rule fits it, and the trees judge it by its other features.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    # Columns of the input are put aside, so that none clashes with a feature.
    aside = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(url).alias("__url"))
    base = aside.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    base = lexical_features(base, "__url").withColumn("__suffix", F.element_at(F.split("host", r"\."), -1))
    ruled = cut_lineage(apply_rules(base, rules), "urls")
    label = (F.col("action") == "block").cast("double")
    stats = ruled.groupBy("__suffix").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("blocked"), F.count("action").alias("labelled"))
    whole = ruled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("blocked"), F.count("action").alias("labelled")).first()
    rate = (whole["blocked"] + 1) / (whole["labelled"] + 2)
    stats = stats.select("__suffix", ((F.col("blocked") + 10 * rate) / (F.col("labelled") + 10)).alias("suffix_rate"),
                         (F.col("n") / max(1, whole["n"])).alias("suffix_share"))
    if exceeds(stats):
        full = spread_join(ruled, stats, ["__suffix"], "left")
    else:
        full = ruled.join(F.broadcast(stats), "__suffix", "left")
    probability = None
    if 0 < whole["blocked"] < whole["labelled"]:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        chosen = full.where("action IS NOT NULL").select("__url", label.alias("__label"), *FEATURES).orderBy(F.xxhash64("__url"), "__url").limit(sample)
        train = cut_lineage(vectors.transform(chosen).select("__label", "__features"), "training")
        trees = GBTClassifier(labelCol="__label", featuresCol="__features", predictionCol="__guess", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(train)
        full = trees.setProbabilityCol("__chances").setRawPredictionCol("__raw").transform(vectors.transform(full))
        probability = F.round(vector_to_array("__chances")[1], 6)
    elif whole["labelled"]:
        probability = F.lit(float(whole["blocked"] > 0))
    else:
        probability = F.lit(0.0)
    guess = F.when(F.col("action").isNull(), probability)
    return full.withColumn("p_block", guess).select(
        "__row.*", "host", "path", "rule", F.coalesce("action", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")

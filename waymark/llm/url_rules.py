"""URL filtering: fixed rules first, association rules mined from labelled urls for the rest.

A url becomes a set of tokens: host, registered domain, top-level domain, first label,
leading directories (digits as #), ending, query keys, scheme. FP-growth mines token
combinations together with the label; combinations that a shorter one with the same
label and at least their confidence makes superfluous are dropped. The rules are
kept in an inverted index by their rarest token, so a url meets only those rules that
share that token with it, never the whole list.

Null urls and urls without "://" have an empty host and path, fit no fixed rule and
get the verdict of the rules on no tokens, which is the default. Repeated rows are
judged alike, other columns are kept; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.tables import fresh, lookup, written

LABEL = "label="
# Host and path by the contract: everything after the first "://".
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (like "net/es/") whose host is the url's or a parent of it and whose path starts the url's; else null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        same = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fits.append(F.when(same & F.startswith(path, F.lit(f"/{rest}")), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def tokens(url: Column) -> Column:
    """The token set of a url."""
    name, place = host(url), path(url)
    labels, steps = F.split(name, r"\."), F.split(F.regexp_replace(place, r"\d+", "#"), "/")
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.split(x, "=")[0]))
    one = [F.concat(F.lit("host="), name), F.concat(F.lit("domain="), F.concat_ws(".", F.slice(labels, -2, 2))), F.concat(F.lit("top="), F.element_at(labels, -1)),
           F.concat(F.lit("first="), labels[0]), F.concat(F.lit("dir="), F.try_element_at(steps, F.lit(2))),
           F.concat(F.lit("end="), F.element_at(steps, -1)), F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1))]
    one = [F.when(F.size(labels) > 1, x) if i == 1 else x for i, x in enumerate(one)]
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(F.array(*one), keys))))


def mine(labelled: DataFrame, url: str = "url", label: str = "label", support: float = 0.002, confidence: float = 0.9, lift: float = 1.2) -> DataFrame:
    """Rules (tokens, label, confidence, support, rarest) from rows of a url and a label; rows without either are left out.

    Rules below the given support, confidence or lift (gain over the label's share of all rows) are pruned.
    """
    known = labelled.filter(F.col(url).isNotNull() & F.col(label).isNotNull())
    baskets = written(known.select(F.concat(tokens(F.col(url)), F.array(F.concat(F.lit(LABEL), F.col(label)))).alias("items")), "url-baskets")
    empty = "tokens array<string>, label string, confidence double, support double, rarest string"
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(LABEL)) & (F.col("lift") >= lift))
    rules = written(found.select(F.sort_array("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(len(LABEL) + 1)).alias("label"),
                                 "confidence", "support"), "url-rules")
    common = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    # A rule is superfluous if one of its tokens can go without loss of confidence.
    one_less = (rules.select("*", F.explode("tokens").alias("out")).filter(F.size("tokens") > 1)
                .select(F.array_except("tokens", F.array("out")).alias("less"), "tokens", F.col("label").alias("l"), F.col("confidence").alias("c")))
    shorter = rules.select(F.col("tokens").alias("less"), F.col("label").alias("l"), F.col("confidence").alias("better"))
    superfluous = one_less.join(shorter, ["less", "l"]).filter("better >= c").select("tokens", F.col("l").alias("label")).distinct()
    kept = rules.join(superfluous, ["tokens", "label"], "left_anti")
    named = kept.select("*", F.explode("tokens").alias("token")).join(common, "token")
    return (named.groupBy("tokens", "label", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest")))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", out: str = "verdict", by: str = "mined_rule") -> DataFrame:
    """Add `out`, the label of the best mined rule that fits (else the default), and `by`, that rule's tokens.

    The best rule has the highest confidence, then support, then most tokens. Urls of
    one token set are judged once.
    """
    kept = [c for c in urls.columns if c.lower() not in (out.lower(), by.lower())]
    key, number = fresh(urls.columns, "token_key"), fresh(urls.columns, "token_set")
    keyed = urls.withColumn(number, F.array_sort(tokens(F.col(f"`{url}`")))).withColumn(key, F.xxhash64(number))
    sets = keyed.select(F.col(key).alias("key"), F.col(number).alias("set")).distinct()
    index = lookup(written(rules, "url-index"))
    met = sets.select("key", "set", F.explode("set").alias("rarest")).join(index, "rarest").filter(F.size(F.array_except("tokens", "set")) == 0)
    rank = F.struct("confidence", "support", F.size("tokens"), F.array_join("tokens", " "), "label")
    judged = written(met.groupBy("key", "set").agg(F.max_by(F.struct("label", "tokens"), rank).alias("rule")), "url-verdicts")
    right = lookup(judged.select(F.col("set").alias(f"{number}_"), F.col("key").alias(f"{key}_"), F.col("rule").alias(f"{key}_rule")))
    joined = keyed.join(right, (F.col(key) == F.col(f"{key}_")) & (F.col(number) == F.col(f"{number}_")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"{key}_rule.label"), F.lit(default)).alias(out),
                         F.array_join(F.col(f"{key}_rule.tokens"), " ").alias(by))

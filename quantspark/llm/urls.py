"""URL filter: rules first, then boosted trees on lexical features."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit as fit_trees
from .common import table, uniform, written

#: (verdict, host, path); the longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that the suffix statistics and the trees are fitted on, at most.
TRAINING_ROWS = 20000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; '' for null or without ://."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, such as net/de/, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits for a character: characters in order, whose runs are counted in one pass, so a long URL takes no more for each."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    weighed = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    kind = "struct<last:string,run:double,sum:double>"
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("sum")).cast(kind)
    step = lambda a, c: F.when(a["last"] == c, state(c, a["run"] + 1, a["sum"])).otherwise(state(c, F.lit(1.0), a["sum"] + weighed(a["run"])))
    total = F.aggregate(chars, state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, lambda a: a["sum"] + weighed(a["run"]))
    n = F.size(chars)
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    labels = F.split(host, r"\.")
    return {
        "top": F.element_at(labels, -1),
        "registered": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."),
        "folder": F.concat(F.element_at(labels, -1), F.lit("/"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
    }


def lexical_features(url: Column, host: Column, path: Column, rates: list[Column]) -> Column:
    """rates: the share of blocked URLs by suffix of each kind."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    digits = lambda c: F.length(F.regexp_replace(c, r"[^0-9]", ""))
    number = [
        F.length(u), F.length(host), F.length(path), F.size(F.split(path, "/")), F.size(F.split(host, r"\.")), digits(u) / n, digits(path), digits(host),
        F.regexp_count(u, F.lit("-")), F.regexp_count(u, F.lit("[?&][^=&#]*=")), F.regexp_count(u, F.lit("[^A-Za-z0-9]")) / n, u.startswith("https").cast("int"),
        u.contains("#").cast("int"), _entropy(host), _entropy(path),
    ]
    return F.array(*[x.cast("double") for x in [*number, *rates]])


@dataclass
class UrlModel:
    """Suffix statistics, one row (kind, suffix, bad_rate) for each suffix of the fitted sample, and trees over the features."""

    suffixes: DataFrame
    rate: float
    trees: Boosted

    def features(self, parsed: DataFrame, name: str = "features") -> DataFrame:
        """parsed(url, host, path, ...) with the features. The statistics have four rows for each fitted URL at most, so they are broadcast."""
        out, rates = parsed, []
        for kind, suffix in _suffixes(F.col("host"), F.col("path")).items():
            own = self.suffixes.filter(F.col("kind") == kind).select(F.col("suffix").alias(f"suffix_{kind}"), F.col("bad_rate").alias(f"rate_{kind}"))
            out = out.join(F.broadcast(own), suffix == F.col(f"suffix_{kind}"), "left")
            rates.append(F.coalesce(f"rate_{kind}", F.lit(self.rate)))
        made = lexical_features(F.col("url"), F.col("host"), F.col("path"), rates)
        return out.select(*[parsed[c] for c in parsed.columns], made.alias(name))

    def score(self, parsed: DataFrame) -> DataFrame:
        return self.trees.score(self.features(parsed), "features", "score")


def parse(urls: DataFrame, *more: str) -> DataFrame:
    """urls(url, ...) -> url, host, path and the given columns."""
    return urls.select(*more, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def fit_urls(labelled: DataFrame, training_rows: int = TRAINING_ROWS) -> UrlModel:
    """labelled(url, host, path, label 0 or 1), label 1 for URLs to block.

    A sample of at most training_rows URLs, chosen by a hash of the URL, is split into halves by another: one gives the
    suffix statistics, the other trains the trees (two thirds) and calibrates them (one third).
    """
    order = F.xxhash64("url", F.lit(9))
    sample = written(labelled.select("url", "host", "path", "label", order.alias("order")).orderBy("order", "url").limit(training_rows), "labelled-urls")
    part = uniform("url", F.lit(10))
    half = sample.filter(part < 0.5)
    rate = half.agg(F.avg("label")).first()[0] or 0.0
    kinds = F.create_map(*[x for k, c in _suffixes(F.col("host"), F.col("path")).items() for x in (F.lit(k), c)])
    per = half.select("label", F.explode(kinds).alias("kind", "suffix")).filter("suffix is not null").groupBy("kind", "suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    suffixes = written(per.select("kind", "suffix", ((F.col("bad") + 4 * rate) / (F.col("n") + 4)).alias("bad_rate")), "url-suffixes")
    model = UrlModel(suffixes, rate, Boosted(rate))
    rows = model.features(sample.filter(part >= 0.5).withColumn("held", part >= 5 / 6))
    model.trees = fit_trees(written(rows.select("features", "label", "held"), "url-features"), "features", "label", "held", rounds=10)
    return model


def judge(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """pages(page_id, url, ...) -> page_id, host, path, rule, verdict, score: one row per row of pages.

    URLs that a rule fits are the labelled ones, with the rule's verdict as label, and keep that verdict. The others
    get the verdict of boosted trees, fitted on at most training_rows labelled URLs (see fit_urls). The trees see
    lengths, depth, digit and symbol ratios, entropies, parameter counts and, for top-level domain, registered domain,
    first folder under the top-level domain and file extension, the smoothed share of blocked URLs among those of the
    sample. score is the probability of block.

    Null, empty and malformed URLs have an empty host and path, and the trees judge them. Repeated rows give a row
    each. With no labelled URL, or labels of one kind, all others get the verdict of the more usual label (allow
    without any). Only the URL column is read, not the page.
    """
    parsed = parse(pages, "page_id")
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", say)
    labelled = parsed.filter("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("int").alias("label"))
    scored = fit_urls(labelled, training_rows).score(parsed)
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

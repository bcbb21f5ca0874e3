"""URL verdicts by rules and, where none fits, by the ratio of two character language models; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, settle

ORDER = 5  # characters of a window: the last one and up to four before it
ALPHABET = 256  # the share of a character never seen is one of so many
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Fits the host, and all its subdomains, where the path begins with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """``field`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def _windows(name: Column) -> Column:
    padded = F.concat(F.lit(START * (ORDER - 1)), name, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))


def window_ratios(windows: DataFrame) -> DataFrame:
    """(w, good, bad, n) with counts of each window -> (w, n, ratio): log of its probability under good over that under bad.

    Both models interpolate all orders by Witten and Bell: P(c | context) = (n(context c) + t P(c | shorter context)) /
    (n(context) + t), t being the number of different characters seen after the context. A context that a model never
    saw gives way to the shorter one, so the order varies from place to place. Each order is one aggregation by
    n-gram, one window over its context and one join to the order below: no key there has more rows than the alphabet.
    """
    below = None
    for k in range(1, ORDER + 1):
        grams = windows.groupBy(F.right("w", F.lit(k)).alias("g")).agg(F.sum("good").alias("a"), F.sum("bad").alias("b"), F.sum("n").alias("n"))
        same = Window.partitionBy(F.left("g", F.lit(k - 1)))
        grams = grams.select(
            "*", F.sum("a").over(same).alias("na"), F.sum("b").over(same).alias("nb"),
            F.count_if(F.col("a") > 0).over(same).alias("ta"), F.count_if(F.col("b") > 0).over(same).alias("tb"),
        )
        if below is None:
            grams = grams.withColumns({"pa0": F.lit(1.0 / ALPHABET), "pb0": F.lit(1.0 / ALPHABET)})
        else:
            grams = grams.withColumn("s", F.right("g", F.lit(k - 1))).join(below, "s")
        mixed = {
            f"p{x}": F.when(F.col(f"n{x}") == 0, F.col(f"p{x}0")).otherwise((F.col(x) + F.col(f"t{x}") * F.col(f"p{x}0")) / (F.col(f"n{x}") + F.col(f"t{x}")))
            for x in "ab"
        }
        grams = settle(grams.withColumns(mixed).select("g", "n", "pa", "pb"), f"url-order-{k}")
        below = grams.select(F.col("g").alias("s"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0"))
    return grams.select(F.col("g").alias("w"), "n", (F.log("pa") - F.log("pb")).alias("ratio"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    The verdict of the longest fitting rule, or else that of the models: ``score``, the mean over the URL's characters
    of the log ratio of the model of accepted to that of rejected URLs, against a threshold. URLs that a rule accepts
    or rejects are what the models are counted from, all of them; each distinct host and path is counted once with its
    number of rows as its weight. The threshold is the one that would err equally often on both if their scores were
    normal. ``score`` is null where a rule decides.

    A null URL, or one without ``://``, has an empty host and path and is judged by the models. Where either model has
    no URL to learn from, the verdict is allow. Repeated rows get the same verdict, a null id stays null. An empty
    table gives an empty result.
    """
    url = pages[url_col]
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(
        "*", rule_of(F.col("host"), F.col("path"), rules, "text").alias("rule"), rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("given"),
        F.concat("host", "path").alias("name"),
    )
    names = settle(rows.groupBy("name", "given").agg(F.count("*").alias("rows")), "url-names")
    spread = settle(names.select("name", "given", "rows", F.explode(_windows(F.col("name"))).alias("w")), "url-windows")
    counts = spread.groupBy("w").agg(
        F.sum(F.when(F.col("given") == "allow", F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("given") == "block", F.col("rows")).otherwise(0)).alias("bad"),
        F.count("*").alias("n"),
    )
    ratios = window_ratios(settle(counts, "url-counts"))
    scored = lookup(spread, ratios, "w", "n", spread.count()).groupBy("name", "given").agg(F.first("rows").alias("rows"), F.avg("ratio").alias("score"))
    scored = settle(scored, "url-scores")
    known = {
        r["given"]: r
        for r in scored.where("given is not null").groupBy("given").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).collect()
    }
    threshold = float("-inf")
    if len(known) == 2:
        good, bad = known["allow"], known["block"]
        wide = good["sd"] + bad["sd"]
        threshold = (good["mean"] * bad["sd"] + bad["mean"] * good["sd"]) / wide if wide else (good["mean"] + bad["mean"]) / 2
    open_ = rows.where("given is null")
    total = scored.where("given is null").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    judged = lookup(settle(open_, "url-open"), scored.where("given is null").select("name", "rows", "score"), "name", "rows", total)
    judged = judged.withColumn("verdict", F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block"))
    ruled = rows.where("given is not null").withColumns({"verdict": F.col("given"), "score": F.lit(None).cast("double")})
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    return ruled.select(columns).unionByName(judged.select(columns))

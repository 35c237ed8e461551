"""URL filters: given rules first, then association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Most association rules whose index is shared with all executors; more are joined by shuffle.
MOST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A rule as text, host/path, and its verdict: it fits its host and all subdomains, and paths that start like its path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the query.
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """What a URL is made of, sorted and without repeats: host labels, path segments, query keys; digits as #."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(F.lower(path), "[/.]"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.split(F.lower(query), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_replace(x, "=.*", "")))
    words = F.flatten(F.array(labels, segments, keys))
    return F.array_sort(F.array_distinct(F.filter(words, lambda x: F.length(x) > 2)))


def items(labelled: DataFrame) -> DataFrame:
    """token, item for every token of labelled URLs (column tokens): tokens that the same URLs hold are one item, named by the smallest.

    On the labelled URLs one of them says what all of them say together, so a long URL that comes again has one item and
    not a rule for each subset of its tokens. Sets of URLs are told by their number and 128 bits.
    """
    sets = labelled.select("tokens").distinct().select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("b"), "tokens").alias("b"))
    held = stored(sets.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), "held")
    named = held.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return stored(held.join(named, ["n", "a", "b"]).select("token", "item"), "items")


def with_items(sets: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct tokens of sets that hold a known token, with the items that they hold and, of each item, the smallest token: tokens, items, told (a map)."""
    met = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(known, "token")
    one = met.groupBy("tokens", "item").agg(F.min("token").alias("token"))
    return one.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("told")).select("tokens", F.map_keys("told").alias("items"), "told")


def mine(labelled: DataFrame, known: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_urls: int = 5) -> DataFrame:
    """Rules tokens -> block from labelled URLs (columns tokens, block): FP-growth over their items(), pruned by support, confidence and lift.

    A rule holds in min_support of all labelled URLs and in min_urls of them at least, so that no
    single URL becomes a rule where few are labelled. It stands for all rules that have one token of each of its items.

    Returns rule_id, tokens (the antecedent's items, sorted), confidence and support. A rule is left
    out if one with fewer of its items is as sure; each is looked for under its rarest item
    alone, so an item that most rules hold brings no pairs. FP-growth spreads the conditional trees over the executors.
    """
    baskets = labelled.join(with_items(labelled, known), "tokens")
    baskets = stored(baskets.select(F.array_union("items", F.array(F.when(F.col("block"), F.lit("=block")).otherwise(F.lit("=allow")))).alias("items")), "baskets")
    floor = (min_urls - 0.5) / max(baskets.count(), min_urls)  # FP-growth rounds the count up
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, floor), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit("=block"))) & (F.col("lift") > 1))
    rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    parts = keyed(rules).select("token", F.col("tokens").alias("small"), F.col("confidence").alias("sure"))
    within = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(parts, "token")
    within = within.filter((F.size("small") < F.size("tokens")) & (F.size(F.array_except("small", "tokens")) == 0) & (F.col("sure") >= F.col("confidence")))
    pruned = rules.join(within.select("tokens").distinct(), "tokens", "left_anti")
    return pruned.withColumn("rule_id", F.xxhash64("tokens"))


def keyed(rules: DataFrame) -> DataFrame:
    """rules with token, that of its tokens which the fewest rules hold."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(held, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("least"))
    return rules.join(rarest.select("tokens", F.col("least.token").alias("token")), "tokens")


def matches(sets: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """For each distinct token set (column tokens) that holds a token of each item of a rule, its surest one: tokens, mined.

    The rules' inverted index, rarest item to rule, is broadcast up to MOST_RULES rules and joined by
    shuffle beyond; a rule fires for a set that holds all its items.
    """
    rules = stored(rules.select("tokens", "confidence"), "pruned")
    index = stored(keyed(rules).select("token", F.col("tokens").alias("needs"), "confidence"), "index")
    index = F.broadcast(index) if index.count() <= MOST_RULES else index.hint("shuffle_merge")
    full = with_items(sets, known).select("*", F.explode("items").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "items")) == 0)
    said = F.array_join(F.array_sort(F.transform("needs", lambda item: F.col("told")[item])), " ")
    return full.groupBy("tokens").agg(F.max(F.struct("confidence", said.alias("mined"))).alias("best")).select("tokens", "best.mined")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", **limits) -> DataFrame:
    """Judge the url of every row of pages.

    Returns a row per row of pages: id, host, path, rule (the longest that fits, or null),
    verdict (the rule's; else block if a mined rule fires, else allow) and mined (the mined rule
    that fired on a page without a rule). Mining learns from all pages that carry a label: the
    verdict of the rule that fits, else what labels (doc_id, quality, toxic) says of the page's
    number, where quality 0 or toxic 1 means block. Null URLs and URLs without :// have
    empty host and path, no tokens, and are allowed; null ids stay null; repeated rows are
    judged each; other columns are not read; without labels or rows nothing is mined.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    rows = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    known = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    ruled = rows.filter(F.col("fit").isNotNull()).select("tokens", (F.col("fit.verdict") == "block").alias("block"))
    others = rows.filter(F.col("fit").isNull()).join(known, "id").select("tokens", F.col("bad").alias("block"))
    labelled = stored(ruled.unionByName(others).filter(F.col("block").isNotNull() & (F.size("tokens") > 0)), "labelled")
    mined = None
    if not labelled.isEmpty():
        known = items(labelled)
        mined = stored(matches(rows.filter(F.col("fit").isNull()), mine(labelled, known, **limits), known), "matches")
    if mined is None:
        judged = rows.withColumn("mined", F.lit(None).cast("string"))
    else:
        judged = rows.join(mined, "tokens", "left")
    fired = F.when(F.col("fit").isNull(), F.col("mined"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(fired.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), fired.alias("mined"))

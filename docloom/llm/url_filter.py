"""URL filters: association rules over URL tokens.

Frequent token combinations of labelled URLs are mined by FP-growth, counted exactly and pruned by support and confidence; rules match through an inverted index on their rarest token.
Labels come from the pages' contents or from the caller, never from the fixed rules. A short list of fixed rules (host and path prefix) goes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialise

#: (verdict, host and all its subdomains, start of the path)
FixedRule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty where there is none or no url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def fixed_rule(rules: Sequence[FixedRule]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text, and its verdict; null where none fits."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for kind, host, start in reversed(order):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(start)
        name = F.when(fits, F.lit(host + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def url_tokens(url: str = "url") -> Column:
    """Distinct tokens: labels of the host, parts of the path without digits, names of query fields."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split("path", r"[/._-]+"), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.lower(F.regexp_extract(x, "^([^=]*)", 1))))
    return F.array_distinct(F.filter(F.concat(labels, parts, fields), lambda t: (F.length(t) > 2) & ~t.rlike(r"^p:\d+$")))


def content_labels(pages: DataFrame) -> DataFrame:
    """(url, label) of every page, labelled by what it shows: block for a page of few words, of shouting or of one phrase over and over; else allow.

    A page shows what is left without scripts, styles and tags. Under 20 words are few; shouting is over a third of words that end in two marks or are capitals alone (four letters or more); over and over is under a fifth of distinct words. A null html shows nothing.
    """
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    shown = F.filter(F.split(F.regexp_replace(bare, r"(?s)<[^>]*>|&[a-z]+;", " "), r"\s+"), lambda w: w != "")
    loud = F.size(F.filter("shown", lambda w: w.rlike(r"[!?*%#]{2,}$|^\p{Lu}{4,}\p{Punct}*$")))
    n = F.size("shown")
    bad = (n < 20) | (loud * 3 > n) | (F.size(F.array_distinct("shown")) * 5 < n)
    return pages.withColumn("shown", shown).select("url", F.when(bad, "block").otherwise("allow").alias("label"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, max_tokens: int = 3, min_urls: int = 20, max_items: int = 16, min_chance: float = 3.0) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support, rarest) from (url_tokens, label).

    FP-growth runs over baskets of a URL's tokens and its label. A rule needs its share of the labelled URLs (``min_support``, and ``min_urls`` of them) and confidence: the share of its label among the URLs with its tokens if both labels were equally frequent (``min_confidence``), so that a rule of the frequent label must tell more than that label's frequency. Chance must not explain it either: its count lies ``min_chance`` standard deviations over that of as many URLs drawn at random.
    Tokens that the same URLs hold are one item, so a site of long, fixed paths has few combinations; a rule names at most ``max_tokens`` items, with all their tokens.
    A basket of more items gives FP-growth the ``max_items`` whose labels differ most from the common share; the sets with an item that any basket left out are found exactly, a size a round (``_sets_with``). Every candidate is then counted over all URLs and all their tokens.
    """
    rows = materialise(labelled.select("url_tokens", "label").withColumn("row", F.xxhash64("url_tokens", "label")))
    n, share = rows.agg(F.count("*"), F.avg((F.col("label") == "block").cast("double"))).first()
    floor = max(min_support, min_urls / max(n, 1))
    each = rows.withColumn("token", F.explode("url_tokens"))
    # Sums of two hashes of the rows tell which tokens stand in the same rows.
    same = [F.sum(F.hash(F.lit(k), "row").cast("long")).alias(f"s{k}") for k in (1, 2)]
    known = each.groupBy("token").agg(F.count("*").alias("n"), F.sum((F.col("label") == "block").cast("long")).alias("k"), *same)
    # At most (tokens a URL) / min_support of them: every one stands in so many of the URLs.
    known = materialise(known.filter(F.col("n") >= floor * n))
    items = known.groupBy("n", "k", "s1", "s2").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("members"))
    telling = F.abs(F.col("k") - F.col("n") * F.lit(share or 0.0)) / F.sqrt("n")
    items = materialise(items.withColumn("telling", telling))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("telling", "item")), asc=False), lambda x: x["item"])
    lists = rows.groupBy("url_tokens", "label").agg(F.count("*").alias("copies"))
    baskets = lists.withColumn("token", F.explode("url_tokens")).join(items.select("item", "telling"), F.col("token") == F.col("item"))
    baskets = baskets.groupBy("url_tokens", "label").agg(F.first("copies").alias("copies"), ranked.alias("all"))
    baskets = materialise(baskets.groupBy("all", "label").agg(F.sum("copies").cast("int").alias("copies")))
    given = baskets.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.array_append(F.slice("all", 1, max_items), F.concat(F.lit("="), "label")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, floor), minConfidence=min_confidence).fit(given).freqItemsets
    labels = F.filter("items", lambda t: t.startswith("="))
    found = found.select(F.get(labels, 0).alias("verdict"), F.filter("items", lambda t: ~t.startswith("=")).alias("parts"))
    found = found.filter(F.col("verdict").isNotNull() & F.size("parts").between(1, max_tokens))
    left_out = materialise(baskets.select(F.explode(F.slice("all", max_items + 1, F.greatest(F.size("all"), F.lit(1)))).alias("item")).distinct())
    if not left_out.isEmpty():
        found = found.unionByName(_sets_with(left_out, baskets, floor * n, max_tokens))
    found = found.withColumn("rule_id", F.xxhash64(F.array_sort("parts"), "verdict")).dropDuplicates(["rule_id"])
    single = known.select("token", "n")
    spread = found.withColumn("item", F.explode("parts")).join(items.select("item", "members"), "item").withColumn("token", F.explode("members")).join(single, "token")
    rules = spread.groupBy("rule_id").agg(
        F.array_sort(F.collect_set("token")).alias("tokens"), F.expr("substring(any_value(verdict), 2)").alias("verdict"), F.min_by("token", F.struct("n", "token")).alias("rarest")
    )
    rules = materialise(rules)
    hits = lists.withColumn("rarest", F.explode("url_tokens")).join(rules, "rarest").filter(F.size(F.array_except("tokens", "url_tokens")) == 0)
    right = F.sum(F.when(F.col("label") == F.col("verdict"), F.col("copies")).otherwise(0))
    counted = hits.groupBy("rule_id").agg(right.alias("right"), F.sum("copies").alias("held"), F.any_value("verdict").alias("__verdict"))
    own = F.when(F.col("__verdict") == "block", F.lit(share or 0.0)).otherwise(F.lit(1 - (share or 0.0)))
    for_it, against = F.col("right") / own, (F.col("held") - F.col("right")) / (1 - own)
    chance = (F.col("right") - F.col("held") * own) / F.sqrt(F.col("held") * own * (1 - own))
    counted = counted.filter((own > 0) & (own < 1)).select("rule_id", (for_it / (for_it + against)).alias("confidence"), (F.col("right") / F.lit(max(n, 1))).alias("support"), chance.alias("chance"))
    return materialise(rules.join(counted.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= floor) & (F.col("chance") >= min_chance)), "rule_id").drop("chance"))


def _sets_with(wanted: DataFrame, baskets: DataFrame, least: float, most: int) -> DataFrame:
    """(verdict, parts): all sets of up to ``most`` items, one of them in ``wanted`` (item), that at least so many baskets (all, label, copies) of one label hold.

    A set is grown only from sets that are frequent themselves. Wanted items go first in a basket's order, so every such set begins with one and is grown once.
    """
    first = F.broadcast(wanted.select("item", F.lit("0").alias("first")))
    names = baskets.withColumn("id", F.monotonically_increasing_id()).withColumn("item", F.explode("all")).join(first, "item", "left")
    names = names.withColumn("name", F.concat(F.coalesce("first", F.lit("1")), "item")).groupBy("id").agg(F.first("label").alias("label"), F.first("copies").alias("copies"), F.array_sort(F.collect_list("name")).alias("names"))
    names = materialise(names.filter(F.get("names", 0).startswith("0")))
    held = names.select("label", "copies", "names", F.explode(F.filter("names", lambda x: x.startswith("0"))).alias("last")).withColumn("parts", F.array("last"))
    out, frequent = None, None
    for size in range(1, most + 1):
        if size > 1:
            held = held.withColumn("last", F.explode(F.filter("names", lambda x: x > F.col("last")))).withColumn("parts", F.array_append("parts", F.col("last")))
        if size > 2:  # without the item before its last, a frequent set is a frequent set too
            held = held.join(frequent.withColumnRenamed("parts", "shorter"), (held["label"] == frequent["label"]) & (F.array_append(F.slice("parts", 1, size - 2), F.col("last")) == F.col("shorter")), "left_semi")
        frequent = materialise(held.groupBy("label", "parts").agg(F.sum("copies").alias("n")).filter(F.col("n") >= least).select("label", "parts"))
        out = frequent if out is None else out.unionByName(frequent)
        held = held.join(frequent, ["label", "parts"], "left_semi")
    return out.select(F.concat(F.lit("="), "label").alias("verdict"), F.transform("parts", lambda x: F.substring(x, F.lit(2), F.length(x))).alias("parts"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best matching rule of each row of (key, url_tokens): (key, mined_rule, mined_verdict, confidence).

    Rows with the same tokens match alike, so distinct token lists probe the index. The most confident rule wins, then the one of more tokens, more support, then by id.
    """
    lists = urls.select("url_tokens").distinct()
    probes = lists.withColumn("rarest", F.explode("url_tokens"))
    hits = probes.join(rules, "rarest").filter(F.size(F.array_except("tokens", "url_tokens")) == 0)
    best = hits.groupBy("url_tokens").agg(
        F.max_by(
            F.struct(F.array_join("tokens", " ").alias("mined_rule"), F.col("verdict").alias("mined_verdict"), "confidence"),
            F.struct("confidence", F.size("tokens"), "support", "rule_id"),
        ).alias("best")
    )
    return urls.join(best, "url_tokens", "left").select("key", "best.*")


def judge_urls(pages: DataFrame, fixed: Sequence[FixedRule], labelled: DataFrame | None = None, default: str = "allow", min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``; needs page_id and url, other columns go.

    The longest fixed rule that fits decides; else the best mined rule; else ``default``. ``rule`` names the fixed rule, ``mined_rule`` the tokens of the mined one.
    ``labelled`` has (url, label) with labels allow or block, such as ``content_labels``; without it nothing is mined.
    A null url has empty host and path and no tokens. Repeated rows are judged alike; an empty table gives no rows.
    """
    name, verdict = fixed_rule(fixed)
    judged = with_parts(pages.select("page_id", "url")).withColumns({"rule": name, "fixed": verdict, "url_tokens": url_tokens()})
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame([], "url string, label string")
    teach = with_parts(labelled.select("url", "label")).select(url_tokens().alias("url_tokens"), "label")
    rules = mine_rules(teach, min_support, min_confidence)
    asked = judged.filter(F.col("fixed").isNull()).select(F.col("url_tokens").alias("key"), "url_tokens").distinct()
    matched = match_rules(asked, rules).withColumnRenamed("key", "url_tokens")
    out = judged.join(matched, "url_tokens", "left")
    final = F.coalesce("fixed", "mined_verdict", F.lit(default))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), F.when(F.col("fixed").isNull(), F.col("mined_rule")).alias("mined_rule"), F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))

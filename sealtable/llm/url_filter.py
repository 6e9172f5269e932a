"""URL filtering: hand-written host and path rules, and association rules mined for the rest.

URLs that a hand-written rule decides are the labelled examples. FP-growth
finds the token combinations that are frequent among them; a combination with
a verdict is an association rule, pruned by support and confidence and, if a
part of it says the same as surely, dropped. Tokens that stand in the very same
URLs are mined as one and told apart afterwards, as they would else double the
combinations each. Labelled URLs that still have many are kept from FP-growth, which
goes through combinations of every length, and mined level by level up to the length of
a rule; what is frequent in either part is counted over all. Rules meet URLs through an
inverted index: each is filed under its rarest token, joined with the tokens of
the URL and then checked whole. Digits are one token character, so URLs fall
into few patterns; patterns, not URLs, are matched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, join_hot

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that are mined at most (those with the least hash); share of them a combination must be in.
MAX_ROWS, MIN_SUPPORT = 50_000, 0.01
#: Share of a combination's labelled URLs that must have the verdict; most tokens of a combination.
MIN_CONFIDENCE, MAX_TOKENS = 0.8, 3
#: Different frequent tokens, counting those of the same URLs once, of a labelled URL that goes to FP-growth; others are mined level by level.
MAX_BASKET = 14


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


# The hand-written rules.
HOST_RULES = (
    HostRule(ALLOW, "com", "/"),
    HostRule(BLOCK, "example.com", "/en/"),
    HostRule(ALLOW, "www.example.com", "/en/"),
    HostRule(BLOCK, "net", "/es/"),
    HostRule(BLOCK, "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _first_rule(rules: Sequence[HostRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls; of equal texts the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: host labels and their parts, path segments, query keys; digits become #."""
    def parts(of: Column, by: str, mark: str) -> Column:
        found = F.filter(F.split(F.regexp_replace(of, "[0-9]+", "#"), by), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.regexp_replace(query, r"=[^&]*", "")
    return F.array_sort(
        F.array_distinct(F.concat(parts(host, r"[.\-]", "h:"), parts(path, r"[/.]", "p:"), parts(keys, "&", "q:")))
    )


def _token_classes(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, rep, of) for each token in enough of ``labelled`` (row, tokens): the number of its rows, and the least token of just these."""
    row = F.xxhash64("row")
    same = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("of"), F.bit_xor(row).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("again"))).alias("y")
    )
    frequent = same.filter(F.col("of") >= min_support * labelled.count())
    reps = frequent.groupBy("of", "x", "y").agg(F.min("token").alias("rep"))
    return checkpointed(frequent.join(reps, ["of", "x", "y"]).select("token", "rep", "of"))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
    max_basket: int = MAX_BASKET,
) -> DataFrame:
    """(rule_tokens, verdict, support, confidence, rarest) from ``labelled`` (tokens, verdict).

    All rows are mined. FP-growth gets those of at most ``max_basket`` tokens,
    the others take ``_long_sets``; a combination frequent among all rows is
    frequent in one part at least, and is counted over both. Rules have at most
    ``max_tokens`` tokens. No labelled rows give no rules.
    """
    labelled = checkpointed(labelled.withColumn("row", F.monotonically_increasing_id()))
    classes = _token_classes(labelled, min_support)
    listed = labelled.select("row", "verdict", F.explode("tokens").alias("token")).join(classes, "token")
    kept = checkpointed(listed.groupBy("row", "verdict").agg(F.array_sort(F.collect_set("rep")).alias("reps")))
    short = kept.filter(F.size("reps") <= max_basket)
    n_long = kept.filter(F.size("reps") > max_basket).count()
    # Rows without a frequent token count too.
    verdict = F.concat(F.lit("verdict="), F.col("verdict"))
    bare = labelled.join(listed.select("row"), "row", "left_anti").select(F.array(verdict).alias("items"))
    baskets = checkpointed(short.select(F.array_append("reps", verdict).alias("items")).unionByName(bare))
    frequent = checkpointed(
        FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets.select(
            F.array_sort("items").alias("items"), "freq"
        )
    )
    split = frequent.select(
        F.filter("items", lambda x: ~x.startswith("verdict=")).alias("rule_tokens"),
        F.get(F.filter("items", lambda x: x.startswith("verdict=")), F.lit(0)).alias("marked"),
        "freq",
    ).filter(F.size("rule_tokens").between(1, max_tokens))
    whole = split.filter(F.col("marked").isNull()).select("rule_tokens", F.col("freq").alias("of"))
    if n_long:
        least = math.ceil(min_support * labelled.count())
        alike = kept.groupBy("reps", "verdict").agg(F.count(F.lit(1)).alias("n"))
        alike = checkpointed(alike.select(F.monotonically_increasing_id().alias("basket"), "*", (F.size("reps") > max_basket).alias("long")))
        sets = whole.select("rule_tokens").union(_long_sets(alike, least, min_support * n_long, max_tokens)).distinct()
        counted = _counted(sets, alike).filter(F.col("freq") >= least)
    else:
        marked = split.filter(F.col("marked").isNotNull()).withColumn("verdict", F.substring("marked", len("verdict=") + 1, 100))
        counted = marked.join(whole, "rule_tokens")
    sure = counted.select(
        "rule_tokens", "verdict", F.col("freq").alias("support"), (F.col("freq") / F.col("of")).alias("confidence")
    ).filter(F.col("confidence") >= min_confidence)
    sure = checkpointed(sure) if n_long else sure
    # A rule with a shorter one inside it of the same verdict and at least its confidence says nothing new.
    shorter = sure.select(F.col("rule_tokens").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"))
    parts = sure.select("rule_tokens", "verdict", "confidence", F.explode(_proper_parts(F.col("rule_tokens"), max_tokens)).alias("part"))
    idle = (
        parts.join(shorter, "part")
        .filter((F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence")))
        .select("rule_tokens", "verdict")
        .distinct()
    )
    kept = _told_apart(sure.join(idle, ["rule_tokens", "verdict"], "left_anti"), classes, max_tokens)
    rarest = (
        kept.select("rule_tokens", F.explode("rule_tokens").alias("token"))
        .join(classes, "token")
        .groupBy("rule_tokens")
        .agg(F.min(F.struct("of", "token"))["token"].alias("rarest"))
    )
    return kept.join(rarest, "rule_tokens")


def _counted(sets: DataFrame, alike: DataFrame) -> DataFrame:
    """(rule_tokens, verdict, freq, of) of ``sets`` (rule_tokens) over all of ``alike`` (reps, verdict, n)."""
    listed = alike.select("reps", "verdict", "n", F.explode("reps").alias("rep"))
    met = listed.join(sets.withColumn("rep", F.get("rule_tokens", F.lit(0))), "rep").filter(F.size(F.array_except("rule_tokens", "reps")) == 0)
    by_verdict = checkpointed(met.groupBy("rule_tokens", "verdict").agg(F.sum("n").alias("freq")))
    return by_verdict.join(by_verdict.groupBy("rule_tokens").agg(F.sum("freq").alias("of")), "rule_tokens")


def _long_sets(alike: DataFrame, least: float, least_long: float, max_tokens: int) -> DataFrame:
    """(rule_tokens): of the sets in at least ``least`` rows and ``least_long`` long ones, those that can be a rule.

    ``alike`` has (basket, reps, verdict, n, long). A set whose rows all have one
    verdict is not extended, nor one in as many rows as a set inside it: what
    would come of it has a shorter rule inside it that says the same as surely.
    """
    of_basket = alike.select("basket", "verdict", "n", F.when(F.col("long"), F.col("n")).otherwise(0).alias("n_long"))
    held = alike.select("basket", F.explode(F.transform("reps", lambda t: F.array(t))).alias("rule_tokens"))
    found, last = None, None
    for size in range(1, max_tokens + 1):
        if last is not None:
            able = held.join(last.filter("mixed").select("rule_tokens"), "rule_tokens")
            able = able.select("basket", F.slice("rule_tokens", 1, size - 2).alias("head"), F.element_at("rule_tokens", -1).alias("end"))
            able = checkpointed(able)
            pairs = able.join(able.withColumnRenamed("end", "next"), ["basket", "head"]).filter("end < next")
            held = pairs.select("basket", F.concat("head", F.array("end", "next")).alias("rule_tokens"))
        sets = held.join(of_basket, "basket").groupBy("rule_tokens").agg(
            F.sum("n").alias("of"), F.sum("n_long").alias("of_long"), (F.min("verdict") < F.max("verdict")).alias("mixed")
        )
        sets = sets.filter((F.col("of") >= least) & (F.col("of_long") >= least_long))
        if last is not None:
            # Each set of one token less must be there, be mixed, and have more rows.
            parts = F.transform("rule_tokens", lambda t: F.array_remove("rule_tokens", t))
            inner = last.filter("mixed").select(F.col("rule_tokens").alias("part"), F.col("of").alias("part_of"))
            free = sets.select("rule_tokens", "of", F.explode(parts).alias("part")).join(inner, "part").filter("part_of > of")
            free = free.groupBy("rule_tokens").agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") == size)
            sets = sets.join(free.select("rule_tokens"), "rule_tokens")
        last = checkpointed(sets.select("rule_tokens", "of", "mixed"))
        found = last.select("rule_tokens") if found is None else found.union(last.select("rule_tokens"))
    return found


def _told_apart(rules: DataFrame, classes: DataFrame, max_tokens: int) -> DataFrame:
    """Each rule once for every choice of one token for each representative."""
    members = classes.groupBy("rep").agg(F.collect_list("token").alias("members"))
    listed = rules.select("rule_tokens", "verdict", "support", "confidence", F.explode("rule_tokens").alias("rep")).join(members, "rep")
    rules = listed.groupBy("rule_tokens", "verdict", "support", "confidence").agg(F.collect_list("members").alias("members"))
    rules = rules.withColumn("rule_tokens", F.array().cast("array<string>"))
    for k in range(max_tokens):
        rules = rules.withColumn("one", F.explode_outer(F.get("members", F.lit(k))))
        rules = rules.withColumn("rule_tokens", F.when(F.col("one").isNull(), F.col("rule_tokens")).otherwise(F.array_append("rule_tokens", F.col("one"))))
    return rules.select(F.array_sort("rule_tokens").alias("rule_tokens"), "verdict", "support", "confidence")


def _proper_parts(tokens: Column, most: int) -> Column:
    """The non-empty proper sub-arrays (as sets) of at most ``most`` sorted tokens."""
    masks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.expr(f"shiftleft(1, {most})") - 2)),
        lambda m: F.filter(tokens, lambda _, i: F.call_function("getbit", m, i) == 1),
    )
    return F.filter(F.array_distinct(masks), lambda part: (F.size(part) > 0) & (F.size(part) < F.size(tokens)))


def match_rules(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of the ``patterns`` (distinct ``tokens``) on which a rule fires.

    The surest rule decides; then the one of more support, of more tokens, a
    block before an allow, and the last in the order of its tokens.
    """
    listed = patterns.select("tokens", F.explode("tokens").alias("rarest"))
    fired = listed.join(rules, "rarest").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("rule_tokens").alias("n"), F.col("verdict").alias("v"), "rule_tokens")
    return fired.groupBy("tokens").agg(F.max(rank)["v"].alias("mined"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[HostRule] = HOST_RULES,
    default: str = ALLOW,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(page, host, path, rule, verdict) per row of ``pages``.

    ``rule`` is null where no hand-written rule fits; then mined rules decide,
    and ``default`` where none fires. Null URLs and such without ``://`` have an
    empty host and path. Rows that repeat are judged alike; an empty table gives
    no rows; other columns are not read.
    """
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(url)
    rows = rows.select("page", "url", host.alias("host"), path.alias("path"))
    text, verdict = _first_rule(rules, F.col("host"), F.col("path"))
    tokens = url_tokens(url, F.col("host"), F.col("path"))
    judged = rows.select("page", "url", "host", "path", text.alias("rule"), verdict.alias("ruled"), tokens.alias("tokens"))
    labelled = (
        judged.filter(F.col("ruled").isNotNull())
        .orderBy(F.xxhash64("url", F.lit("mine")), "url")
        .limit(max_rows)
        .select("tokens", F.col("ruled").alias("verdict"))
    )
    mined = mine_rules(labelled)
    open_urls = judged.filter(F.col("ruled").isNull())
    patterns = open_urls.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    verdicts = checkpointed(patterns.join(match_rules(patterns, mined), "tokens", "left"))
    # A pattern may be that of very many URLs.
    found = join_hot(open_urls, verdicts, "tokens")
    return (
        judged.filter(F.col("ruled").isNotNull())
        .withColumn("mined", F.lit(None).cast("string"))
        .unionByName(found)
        .select("page", "host", "path", "rule", F.coalesce("ruled", "mined", F.lit(default)).alias("verdict"))
    )

"""URL filters by association rules (operator 10)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path) of the fixed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def upper_to_lower(c: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them; both empty for null or without `://`."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return upper_to_lower(host), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def rule_name(host: str, path: str) -> str:
    return f"{host}{path}"


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Verdict and name of the longest rule that fits, else null."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        verdict, name = F.when(fits, F.lit(v)).otherwise(verdict), F.when(fits, F.lit(rule_name(h, p))).otherwise(name)
    return verdict, name


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of an URL: `h:` words of the host, `p:` words of the path; digits count as one token `#`."""
    words = lambda c, tag: F.transform(
        F.filter(F.split(F.regexp_replace(F.lower(c), r"[0-9]+", "#"), r"[^\p{L}#]+"), lambda w: w != ""), lambda w: F.concat(F.lit(tag), w)
    )
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:")))


@dataclass(frozen=True)
class RuleParameters:
    """What a mined rule must reach."""

    #: Blocked pages that the rule fits, as a share of all labelled pages.
    min_support: float = 0.002
    #: A lower bound of the share of blocked pages among those that the rule fits.
    min_confidence: float = 0.5
    min_lift: float = 2.0
    #: Rows of evidence besides the share.
    min_rows: int = 5
    #: More mined rules than this are joined by shuffle instead of broadcast.
    broadcast_rules: int = 100_000


def companions(blocked: DataFrame, least: float) -> dict[str, str]:
    """Token to item, for tokens in at least `least` blocked rows: tokens that stand in the same labelled rows are one item, named after the first.

    So an URL that repeats, with however many tokens, is one item and not a
    set for each choice of them.  There are at most as many such tokens as a
    row has, divided by the share.
    """
    # Equal sets of tokens are one; which of these a token is in is told by two hashes and their number.
    kinds = blocked.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count_if("block").alias("hits"))
    mark = lambda seed: F.bit_xor(F.xxhash64("tokens", F.lit(seed)))
    each = kinds.select("tokens", "hits", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("hits").alias("hits"), F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    first: dict[tuple, str] = {}
    rows = sorted(each.where(F.col("hits") >= least).collect())
    return {r["token"]: first.setdefault((r["n"], r["a"], r["b"]), r["token"]) for r in rows}


def items(tokens: Column, item_of: dict[str, str]) -> Column:
    """The distinct items that tokens belong to; other tokens are in no rule."""
    if not item_of:
        return F.array().cast("array<string>")
    known = F.from_json(F.lit(json.dumps(item_of)), "map<string, string>")
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()))


def holding(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (with `items`) joined with the rules (with `antecedent`, `rarest`) that fit them, by inverted index: a row meets a rule under the rule's rarest item only, and the rest is checked there."""
    met = rows.withColumn("rarest", F.explode("items")).join(rules, "rarest")
    return met.where(F.size(F.array_except("antecedent", "items")) == 0)


def mine(labelled: DataFrame, scratch: Scratch, p: RuleParameters = RuleParameters()) -> tuple[DataFrame, dict[str, str]]:
    """Rules `items -> block` from rows (tokens array<string>, block boolean): (antecedent, confidence, lift, rarest), and which tokens are which item.

    Spark's FP-growth counts combinations in the blocked rows; how many rows
    a combination fits at all is then counted by inverted index.  A rule
    stays if support, rows, confidence and lift reach the parameters and no
    shorter rule with at least its confidence is contained in it.  `rarest`
    is its least frequent item, under which the index holds it.

    Combinations can be many where many items of one row are frequent in
    different company: FP-growth has no bound but the support.  No labelled
    rows, or none of one kind: no rule.
    """
    spark = labelled.sparkSession
    empty = spark.range(0).select(F.array().cast("array<string>").alias("antecedent"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("lift"), F.lit("").alias("rarest"))
    n, blocks = labelled.agg(F.count("*"), F.count_if("block")).first()
    if not n or not blocks:
        return empty, {}
    least = max(p.min_support * n, p.min_rows)
    item_of = companions(labelled, least)
    if not item_of:
        return empty, {}
    rows = scratch.save(labelled.select(items(F.col("tokens"), item_of).alias("items"), "block").where(F.size("items") > 0), "items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A little below, so that rounding loses no set; the exact limit follows.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / blocks), minConfidence=1.0, numPartitions=parts).fit(rows.where("block").select("items"))
    sets = scratch.save(model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("hits")), "itemsets")
    single = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
    each = sets.withColumn("item", F.explode("antecedent")).join(single, "item")
    rules = scratch.save(each.groupBy("antecedent", "hits").agg(F.min_by("item", F.struct("freq", "item")).alias("rarest")), "indexed")
    fits = holding(rows.select("items"), rules).groupBy("antecedent", "hits", "rarest").agg(F.count("*").alias("rows"))
    rules = fits.withColumn("confidence", F.col("hits") / F.col("rows")).withColumn("lift", F.col("confidence") * F.lit(n / blocks))
    # Few rows prove little: the lower bound of the confidence counts (Wilson's, one-sided 95 %).
    z, x, n_rows = 1.645, F.col("confidence"), F.col("rows")
    sure = (x + z * z / (2 * n_rows) - z * F.sqrt(x * (1 - x) / n_rows + z * z / (4 * n_rows * n_rows))) / (1 + z * z / n_rows)
    rules = scratch.save(rules.where((sure >= p.min_confidence) & (F.col("lift") >= p.min_lift)), "rules")
    # Redundant: a longer rule that is no surer than one inside it.  The inner rule's rarest item leads from one to the other.
    inner = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("inner_confidence"), F.col("rarest").alias("item"))
    longer = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(inner, "item")
    longer = longer.where((F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("inner_confidence") >= F.col("confidence")))
    return scratch.save(rules.join(longer.select("antecedent").distinct(), "antecedent", "left_anti").select(*empty.columns), "kept"), item_of


def judge(pages: DataFrame, labels: DataFrame, scratch: Scratch, rules=RULES, p: RuleParameters = RuleParameters()) -> DataFrame:
    """Verdict on every page: page_id, host, path, rule, verdict, confidence.

    A fixed rule decides where one fits (the longest wins).  Otherwise the
    page is blocked if a mined rule fits it, else allowed; `confidence` is
    then that of the surest mined rule that fits.  The labels of a page are
    those of the document with its id; bad quality or toxic means block.

    Null url or one without `://`: empty host and path, no rule, allow.
    Null ids and repeated rows are judged one by one.  No labels: nothing is
    mined.  Empty table: no rows.  Extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    verdict, name = fixed_rule(F.col("host"), F.col("path"), rules)
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.withColumns({"rule": name, "fixed": verdict, "tokens": tokens(F.col("host"), F.col("path"))})
    cut = scratch.save(cut, "cut")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    labelled = cut.join(marks, F.col("page_id") == F.col("doc_id")).where("block is not null").select("tokens", "block")
    mined, item_of = mine(scratch.save(labelled, "labelled"), scratch, p)
    if mined.count() <= p.broadcast_rules:
        mined = F.broadcast(mined)
    pages = cut.where("fixed is null").select("page_id", "host", "path", items(F.col("tokens"), item_of).alias("items"))
    fits = scratch.save(holding(pages, mined).groupBy("page_id", "host", "path").agg(F.max("confidence").alias("confidence")), "fits")
    key = [cut[c].eqNullSafe(fits[c]) for c in ("page_id", "host", "path")]
    return cut.join(fits, key, "left").select(
        cut["page_id"], cut["host"], cut["path"], "rule", F.coalesce("fixed", F.when(fits["confidence"].isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), fits["confidence"]).alias("confidence"),
    )

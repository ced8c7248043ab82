"""URL filters: rules by host suffix and path prefix, and a path-template tree for what no rule fits.

Every url that a rule judges is a labelled example. Per host, the segments of its path become a template from the root
down. A segment that is a number or a long token is variable by its form, and so is any segment of a place that has more
than `max_children` different ones: it becomes `*`. At every level the labelled sibling branches, by their share of blocked
urls, are gone through once, and each joins the branch before it unless a two-proportion test tells the two apart; joined
ones get one segment, `~` and a number, and from there on are one branch. A template is blocked if its purity, the labelled share of blocked urls, reaches the threshold. It is smoothed
towards what its host's labels and those of its shape on all hosts say together (their odds multiplied over the table's):
a template of few or no labels goes by them. Where neither host nor shape nor template has a label the verdict is `unknown`.

All of it is aggregation and joins on (host, template). Counts are summed before they are shuffled. In the joins a host
or a template may still hold a third of the rows: keys with over a thousandth of them, hence at most a thousand, meet by
broadcast, and the rest by shuffle. Every level of the tree is written to the shared folder, so no plan holds another twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import materialize

#: Keys with a larger share of the rows than one in HOT are broadcast, so at most HOT of them.
HOT = 1000

#: Labels that the table's share is smoothed by; a quarter of them blocked.
_FEW = 2.0

#: The rules (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without one."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host, then path; null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    choose = lambda value: reduce(lambda c, r: c.when(fits(r[0], r[1]), F.lit(value(r))), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return choose(lambda r: r[0] + r[1]), choose(lambda r: r[2])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Left join of left with right, which has one row per key and its number of left rows in `weight`, of `rows` in all.

    Rows of a hot key get their values by broadcast and go on under salted keys that match nothing, so no task gets them
    all. `weight` isn't returned.
    """
    values = [c for c in right.columns if c not in (*keys, "weight")]
    is_hot = F.col("weight") * HOT >= F.lit(max(rows, 1))
    hot = right.filter(is_hot).select(*keys, F.lit(True).alias("hot"), *[F.col(c).alias(f"hot_{c}") for c in values])
    cold = right.filter(~is_hot).select(*keys, F.lit(0).cast("long").alias("salt"), *values)
    salt = F.when(F.col("hot"), 1 + F.monotonically_increasing_id() % 65536).otherwise(F.lit(0).cast("long"))
    both = left.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).join(cold, [*keys, "salt"], "left")
    return both.select(*left.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in values])


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _merged(siblings: Column, z: float) -> Column:
    """Of a sorted array of siblings (share, s, n, b) a map from segment to the name that it shares with others."""
    first = F.struct(F.array().cast("array<struct<s:string,g:int>>").alias("seen"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("g"))

    def step(a: Column, x: Column) -> Column:
        pooled = (a["b"] + x["b"]) / (a["n"] + x["n"])
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), a["n"]) + F.try_divide(F.lit(1.0), x["n"])))
        alike = F.coalesce(F.abs(a["b"] / F.nullif(a["n"], F.lit(0)) - x["b"] / x["n"]) <= z * spread + 1e-12, F.lit(False))
        g = F.when(alike, a["g"]).otherwise(a["g"] + 1)
        count = lambda k: x[k] + F.when(alike, a[k]).otherwise(0)
        return F.struct(F.array_append(a["seen"], F.struct(x["s"].alias("s"), g.alias("g"))).alias("seen"), count("n").alias("n"), count("b").alias("b"), g.alias("g"))

    seen = F.aggregate(siblings, first, step)["seen"]
    several = F.filter(seen, lambda x: F.size(F.filter(seen, lambda y: y["g"] == x["g"])) > 1)
    return F.map_from_entries(F.transform(several, lambda x: F.struct(x["s"].alias("s"), F.concat(F.lit("~"), x["g"].cast("string")).alias("name"))))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, depth: int = 4, max_children: int = 50, alpha: float = 2.0, least: float = 0.5, z: float = 1.96, unknown: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of pages.

    Null urls and urls without :// have an empty host and path, hence no rule, and the verdict `unknown`; so have urls
    about which no label says anything. Ids may be null or repeat: rows are judged one by one. Further columns are not
    read. An empty table gives no rows.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # segments of the path: the first `depth`, what follows as one; numbers and long tokens are variable by their form
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    form = F.transform(F.slice(parts, 1, depth), lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$|^[0-9a-fA-F-]{16,}$") | (F.length(s) > 40) | s.rlike("^([*]+|~[0-9]*)$"), F.lit("*")).otherwise(s))
    shape = F.concat(form, F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"), F.array_join(shape, "/").alias("shape"))

    leaf = rows.groupBy("host", "shape").agg(F.count("given").alias("n"), F.count_if(F.col("given") == "block").alias("b"), F.count("*").alias("pages"))
    tree = materialize(leaf.withColumn("template", F.lit("")), "url-leaves")
    shapes, n_pages, labels, blocked = tree.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("pages", "n", "b")]).first()
    branch = ["host", "template"]
    for level in range(depth + 1):
        here = F.get(F.split("shape", "/"), F.lit(level))
        kids = tree.groupBy(*branch, here.alias("s")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("w"))
        kids = materialize(kids, f"url-branches-{level}")
        over = kids.groupBy(*branch).agg(F.count("s").alias("kids"), F.sum("w").alias("weight"))
        many = over.filter(F.col("kids") > max_children).select(*branch, "weight", F.lit(True).alias("many"), F.lit(None).cast("map<string,string>").alias("names"))
        # at most max_children siblings are gathered
        some = kids.filter("n > 0 and s is not null").join(over.filter(F.col("kids").between(2, max_children)), branch)
        some = some.groupBy(*branch, "weight").agg(F.array_sort(F.collect_list(F.struct((F.col("b") / F.col("n")).alias("share"), "s", "n", "b"))).alias("siblings"))
        some = some.select(*branch, "weight", F.lit(False).alias("many"), _merged(F.col("siblings"), z).alias("names")).filter(F.size("names") > 0)
        seg = F.when(F.col("many") & here.isNotNull(), F.lit("*")).otherwise(F.coalesce(F.try_element_at("names", here), here))
        grown = F.concat("template", F.coalesce(F.concat(F.lit("/"), seg), F.lit(""))).alias("template")
        tree = materialize(spread_join(tree, many.unionByName(some), branch, shapes).select("host", "shape", "n", "b", "pages", grown), f"url-level-{level}")

    def summed(keys: list[str], n: str, b: str) -> DataFrame:
        return tree.groupBy(*keys).agg(F.sum("n").alias(n), F.sum("b").alias(b), F.count("*").alias("weight"))

    leaves = tree.select("host", "shape", "template", "pages")
    for keys, n, b in ((branch, "n", "b"), (["host"], "hn", "hb"), (["shape"], "sn", "sb")):
        leaves = spread_join(leaves, summed(keys, n, b), keys, shapes)
    share = F.lit((blocked + _FEW / 4) / (labels + _FEW))
    of_host, of_shape = ((F.col(b) + alpha * share) / (F.col(n) + alpha) for n, b in (("hn", "hb"), ("sn", "sb")))
    odds = _odds(of_host) * _odds(of_shape) / _odds(share)
    purity = (F.col("b") + alpha * odds / (1 + odds)) / (F.col("n") + alpha)
    told = F.when((F.col("host") != "") & (F.col("hn") + F.col("sn") > 0), purity)
    by_shape = materialize(leaves.select("host", "shape", F.when(F.col("host") != "", F.col("template")).alias("template"), told.alias("purity"), F.col("pages").alias("weight")), "url-shapes")

    judged = spread_join(rows, by_shape, ["host", "shape"], n_pages)
    learnt = F.when(F.col("purity").isNull(), unknown).when(F.col("purity") >= least, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", learnt).alias("verdict"), "template", "purity")

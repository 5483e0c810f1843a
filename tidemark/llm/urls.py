"""URL filters: written host and path rules, then association rules mined by FP-growth.

Written rules are few and become one expression; the longest that fits decides.  Every other url is
judged by mined rules: FP-growth runs over the tokens of labelled urls plus a class token, and rules
``tokens -> class`` are pruned by support, by confidence against the class's share (its ``lift``, and by how
many standard errors it differs, so that a rare class can be blocked and chance makes no rule) and by
redundancy (a rule goes if a part of its tokens is as confident).  Matching goes through an inverted index
from each rule's rarest token, so a url meets only rules that share that token; the match of largest lift
decides, ties by support, then by the tokens in order.  Without a match a url is allowed.

Tokens that always occur together in the labelled urls (the fixed words of a template) are one item in the
mining, since FP-growth makes every subset of what occurs together.  No rule is lost by this: of rules that
differ in such tokens only, each says the same with the same confidence, and a url fits an item if it has any
token of it, which is what these rules say together.

Only DataFrame functions and Spark's own FP-growth run; the labelled rows that are mined are bounded
by ``fit_rows`` (in expectation, chosen by a hash of the id), everything else covers all rows.

Rows: a null url, or one without ``://``, has an empty host and path, no tokens and is allowed.
Labels with null ids or classes are not learned from; several labels of a page are each a
transaction.  Repeated rows are judged alike.  Without labels nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

#: (verdict, rule) of the contract (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FIT_ROWS = 200_000
MIN_ROWS = 10
#: What a rule's confidence must be, as a multiple of its class's share, and in standard errors beyond it.
MIN_LIFT, MIN_ERRORS = 1.2, 4.0
#: Below this FP-growth makes no rules.
MIN_CONFIDENCE = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: str) -> Column:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    own, _, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def written(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, own in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, verdict = F.when(fits(own, host, path), own).otherwise(rule), F.when(fits(own, host, path), what).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column, url: str) -> Column:
    """Different tokens: labels of the host (h:), words of the path (p:), names in the query (q:); no bare numbers."""
    def words(text: Column, mark: str) -> Column:
        parts = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}\-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
        return F.transform(parts, lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(F.array_join(names, " "), "q:")))


def together(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, item): tokens of the rows, and the least of the tokens that occur in exactly the same rows.

    Sums and parities of row hashes propose the groups; a group stays if its tokens then occur in each of its rows all."""
    each = rows.select(F.monotonically_increasing_id().alias("row_number"), F.col(tokens).alias("t")).select("row_number", F.explode("t").alias("token"))
    each = C.materialise(each, "tokens")
    one, two = F.xxhash64("row_number"), F.xxhash64("row_number", F.lit("two"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    size = Window.partitionBy("n", "x", "y")
    groups = C.materialise(marks.select("token", "n", F.min("token").over(size).alias("item"), F.count("*").over(size).alias("size")), "items")
    rows_of = each.join(groups.where("size > 1").select("token", "item", "size", "n"), "token").groupBy("item", "row_number", "size", "n").agg(F.count("*").alias("here"))
    whole = rows_of.where("here = size").groupBy("item", "n").agg(F.count("*").alias("rows")).where("rows = n").select("item", F.lit(True).alias("whole"))
    return groups.join(whole, "item", "left").select("token", F.when(F.col("whole"), F.col("item")).otherwise(F.col("token")).alias("item"))


def with_items(urls: DataFrame, items: DataFrame, row: str, tokens: str = "tokens") -> DataFrame:
    """(row, items) of the rows that have any token with an item."""
    return urls.select(row, F.explode(tokens).alias("token")).join(items, "token").groupBy(row).agg(F.collect_set("item").alias("items"))


def mine(pages: DataFrame, labels: DataFrame, page: str = "page_id", tokens: str = "tokens", key: str = "doc_id", fit_rows: int = FIT_ROWS, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_errors: float = MIN_ERRORS) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, blocks, support, confidence, lift), each token standing for its item, and (token, item).  A page
    labelled toxic or of quality 0 is to be blocked."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), False)
    own = labels.select(F.col(key).alias("label_key"), bad.alias("bad")).where("label_key IS NOT NULL AND bad IS NOT NULL")
    n = own.count()
    if n > fit_rows:
        own = own.where(F.pmod(F.xxhash64("label_key"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    rows = C.materialise(pages.join(own, pages[page] == own["label_key"]).select(F.col(tokens).alias("tokens"), "bad", F.monotonically_increasing_id().alias("number")), "labelled")
    n = rows.count()
    spark = pages.sparkSession
    items = C.materialise(together(rows), "item_of")
    if not n:
        return spark.createDataFrame([], "tokens array<string>, blocks boolean, support double, confidence double, lift double"), items
    mark = F.when(F.col("bad"), "=block").otherwise("=allow")
    rows = C.materialise(rows.join(with_items(rows, items, "number"), "number", "left").select(F.array_append(F.coalesce("items", F.expr("cast(array() as array<string>)")), mark).alias("items"), "bad"), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_rows / n, 0.0005)), minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.size("consequent") == 1).withColumn("class", F.col("consequent")[0]).where(F.col("class").isin("=block", "=allow"))
    share = {r["bad"]: r["count"] / n for r in rows.groupBy("bad").count().collect()}
    base = F.when(F.col("class") == "=block", share.get(True, 0.0)).otherwise(share.get(False, 0.0))
    error = F.sqrt(base * (1 - base) / (F.col("support") * n / F.col("confidence")))  # of the share among so many rows
    found = rules.where((F.col("confidence") >= base * min_lift) & (F.col("confidence") - base >= error * min_errors)).select(
        F.array_sort("antecedent").alias("tokens"), (F.col("class") == "=block").alias("blocks"), "support", "confidence", (F.col("confidence") / base).alias("lift"),
    ).where(F.size("tokens") > 0)
    found = C.materialise(found, "rules")
    # redundant: a proper part of the tokens says the same with no less confidence.  Parts that lack one
    # token are enough to look at: FP-growth finds every part of a frequent set.
    parts = found.select("blocks", F.col("confidence").alias("part_confidence"), F.col("tokens").alias("part"))
    lacking = found.where(F.size("tokens") > 1).select("tokens", "blocks", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("part"))
    redundant = lacking.join(parts, ["part", "blocks"]).where("part_confidence >= confidence").select("tokens", "blocks").distinct()
    return found.join(redundant, ["tokens", "blocks"], "left_anti"), items


def matched(urls: DataFrame, rules: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, blocks, confidence, support, lift, rule_tokens): the best rule of each url, given as items, that any rule fits."""
    each = rules.withColumn("n", F.size("tokens")).select("*", F.explode("tokens").alias("token"))
    weight = each.groupBy("token").agg(F.max("support").alias("weight"))  # the more a token's rules hold, the commoner it is
    lead = each.join(weight, "token").groupBy("tokens", "blocks", "support", "confidence", "lift").agg(F.min_by("token", F.struct("weight", "token")).alias("token"))
    index = lead.select("token", F.col("tokens").alias("rule_tokens"), "blocks", "support", "confidence", "lift")
    seen = urls.select(key, tokens, F.explode(tokens).alias("token"))
    hits = seen.join(index, "token").where(F.size(F.array_except("rule_tokens", tokens)) == 0)
    order = F.struct("lift", "support", (-F.size("rule_tokens")).alias("fewer"), F.array_join("rule_tokens", " ").alias("name"))
    return hits.groupBy(key).agg(F.max_by(F.struct("blocks", "confidence", "support", "lift", "rule_tokens"), order).alias("best")).select(key, "best.*")


def judge(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page, host, path, rule, verdict, confidence, support, lift, rule_tokens) for each row of ``pages``."""
    host, path = host_of(url), path_of(url)
    table = C.materialise(pages.select(F.col(page), host.alias("host"), path.alias("path"), tokens_of(host, path, url).alias("tokens"), F.monotonically_increasing_id().alias("row_number")), "urls")
    mined, items = mine(table, labels, page)
    mined = C.materialise(mined, "mined")
    rule, verdict = written(rules, F.col("host"), F.col("path"))
    ruled = table.withColumns({"rule": rule, "written": verdict})
    used = items.join(mined.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")
    best = matched(with_items(ruled.where("written IS NULL"), used, "row_number"), mined, "row_number", "items")
    learned = F.when(F.col("blocks"), "block").otherwise("allow")
    return ruled.join(best, "row_number", "left").select(page, "host", "path", "rule", F.coalesce("written", learned).alias("verdict"), "confidence", "support", "lift", "rule_tokens")


def op8_association_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = judge(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("rule_tokens", " ").alias("rule_tokens"), "confidence", "support", "lift")

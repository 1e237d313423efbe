"""URL filter: rules of hosts and paths first, else the ratio of two character language models.

URLs that a rule allows are the accepted ones, URLs that a rule blocks the rejected ones. For each
side a variable-order Markov model of characters is counted over all different URLs of that side
(``HELD`` sixteenths of them are kept back): the chance of a character is that of the longest context seen ``LEAST``
times, smoothed with the next shorter one by the number of different followers (Witten-Bell),
down to a uniform start. A URL's score is the difference of both log-likelihoods over its length. The limit
is calibrated on the URLs kept back: the score, in steps of 0.01, with the best mean of accepted URLs
allowed and rejected ones blocked; the step nearest to 0 of equal ones.

Everything is joins and sums of grams (a character with its context). The highest order is counted
in the URLs; each lower order is a sum of the one above. A gram joins the gram without its first
character, so a key has at most as many rows as there are characters. The last join, of grams in
URLs, meets hot grams in a broadcast table: those with over 1/4096 of all occurrences are fewer than 4096.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; its
characters are judged all the same; a url without characters scores 0. Without accepted or rejected
URLs every score is 0 and the limit 0, which allows. Repeated URLs and ids are judged alike, repeats do
not count in the models; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewell.llm.tables import settle, with_hot

ORDER = 5  # characters of the longest context
LEAST = 2  # times that a context must have been seen
CHARACTERS = 256  # of the uniform start
HELD = 3  # sixteenths of the labelled URLs, by the first digit of a digest, are for the limit
UNIT = 1 << 20  # of a log-likelihood: sums of integers do not depend on their order
START, END = "\x02", "\x03"
SIDES = ("allow", "block")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, and what it says; null where none does. ``rules`` are (verdict, rule)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """``gram`` (a character behind its context) of every character of ``url`` and of its end."""
    padded = F.concat(F.lit(START * order), "url", F.lit(END))
    places = F.sequence(F.lit(1), F.length("url") + 1)
    return urls.select(*keep, F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))).alias("gram"))


def ratios(counts: DataFrame, order: int) -> DataFrame:
    """``gram`` and ``ratio``, the difference of its two log-likelihoods in ``UNIT``, from ``gram``, ``n_allow`` and ``n_block``."""
    levels = [counts]
    for _ in range(order):
        levels.append(settle(levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in SIDES]), "grams"))
    chances = None
    for k, level in zip(range(order + 1), reversed(levels), strict=True):
        if k == 0:  # no context: one row of sums
            whole = level.agg(*[F.sum(f"n_{s}") for s in SIDES], *[F.count(F.when(F.col(f"n_{s}") > 0, 1)) for s in SIDES]).first()
            of = {s: (F.lit(whole[i] or 0), F.lit(whole[i + 2] or 0)) for i, s in enumerate(SIDES)}
            rows = level.withColumns({f"p_{s}": F.lit(1.0 / CHARACTERS) for s in SIDES})
        else:
            context = Window.partitionBy(F.col("gram").substr(F.lit(1), F.lit(k)))  # a row per character at most
            of = {s: (F.sum(f"n_{s}").over(context), F.count(F.when(F.col(f"n_{s}") > 0, 1)).over(context)) for s in SIDES}
            lower = chances.select(F.col("gram").alias("shorter"), *[f"p_{s}" for s in SIDES])
            rows = level.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower, "shorter").drop("shorter")
        totals = rows.withColumns({f"{what}_{s}": column for s in SIDES for what, column in zip(("all", "kinds"), of[s], strict=True)})
        mixed = {f"p_{s}": F.when(F.col(f"all_{s}") >= LEAST, F.expr(f"(n_{s} + kinds_{s} * p_{s}) / (all_{s} + kinds_{s})")).otherwise(F.col(f"p_{s}")) for s in SIDES}
        chances = totals.withColumns(mixed).select("gram", *[f"n_{s}" for s in SIDES], *[f"p_{s}" for s in SIDES])
    return chances.select("gram", F.round((F.ln("p_allow") - F.ln("p_block")) * UNIT).cast("long").alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], order: int = ORDER) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and, where no rule fits, ``score`` (per character) and ``limit`` of every page."""
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "key": F.sha2("url", 256)})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = settle(rows.withColumns({"rule": rule, "said": verdict}), "urls")
    urls = settle(rows.where("url IS NOT NULL").groupBy("key").agg(F.min("url").alias("url"), F.min("said").alias("said"), F.count(F.lit(1)).alias("times")), "different-urls")
    kept_back = F.col("said").isNotNull() & (F.md5(F.col("url").cast("binary")).substr(1, 1).isin([f"{d:x}" for d in range(HELD)]))
    counted = grams(urls.where(F.col("said").isNotNull() & ~kept_back), order, "said")
    judged = settle(grams(urls.where(F.col("said").isNull() | kept_back), order, "key"), "occurrences")
    times = settle(judged.groupBy("gram").agg(F.count(F.lit(1)).alias("times")), "gram-times")
    sides = [F.count(F.when(F.col("said") == s, 1)).alias(f"n_{s}") for s in SIDES]
    none = [F.lit(0).cast("long").alias(f"n_{s}") for s in SIDES]
    both = counted.groupBy("gram").agg(*sides).unionByName(times.select("gram", *none))
    counts = settle(both.groupBy("gram").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in SIDES]), "gram-counts")
    of_gram = settle(ratios(counts, order), "gram-ratios")
    if urls.where("said IS NOT NULL").select("said").distinct().count() < len(SIDES):
        of_gram = of_gram.withColumn("ratio", F.lit(0).cast("long"))
    sums = with_hot(judged, of_gram, times, "gram").groupBy("key").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    scores = settle(sums.select("key", F.expr(f"CASE WHEN n > 1 THEN sum / n / {UNIT} ELSE 0D END").alias("score")), "url-scores")
    limit = calibrated(urls.where(kept_back).join(scores, "key"))
    of_row = with_hot(rows.where("said IS NULL AND url IS NOT NULL"), scores, urls.select("key", "times"), "key")
    columns = ["page_id", "host", "path", "rule"]
    undecided = of_row.select(*columns, F.when(F.col("score") >= limit, SIDES[0]).otherwise(SIDES[1]).alias("verdict"), "score", F.lit(limit).alias("limit"))
    nothing = rows.where("url IS NULL").select(*columns, F.lit(SIDES[0] if limit <= 0 else SIDES[1]).alias("verdict"), F.lit(0.0).alias("score"), F.lit(limit).alias("limit"))
    decided = rows.where("said IS NOT NULL").select(*columns, F.col("said").alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("limit"))
    return decided.unionByName(undecided).unionByName(nothing)


def calibrated(scored: DataFrame) -> float:
    """The limit from ``said`` and ``score`` of the URLs kept back; scores are counted in steps within -20 and 20."""
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(20.0)), F.lit(-20.0)) * 100).cast("int").alias("step")
    steps = scored.groupBy(step).agg(*[F.count(F.when(F.col("said") == s, 1)).alias(s) for s in SIDES]).collect()  # 4,001 rows at most
    total = [sum(r[s] for r in steps) for s in SIDES]
    if not all(total):
        return 0.0
    best = None
    for limit in {0, *(r["step"] for r in steps), *(r["step"] + 1 for r in steps)}:
        right = sum(r["allow"] for r in steps if r["step"] >= limit) * total[1] + sum(r["block"] for r in steps if r["step"] < limit) * total[0]
        best = min(best or (1, 0, 0), (-right, abs(limit), limit))
    return best[2] / 100

"""URL filter: host and path rules, then a character language-model ratio.

Native: DataFrame expressions only.

Two variable-order Markov models of characters, one of accepted and one of rejected
URLs, are smoothed by Witten-Bell: a character's chance in the longest context seen
blends its count there with its chance in the context one character shorter, down to
the uniform chance.  A context is one of up to ``ORDER`` characters; contexts of one
character more than another belong to the model if seen ``LEAST_SEEN`` times, however many
they are, so the tree is deep where URLs repeat and shallow elsewhere.  A URL's score is
the difference of its log-likelihoods divided by its length; it is rejected below a threshold.

URLs that rules decide are parted by crc32: even ones train the models, odd ones, which
the models have not seen, calibrate the threshold.  Counts cover all of them.  One count of
the windows of ``ORDER + 1`` characters of all URLs, with map-side combine, gives those of the
training and those to be scored; contexts are met by the different windows alone, in joins
that shuffle where tables are large.  The ratios of the ``HOT`` most frequent windows are
broadcast and added where the URLs are read; places of rarer windows are shuffled to their ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SMALL_ROWS, ascii_lower, stored

#: Characters that are symbols of their own; all others share OTHER.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_:?=&%#+@"
#: START pads the front of every URL.
OTHER, START = "~", "^"
CODES = ALPHABET + OTHER + START
SYMBOLS = len(CODES)
#: Characters of the longest context, and how often a context must be seen to belong to the model.
ORDER, LEAST_SEEN = 5, 2
#: Windows whose ratios are broadcast; those of all others are joined by a shuffle.
HOT = SMALL_ROWS
#: Contexts and substrings of so many characters are few (``SYMBOLS`` to that power) and often met, so they are broadcast.
SHORT = 2
#: Ratios are added in whole steps of 1 / EXACT nats, so that sums do not depend on the order.
EXACT = 1 << 32
#: Rules become one CASE expression, so their number is limited.
MAX_RULES = 1000
#: Scores are calibrated in steps of 1 / STEPS nats a character, within SPAN nats.
STEPS, SPAN = 200, 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule is written ``host/path``.  It fits its host and all subdomains if the
    path starts with its path.  Of equally long rules the earlier one wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    chosen = F.lit(None).cast(kind)
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _padded(url: Column) -> Column:
    """ORDER padding characters and the URL in the models' symbols, one ASCII character each."""
    known = F.regexp_replace(ascii_lower(url), f"[^{ALPHABET.replace('-', '')}-]", OTHER)
    return F.concat(F.lit(START * ORDER), known)


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    """For each character of ``__padded`` a row with ``__gram``, its context of ORDER characters and itself."""
    grams = F.transform(F.sequence(F.lit(1), F.length("__padded") - ORDER), lambda i: F.substr("__padded", i, F.lit(ORDER + 1)))
    return df.filter(F.length("__padded") > ORDER).select(*keep, F.explode(grams).alias("__gram"))


def windows(urls: DataFrame) -> DataFrame:
    """(__gram, n, a, r) of the different windows of (__padded, __accepted, __half) rows: how many, in accepted and in rejected training URLs."""
    # stored URLs are few bytes for the work they make, so a scan alone would give it to a few tasks
    df = _positions(_dealt(urls), "__accepted", "__half")
    training = F.col("__half") == 0
    return stored(df.groupBy("__gram").agg(F.count("*").alias("n"), F.count_if(training & F.col("__accepted")).alias("a"), F.count_if(training & ~F.col("__accepted")).alias("r")), "url-windows")


def _dealt(urls: DataFrame) -> DataFrame:
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trained(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, grams) of windows' counts (__gram, a, r).

    contexts: context, as, rs (characters seen after it in accepted and rejected URLs), at, rt
    (different ones); the empty context is one of them.  grams: gram, a, r of the characters seen after
    a context.
    """
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda n: F.substr("__gram", F.lit(ORDER + 2) - n, n))
    grams = seen.filter("a + r > 0").select(F.explode(ends).alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = stored(grams, "url-grams")
    contexts = grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
        F.sum("a").alias("as"), F.sum("r").alias("rs"), F.count_if(F.col("a") > 0).alias("at"), F.count_if(F.col("r") > 0).alias("rt")
    )
    return stored(contexts.filter((F.length("context") == 0) | (F.col("as") + F.col("rs") >= LEAST_SEEN)), "url-contexts"), grams


def ratios(seen: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(__gram, n, __ratio) of all windows: the log ratio of the last character's chances, in steps of 1 / EXACT."""
    contexts, grams = model
    df = seen.select("__gram", "n")
    chances = {c: F.lit(1.0 / SYMBOLS) for c in "ar"}
    for n in range(ORDER + 1):
        context, gram = F.substr("__gram", F.lit(ORDER - n + 1), F.lit(n)), F.substr("__gram", F.lit(ORDER - n + 1), F.lit(n + 1))
        known = contexts.filter(F.length("context") == n).select(F.col("context").alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("as", "rs", "at", "rt")])
        df = df.join(F.broadcast(known) if n <= SHORT else known, context == F.col("__key"), "left").drop("__key")
        known = grams.filter(F.length("gram") == n + 1).select(F.col("gram").alias("__key"), F.col("a").alias("__a"), F.col("r").alias("__r"))
        df = df.join(F.broadcast(known) if n + 1 <= SHORT else known, gram == F.col("__key"), "left").drop("__key")
        for c in "ar":
            met, kinds = F.col(f"__{c}s"), F.col(f"__{c}t")
            blend = (F.coalesce(f"__{c}", F.lit(0)) + kinds * chances[c]) / (met + kinds)
            chances[c] = F.when(met > 0, blend).otherwise(chances[c])
        df = df.select("__gram", "n", *[chances[c].alias(f"__p{c}") for c in "ar"])
        chances = {c: F.col(f"__p{c}") for c in "ar"}
    return stored(df.select("__gram", "n", F.round((F.log("__pa") - F.log("__pr")) * EXACT).cast("long").alias("__ratio")), "url-ratios")


def scored(urls: DataFrame, seen: DataFrame, model: tuple[DataFrame, DataFrame], hot: int = HOT) -> DataFrame:
    """(__url, __accepted, __half, __score) of numbered URLs: the mean log ratio of each one's characters; URLs without a character have no row.

    ``seen`` holds the windows of these URLs.
    """
    found = ratios(seen, model)
    often = stored(found.orderBy(F.desc("n"), "__gram").limit(hot), "url-hot").select("__gram", "__ratio")
    met = _positions(_dealt(urls), "__number").join(F.broadcast(often), "__gram", "left")
    sums = met.filter("__ratio is not null").groupBy("__number").agg(F.sum("__ratio").alias("__sum"))
    if found.count() > hot:
        rest = met.filter("__ratio is null").drop("__ratio").join(found.select("__gram", "__ratio"), "__gram")
        sums = sums.unionByName(rest.groupBy("__number").agg(F.sum("__ratio").alias("__sum"))).groupBy("__number").agg(F.sum("__sum").alias("__sum"))
    score = F.col("__sum") / F.lit(float(EXACT)) / (F.length("__padded") - ORDER)
    return stored(urls.join(sums, "__number").select("__url", "__accepted", "__half", score.alias("__score")), "url-scores")


def calibrated(judged: DataFrame) -> float:
    """The score that parts accepted and rejected best (mean of both recalls).

    It lies halfway between the two scores that it parts.

    Counted over all labelled rows in ``2 * STEPS * SPAN + 1`` bins at most.
    """
    bins = (
        judged.filter("__accepted is not null")
        .groupBy(F.greatest(F.lit(-SPAN * STEPS), F.least(F.lit(SPAN * STEPS), F.floor(F.col("__score") * STEPS).cast("int"))).alias("bin"))
        .agg(F.count_if("__accepted").alias("a"), F.count_if(~F.col("__accepted")).alias("r"))
    )
    best = (
        bins.selectExpr("bin", "(bin + coalesce(lag(bin) over (order by bin), bin)) / 2 middle", "sum(a) over (order by bin desc) / sum(a) over (partition by 0) a", "(sum(r) over (order by bin) - r) / sum(r) over (partition by 0) r")
        .filter("a is not null and r is not null")
        .orderBy(F.desc(F.col("a") + F.col("r")), "bin")
        .limit(1)
        .collect()
    )
    return best[0]["middle"] / STEPS if best else 0.0


def recalls(judged: DataFrame, least: float) -> DataFrame:
    """One row: rows and recall of accepted and of rejected (__accepted, __score) rows at a threshold."""
    yes = F.col("__accepted")
    right = lambda kind, held: F.count_if(kind & held) / F.count_if(kind)
    return judged.filter("__accepted is not null").agg(
        F.count_if(yes).alias("n_accepted"), right(yes, F.col("__score") >= least).alias("accepted"),
        F.count_if(~yes).alias("n_rejected"), right(~yes, F.col("__score") < least).alias("rejected"),
    )


def fitted(urls: DataFrame, hot: int = HOT) -> tuple[DataFrame | None, float, DataFrame | None]:
    """(scores (__url, __score), threshold, calibration rows (__accepted, __score)) of what ``prepared`` gives.

    Scores are None unless both kinds train the models; the threshold is 0 unless both kinds calibrate it.
    """
    if urls.filter("__accepted is not null and __half = 0").select("__accepted").distinct().count() < 2:
        return None, 0.0, None
    seen = windows(urls)
    scores = scored(urls, seen, trained(seen), hot)
    held = scores.filter("__accepted is not null and __half = 1")
    return scores.select("__url", "__score"), calibrated(held), held


def prepared(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> tuple[DataFrame, DataFrame]:
    """The pages with __url, host, path and __rule, and their distinct non-null URLs, stored, with __padded, __accepted, __half and __number."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    df = pages.select(*keep, F.col(f"`{url}`").cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    df = df.withColumn("host", host).withColumn("path", path)
    df = df.withColumn("__rule", rule_column(F.col("host"), F.col("path"), rules))
    distinct = df.filter("__url is not null").select("__url", (F.col("__rule.verdict") == "allow").alias("__accepted")).distinct()
    distinct = distinct.withColumn("__padded", _padded(F.col("__url"))).withColumn("__half", F.crc32(F.col("__url").cast("binary")) % 2)
    return df, stored(distinct.withColumn("__number", F.monotonically_increasing_id()), "urls")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", hot: int = HOT) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and are judged by score (null and empty: 0).  Without rejected or accepted
    examples to train on every score is 0; without both to calibrate on the threshold
    is 0, and scores of the threshold are allowed.  Repeated rows stay, each judged
    alike; columns named like the new ones are replaced.  ``hot`` windows are joined
    by broadcast, which changes no result.
    """
    df, distinct = prepared(pages, rules, url)
    scores, least, _ = fitted(distinct, hot)
    if scores is None:
        scores = df.sparkSession.createDataFrame([], "__url string, __score double")
    # null urls have no score, so they need not meet in the join
    some = df.filter("__url is not null").join(scores, "__url", "left")
    out = some.unionByName(df.filter("__url is null").withColumn("__score", F.lit(None).cast("double"))).withColumn("score", F.coalesce("__score", F.lit(0.0)))
    judged = F.when(F.col("score") >= least, "allow").otherwise("block")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    return out.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", judged).alias("verdict"), "score")

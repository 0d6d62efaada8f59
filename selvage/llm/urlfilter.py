"""URL filter: list rules first, then the ratio of two character language models.

One model is trained on accepted URLs, one on rejected ones: Markov models of
variable order, in which every context that was seen, up to ``ORDER``
characters, passes the rest of its probability on to the next shorter one
(Witten-Bell smoothing).  A URL is rejected if the difference of its two
log-likelihoods, by character, exceeds a calibrated threshold.  Examples of
rejected URLs are known, those of accepted ones may hide bad ones, so a URL is
judged without what the accepted model learnt from its own quarter of the hosts.

All counts cover every distinct URL text, by Spark aggregates; nothing but the
threshold reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Longest context of the models, in characters.
ORDER = 5
#: Base probability of any character: one in so many.
ALPHABET = 256
#: Most accepted texts that the calibrated threshold may reject.
FALSE_REJECTS = 0.01
#: Hosts are dealt into so many folds; the accepted model of a fold leaves its hosts out.
FOLDS = 4
#: A key that holds at least this share of the rows is joined by broadcast; there are at most ``1 / FREQUENT`` of them.
FREQUENT = 1e-4
#: Words that, as a whole part of a host name, make a URL an example of a rejected one.
REJECT_WORDS = [
    "ad", "ads", "adult", "affiliate", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "clickbait", "dating", "escort", "gambling", "jackpot", "loan", "loans", "lottery",
    "payday", "pharmacy", "phishing", "pill", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def host(url: str = "url") -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null.

    A rule is a host and a path prefix that begins at the first slash, as in
    ``example.net/en/``; it fits the host itself and its subdomains.  Rules are
    a short list (they become part of the expression); of rules of one length
    the first in alphabetical order wins.
    """
    if not rules:
        return F.lit(None).cast("struct<rule string, verdict string>")
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        on_host = (F.col(host) == name) | F.col(host).endswith("." + name)
        fits.append(F.when(on_host & F.col(path).startswith("/" + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def seeded(words: list[str] = REJECT_WORDS, host: str = "host") -> Column:
    """True if a part of the host name is one of the words."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))


def fold(host: str = "host") -> Column:
    """One of ``FOLDS`` numbers by the hash of the host."""
    return F.conv(F.substring(F.sha2(host, 256), 1, 4), 16, 10).cast("int") % FOLDS


def _windows() -> Column:
    """All stretches of ``ORDER`` characters and the next one in ``text``, with marks before its start and at its end."""
    marked = F.concat(F.lit(_START * ORDER), "text", F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.char_length("text") + 1), lambda i: F.substring(marked, i, ORDER + 1))


def join_by_frequency(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``counted(key, n, ...)``, where ``n`` says how many of all ``total`` rows hold the key.

    Frequent keys, of which there are at most ``1 / FREQUENT``, are joined by
    broadcast and never shuffled; any other key is too rare to fill a task.
    """
    often = F.broadcast(counted.where(F.col("n") >= max(FREQUENT * total, 1)))
    rare = counted.where(F.col("n") < max(FREQUENT * total, 1))
    return rows.join(often, key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key))


def texts_of(pages: DataFrame) -> DataFrame:
    """``text, n, fold, rejected``: every distinct host with path once, digits as zeros, and how many rows hold it.

    ``pages`` has host, path and ``rejected`` (null: neither example).  A text
    with examples of both kinds counts as rejected.
    """
    return pages.groupBy(judged_text().alias("text")).agg(
        F.count("*").alias("n"), F.max(fold()).alias("fold"), F.max("rejected").alias("rejected"))


def judged_text() -> Column:
    """What the models read: host and path in lower case, every digit as a zero, so that numbers of pages don't count."""
    return F.regexp_replace(F.concat("host", F.translate("path", _UPPER, _LOWER)), "[0-9]", "0")


def weights(texts: DataFrame) -> DataFrame:
    """``w, fold, n, weight``: for every window of a fold's texts its number and ``log P(rejected) - log P(accepted)`` of its last character, in 1e-9.

    Whole numbers make sums independent of their order.
    """
    windows = materialize(texts.select("fold", F.explode(_windows()).alias("w"), F.col("rejected").alias("r"), (~F.col("rejected")).alias("a"))
                          .groupBy("w", "fold").agg(F.count("*").alias("n"), F.count_if("r").alias("r"), F.count_if("a").alias("a")), "url-windows")
    levels = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")

    def gram(k: Column) -> Column:
        return F.col("w").substr(ORDER + 1 - k, k + 1)

    # a: for each fold, what the other folds hold
    others = [F.sum(F.when(F.col("fold") != f, F.col("a")).otherwise(0)) for f in range(FOLDS)]
    grams = windows.select("w", "fold", "r", "a", levels).groupBy(gram(F.col("k")).alias("gram")).agg(F.sum("r").alias("r"), F.array(*others).alias("a"))
    grams = grams.withColumn("context", F.col("gram").substr(F.lit(1), F.char_length("gram") - 1))
    contexts = grams.groupBy("context").agg(
        F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr"),
        F.array(*[F.sum(F.col("a")[f]) for f in range(FOLDS)]).alias("na"), F.array(*[F.count_if(F.col("a")[f] > 0) for f in range(FOLDS)]).alias("ta"))
    grams = grams.join(contexts, "context").drop("context")
    found = windows.select("w", "fold", "n", levels).withColumn("gram", gram(F.col("k"))).join(grams, "gram")
    level = F.struct("k", "r", "nr", "tr", *[F.col(c)[F.col("fold")].alias(c) for c in ("a", "na", "ta")])
    by_window = found.groupBy("w", "fold").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(level)).alias("levels"))

    def log_probability(c: str) -> Column:
        return F.log(F.aggregate("levels", F.lit(1.0 / ALPHABET), lambda p, x: F.when(x[f"n{c}"] == 0, p).otherwise((x[c] + x[f"t{c}"] * p) / (x[f"n{c}"] + x[f"t{c}"]))))

    return by_window.select("w", "fold", "n", F.round((log_probability("r") - log_probability("a")) * 1e9).cast("long").alias("weight"))


def scores(texts: DataFrame) -> DataFrame:
    """``texts`` with ``score``: the difference of log-likelihoods by character; positive: rejected likelier."""
    known = materialize(weights(texts).withColumn("key", F.concat("w", F.col("fold"))).drop("w", "fold"), "url-weights")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = texts.select("text", "fold", F.explode(_windows()).alias("w")).select("text", F.concat("w", F.col("fold")).alias("key"))
    added = join_by_frequency(rows, known, "key", total).groupBy("text").agg(F.sum("weight").alias("weight"))
    return texts.join(added, "text").withColumn("score", F.col("weight") / 1e9 / (F.char_length("text") + 1)).drop("weight")


def calibrate(scored: DataFrame) -> float:
    """Smallest threshold of at least 0, in hundredths, above which at most ``FALSE_REJECTS`` of the accepted texts lie; 0 without such texts."""
    bins = scored.where("NOT rejected AND score > 0").groupBy(F.ceil(F.col("score") * 100).alias("bin")).count()
    allowed = FALSE_REJECTS * scored.where("NOT rejected").count()
    above = 0
    for r in bins.orderBy(F.desc("bin")).toLocalIterator():  # a few hundred bins, as a character's weight is bounded
        above += r["count"]
        if above > allowed:
            return r["bin"] / 100
    return 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str]], rejected: Column | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``.

    ``rejected`` says which rows are examples of rejected URLs, false of
    accepted ones (null: neither); as it stands, hosts with one of
    ``REJECT_WORDS`` are rejected and all others accepted.  Rules aren't
    examples: they decide by domain, and would teach the models domains.

    Null URLs and such without ``://`` have an empty host and path, which is
    one text among others; long ones are read whole; repeated rows are judged
    alike.  Where nothing is rejected the models reject nothing.  Columns of
    the input stay, but for those named like the new ones, which are replaced.
    An empty table stays empty.
    """
    rows = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host(), "path": path()})
    example = rows.select("host", "path", (seeded() if rejected is None else rejected).alias("rejected"))
    scored = materialize(scores(materialize(texts_of(example), "url-texts")), "url-scores")
    threshold = calibrate(scored)
    total = scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_by_frequency(rows.withColumn("_text", judged_text()), scored.select(F.col("text").alias("_text"), "n", "score"), "_text", total)
    ruled = joined.withColumn("_fit", fitting_rule(rules))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return ruled.select(*[rows[c] for c in rows.columns], F.col("_fit.rule").alias("rule"), verdict.alias("verdict"), "score")

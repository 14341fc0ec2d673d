"""URL filtering: rules first, then logistic regression on hashed character n-grams of host and path.

The regression learns from a small labelled table: any that is passed in, or the one below, which tells unwanted sites from ordinary
ones. What the rules say of a URL is no label: they know places, not what a site is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict); a rule holds for its host and all subdomains, and for paths that start with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: A labelled table, written by hand: hosts and paths as gambling, pill, adult, spam and tracking sites bear them, and as other sites do.
BLOCKED = """
casinoroyale.test/bonus onlinecasino.test/slots casino-vip.test/play mega-casino.test/jackpot lucky-casino-club.test/spin casinos24.test/en best-casino-games.test/free-spins
sport-bets.test/odds betsafe.test/live quickbets.test/today bets-online.test/tips mybets.test/football freebets24.test/sign-up bet-winner.test/promo pokerroom.test/tables poker-win.test/cash
pills-store.test/buy buy-pills.test/order cheappills.test/discount dietpills.test/shop pharmacy-pills.test/viagra viagra-cheap.test/buy meds-no-prescription.test/order cheap-meds.test/sale
spamblast.test/list spam-links.test/page linkfarm.test/seo link-farm.test/links seo-farm.test/backlinks bulk-spam.test/mail get-rich-quick.test/now free-money.test/win winner-prize.test/claim
adserver.test/click ads-network.test/banner adsnet.test/pop popup-ads.test/go trackpixel.test/t.gif ad-track.test/pixel clicktracker.test/redirect tracking-ads.test/c adstracker.test/imp
adultcams.test/live adult-videos.test/free xxx-tube.test/video sexchat.test/girls hot-adult.test/pics porntube.test/watch payday-loans.test/apply fastloans.test/cash replica-watches.test/buy
"""
ORDINARY = """
citylibrary.test/catalogue university.test/research schoolnews.test/2024 museum.test/exhibitions townhall.test/services gardening.test/roses cooking.test/recipes/soup hospital.test/departments
weather.test/forecast railways.test/timetable history.test/articles/rome physics.test/lectures mathematics.test/notes opensource.test/docs/install software.test/download/release forum.test/thread/31
newspaper.test/politics magazine.test/culture blog.test/2023/05/travel photography.test/gallery music.test/albums orchestra.test/concerts theatre.test/programme film.test/reviews
bakery.test/bread furniture.test/tables bookshop.test/novels bicycles.test/repair hiking.test/trails mountains.test/huts rivers.test/map birds.test/species
law.test/statutes parliament.test/debates statistics.test/tables economy.test/reports bank.test/accounts insurance.test/contact energy.test/solar water.test/quality
language.test/grammar dictionary.test/word translation.test/es poetry.test/collection philosophy.test/essays chemistry.test/elements biology.test/cells medicine.test/journal
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    url, parts = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams, marked h for the host and p for the path, edges as ^ and $."""

    def of(text: Column, mark: str) -> Column:
        def cut(chars: Column, n: int) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, F.lit(n)), "")))

        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")  # once, so that long URLs cost no square of their length
        return F.transform(F.array(chars), lambda c: F.concat(*(cut(c, n) for n in sizes)))[0]

    return F.concat(of(host, "h"), of(path, "p"))


def _features(urls: DataFrame, buckets: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    terms = urls.withColumn("host", host).withColumn("path", path).withColumn("terms", grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=buckets, binary=True).transform(terms).drop("terms")


def _decided(rules) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) by the columns host and path; the longest that fits wins, null if none does."""

    def fits(rule: tuple[str, str, str]) -> Column:
        host, path, _ = rule
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    def first(value) -> Column:
        return reduce(lambda rest, r: F.when(fits(r), F.lit(value(r))).otherwise(rest), reversed(longest), F.lit(None).cast("string"))

    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return first(lambda r: r[0] + r[1]), first(lambda r: r[2])


def _spellings(entry: str) -> list[str]:
    """The entry under several domains, languages and prefixes, so that these tell nothing of the label."""
    host, path = entry.split(".test/")
    paths = (path, "en/1024", "de/77.html", "fr/4096/", "es/512")
    ends = ("com", "net", "org", "example.com", "example.net", "example.org")
    return [f"http://{before}{host}.{end}/{p}" for k, end in enumerate(ends) for p, before in ((paths[k % 5], ("", "www.", "m.", "blog.")[k % 4]), (paths[(k + 2) % 5], ""))]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the table above, label 1 to block."""
    rows = [(url, label) for text, label in ((BLOCKED, 1.0), (ORDINARY, 0.0)) for entry in text.split() for url in _spellings(entry)]
    return spark.createDataFrame(rows, "url string, label double")


def train(labelled: DataFrame, buckets: int = 1 << 14, max_rows: int = 30_000, penalty: float = 0.002) -> LogisticRegressionModel:
    """Fit on at most ``max_rows`` labelled URLs, those of lowest hash (url, label 0 or 1; rows with nulls are ignored); both labels weigh the same in all."""
    rows = labelled.na.drop(subset=["url", "label"]).orderBy(F.xxhash64("url"), "url").limit(max_rows)
    share = rows.agg(F.avg("label").alias("share")).first().share
    weight = F.when(F.col("label") == 1, 0.5 / share if share else 1.0).otherwise(0.5 / (1 - share) if share is not None and share < 1 else 1.0)
    return LogisticRegression(regParam=penalty, maxIter=50, weightCol="weight").fit(_features(rows.withColumn("weight", weight), buckets))


def judge(
    pages: DataFrame, model: LogisticRegressionModel | None, rules=RULES, threshold: float = 0.9, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Host, path, deciding rule and verdict of each URL.

    The rule whose host plus path is longest wins. Where none fits, the model blocks at ``threshold``;
    without a model all of these are allowed. Returns page_id, host, path, rule (host and path, else
    null), verdict and score (probability to block): a row for each row of ``pages``. Null URLs and those
    without `://` have empty host and path, fit no rule and are judged by the model alone. Ids may be null
    or repeat; further columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    if model is None:
        host, path = host_and_path(F.col("url"))
        scored, score = urls.withColumns({"host": host, "path": path}), F.lit(0.0)
    else:
        scored, score = model.transform(_features(urls, model.numFeatures)), vector_to_array("probability")[1]
    rule, verdict = _decided(rules)
    by_score = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), score.alias("score"))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, url_col: str = "url", **options) -> DataFrame:
    """``judge`` with a model of ``labelled`` (url, label), or of ``labelled_urls``.

    There is no model where the labels hold fewer than two classes.
    """
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    several = len(labelled.na.drop(subset=["url", "label"]).select("label").distinct().limit(2).collect()) > 1
    return judge(pages, train(labelled) if several else None, rules, url_col=url_col, **options)

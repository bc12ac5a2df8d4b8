"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import constant, softmax_fit

#: Hashed features, and characters of an n-gram.
SLOTS, GRAM = 4096, 4
#: The rules of the contract, verdict and rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words that hosts and paths of unwanted and of ordinary pages are made of.
UNWANTED = (
    "casino casino-win poker-online poker free-bets betting bets jackpot slots-bonus slot-machine roulette lottery gambling sportsbook "
    "cheap-pills pharma-discount pharmacy-online viagra-shop cialis diet-pills weight-loss-pills steroids replica-watches replica-bags fake-rolex "
    "adult-x xxx-videos xxx porn-tube porn sex-chat sexcams nude-cams escorts hot-dates hookup-dating milf-cams erotic "
    "ads ads-track adserver adsystem doubleclick clicktracker clickbait popup-ads popunder banner-ads affiliate-links tracker redirect-click "
    "spam spam-farm link-farm seo-backlinks buy-backlinks buy-followers cheap-traffic payday-loans fast-cash-loans debt-relief win-prizes free-iphone "
    "free-gift-cards survey-rewards crypto-giveaway bitcoin-doubler forex-signals get-rich-quick warez warez-crack keygen serial-crack cracked-apps "
    "torrent-download nulled-scripts hacked-accounts phishing malware-download fake-antivirus cheap-essays essay-mill"
).split()
ORDINARY = (
    "news daily daily-news library public-library university docs documentation manual manuals recipes cooking garden gardening history science journal "
    "weather museum art-museum city-council town-hall school high-school college travel hiking music orchestra forum wiki encyclopedia archive archives "
    "review book-review health health-service clinic tutorial tutorials photos photography books bookshop engineering market farmers-market report reports "
    "research research-institute culture radio theatre cinema nature wildlife sports football-club cycling chess astronomy physics chemistry biology "
    "mathematics medicine hospital law-school parliament ministry embassy railway transport airport maps geography poetry novels magazine gazette herald "
    "times tribune observer blog my-blog notes diary kitchen bakery restaurant hotel camping village parish-church monastery foundation charity volunteers "
    "software-development open-source code-review data-science statistics education kindergarten language-course dictionary translation philosophy"
).split()
ENDINGS = ("example.com", "example.net", "example.org", "test.invalid")
SYLLABLES = "th er an in on re at ti st en or es ou ha ed nd the tion ing ble ly sh wh".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if unwanted). Every word stands as a host and as a directory; made-up names of
    plain syllables are ordinary."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            end, front = ENDINGS[k % 4], ("", "www.", "m.", "blog.")[k // 4 % 4]
            rows.append((f"https://{front}{word}.{end}/{('en', 'de', 'fr', 'es')[k % 4]}/{k * 37 % 1000}", label))
            rows.append((f"http://{word}.{ENDINGS[(k + 1) % 4]}/", label))
            rows.append((f"https://www.{SYLLABLES[k % len(SYLLABLES)]}{SYLLABLES[(k + 7) % len(SYLLABLES)]}.{end}/{word}/{k}.html", label))
    for k, a in enumerate(SYLLABLES):
        for j in (1, 5, 11):
            b = SYLLABLES[(k + j) % len(SYLLABLES)]
            rows.append((f"http://{('', 'www.', 'm.', 'blog.')[(k + j) % 4]}{a}{b}.{ENDINGS[(k + j) % 4]}/{('en', 'de', 'fr', 'es')[j % 4]}/{k * 91 % 1000}{('', '/', '.html')[j % 3]}", 0))
    return rows


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def slots_of(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams of host and path, each marked with where it stands; digits of paths count alike."""

    def grams(mark: str, text: Column) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (GRAM - 1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(GRAM))), F.lit(SLOTS)).cast("int"))

    return F.array_distinct(F.concat(grams("h", host), grams("p", F.regexp_replace(path, "[0-9]+", "0"))))


@lru_cache(maxsize=1)
def _fit(application: str) -> tuple[tuple[float, ...], float]:
    spark = SparkSession.getActiveSession()
    rows = labelled_urls()
    table = spark.createDataFrame(rows, "url string, label int")
    got = table.select("label", slots_of(host_of(F.col("url")), path_of(F.col("url"))).alias("slots")).collect()
    x = np.zeros((len(got), SLOTS))
    for i, r in enumerate(got):
        x[i, r.slots] = 1.0
    w, b = softmax_fit(x, np.array([r.label for r in got]), 2, l2=1e-4, steps=800)
    return tuple(w[:, 1] - w[:, 0]), float(b[1] - b[0])


def fit_urls(spark: SparkSession) -> tuple[tuple[float, ...], float]:
    """The model (weight of each slot, bias), from the labelled table of some 600 rows. Its features come from the
    same expressions that score."""
    return _fit(spark.sparkContext.applicationId)


def filter_urls(pages: DataFrame, model: tuple[tuple[float, ...], float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for each row of pages (page_id, url; no other is read).

    A rule fits its host and the host's subdomains if the path starts with the rule's path; of several, the longest
    wins, and of equally long ones the first in order. Where none fits, rule is null and the verdict is the model's:
    block from a probability of one half. Null urls and urls without :// have an empty host and path, which the model
    judges like any other. Built-in functions only, without a shuffle; repeated rows give repeated rows.
    """
    weights, bias = model
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits wins
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    table = constant(list(weights))
    logit = F.aggregate(slots_of(F.col("host"), F.col("path")), F.lit(float(bias)), lambda a, k: a + F.get(table, k))
    rows = rows.withColumn("block_probability", 1 / (1 + F.exp(-logit))).withColumn("rule", rule)
    model_says = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce(verdict, model_says).alias("verdict"), "block_probability")

"""URL filters: host and path rules, and a logistic regression for urls that no rule fits.

The regression takes hashed character n-grams of host and path and is trained on the driver on a small labelled table
of urls: `LABELLED`, urls labelled one by one, or a table of the user's own, of which TRAIN_URLS rows at most are taken, in the
order of a hash. Its threshold is calibrated on rows that were held out, a fold at a time. Rules: a rule fits its host
and all subdomains if the path starts with the rule's path; the longest rule wins.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed or blocked by
the regression's bias alone; repeated rows are judged as often as they occur; rules of equal length cannot both fit one
url; an empty table gives an empty result; further columns pass through `judge` unless they bear the names of columns
that it adds, which then replace them. A very long url is judged by all of its n-grams.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs

#: Rules of the contract (fixed values): verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Urls labelled by reading them (fixed values): unwanted ones sell, cheat, track or are not for every reader; the others are ordinary.
LABELLED = {
    True: """
        casino-royal-spins.example.com/bonus/welcome  www.online-casino.example.net/slots/play  bigwin-casino.example.org/en/jackpot
        casino.lucky-seven.example.com/roulette       poker-stars-free.example.net/tables/join      www.pokerroom24.example.com/en/77
        play-poker-now.example.org/signup.html        bookmaker-bets.example.com/odds              bet365-mirror.example.net/live/12
        sports-betting-tips.example.com/win           bestbets.example.org/en/1208                  jackpot-slots-777.example.net/spin
        slots-heaven.example.com/free/9               www.vegas-slots.example.org/de/14             diet-pills-online.example.com/order
        pills4u.example.net/viagra-cialis             www.viagra-direct.example.com/buy             generic-viagra-shop.example.org/en/3
        online-pharmacy-rx.example.com/no-prescription  cheap-meds.example.net/pharmacy/77          canadian-pharmacy24.example.org/pills
        weight-loss-pills.example.com/miracle         adult-videos.example.com/watch/55           www.xxx-tube.example.net/free
        hot-xxx-cams.example.org/live                 porn-hub-free.example.com/en/901              www.pornclips.example.net/video/3
        adult-dating-now.example.com/meet             adult-personals.example.org/en/41             sexy-escort-girls.example.net/city
        escort-service24.example.com/book             www.nude-cams.example.org/join                live-sex-chat.example.com/room/7
        link-exchange-links.example.com/out/12            www.link-farm-seo.example.net/pages/801       splog-network.example.org/en/442
        buy-backlinks-cheap.example.com/seo           article-spinner-farm.example.net/en/6         cheap-seo-links.example.org/order
        content-farm24.example.com/a/90221            doorway-pages.example.net/cheap-flights-33    keyword-stuffing.example.org/spam/1
        adclick-pixel.example.com/pixel.gif         m.ads-network.example.net/redirect?id=1       tracker-ads.example.org/click/8831
        adserver7.example.com/banner/300x250          www.ad-track24.example.net/en/19              click-tracker.example.com/out
        popunder-ads.example.org/serve                ads.clickbank-offers.example.net/go           bets-affiliate-ads.example.com/track
        free-money-fast.example.com/earn              win-free-iphone.example.net/claim             you-won-prize.example.org/claim-now
        get-rich-quick24.example.com/bonus            make-money-home.example.net/secret            lottery-winner.example.com/claim/1
        payday-loans-now.example.com/apply            instant-cash-loans.example.net/en/4           bad-credit-loans.example.org/approve
        quickloans24.example.com/payday               forex-robot-profit.example.net/signup         bitcoin-doubler.example.com/invest
        crypto-giveaway-x2.example.org/send           replica-watches-shop.example.com/rolex        cheap-replica-bags.example.net/buy
        fake-designer-shop.example.org/replica        www.replicas24.example.com/en/7               warez-download.example.com/crack
        free-keygen-cracks.example.net/serial         cracked-software.example.org/warez/17         torrent-movies-free.example.com/hd
        www.torrentz-mirror.example.net/magnet        pirate-streams.example.org/watch-free         free-movies-torrent.example.com/en/5
        malware-cleaner-alert.example.com/scan        your-pc-is-infected.example.net/fix           download-virus-scan.example.org/setup.exe
        secure-login-paypa1.example.com/verify        account-verify-bank.example.net/login.php     phishing-kit.example.org/update-account
        apple-id-locked.example.com/unlock            free-vbucks-generator.example.net/human       clickbait-shock.example.com/you-wont-believe
        viral-shocking24.example.net/celebs           celebrity-gossip-xxx.example.org/leaked       hookup-tonight.example.com/singles
        mail-order-brides.example.net/gallery         psychic-love-spell.example.com/buy            cheap-cigarettes.example.org/order
        steroids-shop24.example.com/buy               essay-writing-cheap.example.net/order         buy-followers-likes.example.com/instagram
        escort-babes.example.com/en/21                casino-bonus-free.example.net/es/9            betting-bonus24.example.org/fr/17
    """,
    False: """
        www.morning-news.example.com/politics/2021    news.valley-times.example.org/local/88        blog.gardening-notes.example.com/roses
        library.city.example.org/catalogue/311        www.state-museum.example.net/exhibits/12      history-archive.example.org/en/1914
        docs.python-tools.example.com/install         wiki.linux-users.example.org/kernel           www.university.example.net/courses/math
        physics.university.example.org/research/55    school.example.com/parents/calendar           weather-today.example.net/forecast/paris
        recipes-kitchen.example.com/bread/rye         www.cooking-at-home.example.org/en/204        travel-journal.example.net/norway/fjords
        health-information.example.org/heart          www.hospital.example.com/visitors             music-lessons.example.net/piano/3
        photos.nature-club.example.org/birds          forum.bike-repair.example.com/thread/991      science-weekly.example.net/space
        council.example.org/meetings/minutes          www.parliament.example.net/bills/77           sports-results.example.com/football/2
        books-review.example.org/novels/12            journal.economics.example.net/vol/3           code-examples.example.com/java/lists
        museum.example.com/en/7                       gallery-modern-art.example.org/visit          theatre-programme.example.net/autumn
        www.orchestra.example.com/concerts            chess-club.example.org/rules                  hiking-trails.example.net/alps/9
        astronomy-society.example.com/moon            geology-field-notes.example.org/rocks         bird-watchers.example.net/spring
        farmers-market.example.com/opening            beekeeping.example.org/en/16                  woodworking-plans.example.net/chair
        knitting-patterns.example.com/socks           www.train-timetable.example.org/lines         bus-routes.example.net/line/42
        airport-information.example.com/arrivals      blog.maths-teacher.example.org/fractions      language-learning.example.net/german
        dictionary.example.com/word/house             encyclopedia.example.org/article/whale        www.film-festival.example.net/programme
        documentary-series.example.com/ocean          radio-station.example.org/listen              podcast-history.example.net/episode/31
        open-data.example.com/census/2011             maps.example.org/region/north                 statistics-office.example.net/prices
        law-library.example.com/cases/88              consumer-advice.example.org/rights            job-centre.example.net/vacancies
        bank-branch.example.com/opening-hours         post-office.example.org/parcels               insurance-guide.example.net/home
        pharmacy-school.example.org/students          credit-union.example.com/about                garden-centre.example.net/plants
        bookshop.example.com/new/fiction              furniture-store.example.org/tables/oak        toy-shop.example.net/wooden/9
        camera-reviews.example.com/lenses             computer-magazine.example.org/laptops         www.phone-tests.example.net/battery
        m.daily-post.example.com/opinion/5            blog.old-town.example.net/en/81               tech-notes.example.org/databases
        www.river-trust.example.com/water             animal-shelter.example.org/adopt              zoo.example.net/animals/bear
        kindergarten.example.com/menu                 parish-church.example.org/history             fire-brigade.example.net/youth
        swimming-pool.example.com/prices              tennis-club.example.org/courts                running-group.example.net/sunday
        blog.norvelo.example.com/en/12                m.castaret.example.org/en/7/                  www.lumidor.example.net/de/44
        harbrook.example.com/fr/9.html                veldana.example.org/es/3                      quillmoor.example.net/en/501
        www.brennick.example.com/en/66#top            blog.ostwick.example.org/en/8?page=2          marlowen.example.net/fr/19
        m.tavishell.example.com/es/77                 www.grendal.example.org/en/5                  pellory.example.com/en/23/
        blog.fernhaven.example.com/de/6               silverlake.example.org/en/91                  m.rowancourt.example.net/en/14.html
    """,
}
TRAIN_URLS = 2000
FOLDS = 8
#: Of the held-out urls that are blocked, so many must be unwanted.
PRECISION = 0.92
BUCKETS = 1 << 14
SIZES = (2, 3, 4)
SEED = 11


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.instr(url, "://") > 0, F.translate(host, upper, upper.lower())).otherwise(F.lit(""))


def path_of(url: Column, host: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3 + F.length(host), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(rest, "?", 1), "#", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict_, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, verdict_).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of host and path, wherever they stand."""
    found = {text[i : i + n] for text in (f"^{host}$", f"^{path}$") for n in SIZES for i in range(len(text) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found}), dtype=np.int64)


def split_url(url: str) -> tuple[str, str]:
    """(host, path) as `host_of` and `path_of` give them, without a scheme."""
    host = re.split("[/?#]", url, maxsplit=1)[0]
    path = re.split("[?#]", url[len(host) :], maxsplit=1)[0]
    return host.lower(), path


def labelled() -> list[tuple[str, str, bool]]:
    """(host, path, unwanted) of the table LABELLED, by a hash of the url."""
    rows = [(*split_url(url), bad) for bad, urls in LABELLED.items() for url in urls.split()]
    return sorted(rows, key=lambda r: zlib.crc32(f"{SEED}:{r[0]}{r[1]}".encode()))


def labelled_rows(table: DataFrame, most: int = TRAIN_URLS) -> list[tuple[str, str, bool]]:
    """(host, path, unwanted) of at most `most` rows (url, unwanted) of a table of the user's own."""
    some = table.where("url is not null and unwanted is not null").select("url", F.col("unwanted").cast("boolean").alias("unwanted"))
    rows = some.orderBy(F.xxhash64("url"), "url").limit(most).collect()
    return [(*split_url(r["url"].split("://", 1)[-1]), r["unwanted"]) for r in rows]


def fitted(rows: list[tuple[np.ndarray, bool]], epochs: int = 30, rate: float = 1.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient descent; a row's n-grams have unit length together."""
    rows, w, bias, rng = list(rows), np.zeros(BUCKETS), 0.0, random.Random(SEED)
    for _ in range(epochs):
        rng.shuffle(rows)
        for at, bad in rows:
            n = np.sqrt(max(len(at), 1))
            error = 1 / (1 + np.exp(-(w[at].sum() / n + bias))) - bad
            w *= 1 - decay
            w[at] -= rate * error / n
            bias -= 0.01 * error
    return w, bias


def trained(rows: list[tuple[str, str, bool]]) -> tuple[np.ndarray, float]:
    """Weights, and a bias that makes 0 the threshold: the least score whose precision on held-out rows is PRECISION."""
    made = [(grams(h, p), bad) for h, p, bad in rows]
    scores = []
    for k in range(FOLDS):
        w, bias = fitted([r for i, r in enumerate(made) if i % FOLDS != k])
        scores += [(log_odds(at, w, bias), bad) for at, bad in made[k::FOLDS]]
    scores.sort(reverse=True)
    good, threshold = 0, math.inf
    for n, (score, bad) in enumerate(scores, 1):
        good += bad
        if bad and good >= PRECISION * n:
            threshold = score
    w, bias = fitted(made)
    return w, bias - (threshold if math.isfinite(threshold) else 1e9)


@cache
def weights() -> tuple[np.ndarray, float]:
    return trained(labelled())


def log_odds(at: np.ndarray, w: np.ndarray, bias: float) -> float:
    return float(w[at].sum() / np.sqrt(max(len(at), 1)) + bias)


def unwanted(host: str, path: str, w: np.ndarray, bias: float) -> float:
    """Over one half for urls that are to be blocked."""
    return float(1 / (1 + np.exp(-np.clip(log_odds(grams(host, path), w, bias), -50, 50))))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, table: DataFrame | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and p_unwanted (over one half: the regression blocks).

    table: labelled urls (url, unwanted) in place of LABELLED.
    """
    w, bias = weights() if table is None else trained(labelled_rows(table))
    pages = pages.drop("host", "path", "rule", "verdict", "p_unwanted")
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    pages = pages.withColumn("host", host_of(u)).withColumn("path", path_of(u, F.col("host")))
    schema = T.StructType([*pages.schema.fields, T.StructField("p_unwanted", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column("host"), batch.column("path")):
                some = batch.slice(a, b - a)
                p = [unwanted(h, q, w, bias) for h, q in zip(some.column("host").to_pylist(), some.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(p, pa.float64())], [*some.schema.names, "p_unwanted"])

    scored = pages.mapInArrow(score, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("p_unwanted") >= 0.5, "block").otherwise("allow")))


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_unwanted")

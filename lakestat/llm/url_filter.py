"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other pages.

Native: SQL functions, and Spark ML for the regression. The labelled table is small and part of this module. Scoring
is one pass over the pages without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 12
ORDERS = (3, 4, 5)

#: verdict, host, start of the path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled hosts and paths; each host of a label is paired with each path of it.
LABELLED = {
    "block": (
        "casino-royal.com bestcasino777.net online-poker-room.com luckyslots24.info betting-tips.biz sportsbet-live.com roulette-bonus.net jackpot-winner.xyz freespins.casino bingo-cash.org "
        "cheap-pills.com pharma-discount.net viagra-online.info buy-cialis.biz canadian-drugs.top weightloss-miracle.com herbal-enhance.net no-prescription.shop "
        "adult-cams.com xxx-videos.net hot-dates.info sexychat.live nude-girls.xyz porn-tube.org escort-guide.biz webcam-babes.com milf-dating.net erotic-stories.info "
        "free-crack.net warez-world.org torrent-hub.info keygen-files.com serials-download.biz nulled-scripts.xyz cracked-apk.top movies-leaked.net "
        "payday-loans.com quick-cash-now.net credit-repair-fast.info forex-signals.biz binary-options.top crypto-doubler.xyz get-rich-quick.org make-money-fast.com "
        "replica-watches.com fake-handbags.net cheap-jerseys.shop designer-outlet-sale.top "
        "seo-backlinks.net buy-followers.com cheap-traffic.info link-farm.biz clickbait-news.xyz spam-mailer.org bulk-email-leads.com ad-tracker.net popup-ads.info win-prizes.top free-gift-card.xyz survey-rewards.net",
        "/ /win/big-bonus /cheap/pills-online /download/free-crack.exe /click?id=1 /xxx/cams /buy-now/50-off /go/aff?sub=12 /bonus-code/free-spins /hot/girls/online",
    ),
    "allow": (
        "en.wikipedia.org www.britannica.com docs.python.org www.nature.com news.bbc.co.uk www.lemonde.fr www.elpais.com www.spiegel.de blog.example.org library.university.edu archive.museum.org "
        "www.weather.gov health.ministry.gov cityhall.town.us open-science.org journal.physics.org www.school.edu forum.gardening.net recipes.kitchen.com cooking-at-home.org local-history.info "
        "maps.geography.org travel-notes.com code.project.io parliament.gov.uk water-research.org national-theatre.org mountain-trails.com music-theory.net "
        "thought-and-language.org www.birdwatching.net river-ecology.info philosophy.stanford.edu chess-club.org community-choir.net trains-and-stations.com the-daily-herald.com "
        "northern-lights.is handcraft.ie thethirdpage.com shorelines.org weather-station.net m.heritage.org static.archive.net earthquake.usgs.gov statistics.office.eu "
        "astronomy-today.com gardens-of-england.co.uk linguistics.uni.de bibliothek.stadt.de zeitung-online.de schule-am-see.de rezepte-und-mehr.de musee-des-arts.fr "
        "bibliotheque-nationale.fr recettes-simples.fr histoire-de-france.fr ayuntamiento.es noticias-locales.es recetas-caseras.es cultura-y-arte.es open-data.city.org "
        "mathematics.stack.net oceanography.edu childrens-books.org engineering-notes.io photography-basics.com old-maps.org",
        "/ /en/1234 /fr/5678/ /de/article.html /es/2024/05/story /wiki/Water /news/2023/10/12/election-results /articles/how-rivers-form /docs/install.html /about /blog/a-walk-in-the-hills /section/science",
    ),
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    return tuple(F.coalesce(*[F.when(f, F.lit(x)) for f, x in zip(fits, values, strict=True)]) for values in ([h + p for _, h, p in ordered], [r[0] for r in ordered]))


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they are from."""
    return F.concat(*[_cut(F.concat(F.lit("^"), text, F.lit("$")), n, mark) for mark, text in (("h", host), ("p", path)) for n in ORDERS])


def _cut(text: Column, n: int, mark: str) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: label (1 to block), url."""
    tables = [
        spark.range(1, numPartitions=1)
        .select(F.explode(F.split(F.lit(hosts), " ")).alias("host"))
        .select(F.lit(float(label == "block")).alias("label"), "host", F.explode(F.split(F.lit(paths), " ")).alias("path"))
        .select("label", F.concat(F.lit("https://"), "host", "path").alias("url"))
        for label, (hosts, paths) in LABELLED.items()
    ]
    return reduce(DataFrame.unionByName, tables).coalesce(1)


def features(df: DataFrame, url_col: str, prefix: str = "_") -> DataFrame:
    """``df`` with host, path and hashed n-grams, the latter two columns named by the prefix."""
    host, path = host_and_path(F.col(url_col))
    df = df.withColumn(f"{prefix}host", host).withColumn(f"{prefix}path", path).withColumn(f"{prefix}grams", ngrams(F.col(f"{prefix}host"), F.col(f"{prefix}path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol=f"{prefix}grams", outputCol=f"{prefix}features").transform(df)


def train(spark: SparkSession) -> LogisticRegressionModel:
    """The regression, fitted to the labelled table."""
    return LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_prediction", rawPredictionCol="_raw", probabilityCol="_probability", regParam=0.01, maxIter=60).fit(
        features(labelled(spark), "url")
    )


def judge(pages: DataFrame, model: LogisticRegressionModel, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block.

    The longest fitting rule decides; where none fits, p_block >= 0.5 blocks. An address without host (null, empty or
    without ``://``) has nothing to go by and is allowed, with p_block 0. Repeated rows give repeated results. Columns of
    these names are replaced; no other name clashes.
    """
    made = ("host", "path", "rule", "verdict", "p_block")
    own = [F.col(c) for c in pages.columns if c.lower() not in made]
    p = "_u"
    while any(c.lower().startswith(p) for c in pages.columns):
        p += "_"
    names = {"featuresCol": f"{p}features", "predictionCol": f"{p}prediction", "rawPredictionCol": f"{p}raw", "probabilityCol": f"{p}probability"}
    model = model.copy({model.getParam(k): v for k, v in names.items()})
    df = model.transform(features(pages, url_col, p))
    host, path = F.col(f"{p}host"), F.col(f"{p}path")
    rule, verdict = matched_rule(host, path)
    share = F.when(host == "", F.lit(0.0)).otherwise(F.round(vector_to_array(f"{p}probability")[1], 9))
    df = df.withColumn(f"{p}share", share)
    return df.select(*own, host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col(f"{p}share") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.col(f"{p}share").alias("p_block"))

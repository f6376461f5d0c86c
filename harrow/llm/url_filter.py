"""URL filter: rules on host and path first, else logistic regression on hashed n-grams.

The classifier sees the 3- to 5-character pieces of the host and of the path (each
with its ends marked), hashed to a fixed number of columns, and is trained from a
small labelled table of URLs. Everything is DataFrame functions and Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged_path

# The rules of the stated policy (host and path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# The labelled URLs that the default classifier learns from (1: block). Names made up for it;
# no host of the test tables is among them.
LABELLED = [
    ("http://pills-direct.example.com/order/5", 1), ("https://www.discountpills.example.org/en/rx", 1), ("http://meds-cheaper.example.net/buy-now", 1),
    ("https://m.best-pharmacy-deals.example.com/cart", 1), ("http://blog.viagra-shop.example.org/fr/8", 1), ("https://cheap-pharmacy.example.net/en/61", 1),
    ("http://pharma-pills.example.com/de/7", 1), ("https://www.rx-meds.example.org/refill", 1), ("http://pillstore.example.net/es/90/", 1),
    ("https://m.buy-cheap-meds.example.com/en/2.html", 1), ("http://blog.linkfarm.example.org/list/31", 1), ("https://farm-of-links.example.net/seo", 1),
    ("http://spamhost.example.com/de/77.html", 1), ("https://www.spam-blast.example.org/mail", 1), ("http://seo-spam-tools.example.net/backlinks", 1),
    ("https://m.spam-links.example.com/en/44", 1), ("http://blog.link-spammer.example.org/fr/5", 1), ("https://seo-farm-pro.example.net/offer", 1),
    ("http://content-farm.example.com/en/630", 1), ("https://www.spam-mailer.example.org/es/12/", 1), ("http://casino-royal.example.net/spin", 1),
    ("https://m.online-casino.example.com/en/12", 1), ("http://blog.win-big.example.org/slots", 1), ("https://jackpot-wins.example.net/claim", 1),
    ("http://poker-win.example.com/es/4", 1), ("https://www.betting-odds.example.org/live", 1), ("http://free-bet-bonus.example.net/en/3", 1),
    ("https://m.sports-bets.example.com/odds", 1), ("http://blog.bets24.example.org/fr/9", 1), ("https://casino-slots.example.net/en/18.html", 1),
    ("http://slots-win.example.com/de/3", 1), ("https://www.bet-casino.example.org/fr/700", 1), ("http://poker-bets.example.net/en/25/", 1),
    ("https://m.casino-bonus-win.example.com/go", 1), ("http://blog.adult-cams.example.org/live", 1), ("https://adult-chat.example.net/en/7", 1),
    ("http://x-videos.example.com/free", 1), ("https://www.xxx-tube.example.org/watch", 1), ("http://hot-singles.example.net/chat", 1),
    ("https://m.adult-videos.example.com/de/14", 1), ("http://blog.xxx-cams.example.org/fr/3", 1), ("https://adult-tube.example.net/en/88/", 1),
    ("http://hot-adult.example.com/es/6", 1), ("https://www.adserver.example.org/pixel", 1), ("http://ads-click.example.net/redirect", 1),
    ("https://m.tracking-ads.example.com/banner", 1), ("http://blog.click-tracker.example.org/de/55", 1), ("https://popup-ads.example.net/en/1", 1),
    ("http://ad-tracker.example.com/fr/20", 1), ("https://www.ads-banner.example.org/en/31.html", 1), ("http://track-click.example.net/go", 1),
    ("https://m.banner-ads.example.com/es/9", 1), ("http://blog.adtracking.example.org/en/402", 1), ("https://free-money-now.example.net/offer", 1),
    ("http://cheap-loans.example.com/en/20", 1), ("https://www.payday-loans.example.org/apply", 1), ("http://free-cash.example.net/claim", 1),
    ("https://m.cheap-followers.example.com/buy", 1), ("http://blog.easy-money-loans.example.org/fr/41", 1), ("https://free-loans.example.net/en/5/", 1),
    ("http://cheap-cash.example.com/de/60", 1),
    ("http://harbour.example.com/en/853/", 0), ("https://www.riverside.example.org/en/25", 0), ("http://orchard.example.net/en/148.html", 0),
    ("https://m.meadow.example.com/en/685", 0), ("http://blog.riverbank.example.org/en/676", 0), ("https://stonebridge.example.net/fr/328/", 0),
    ("http://brother.example.com/es/797", 0), ("https://www.station.example.org/es/978", 0), ("http://winter.example.net/en/334/", 0),
    ("https://m.library.example.com/catalogue/history", 0), ("http://blog.news.example.org/world/article/1020", 0), ("https://docs.example.net/guide/install.html", 0),
    ("http://university.example.com/physics/lecture-4", 0), ("https://www.museum.example.org/exhibitions/maps", 0), ("http://weather.example.net/forecast/north", 0),
    ("https://m.recipes.example.com/bread/rye", 0), ("http://blog.forum.example.org/thread/5521", 0), ("https://wiki.example.net/de/Geschichte", 0),
    ("http://city.example.com/fr/services/ecole", 0), ("https://www.sports.example.org/football/results", 0), ("http://garden.example.net/plants/roses", 0),
    ("https://m.attention.example.com/en/519", 0), ("http://blog.motion.example.org/fr/103797", 0), ("https://kitchen.example.net/de/183162", 0),
    ("http://heath.example.com/fr/86027.html", 0), ("https://www.northern.example.org/en/202177", 0), ("http://feather.example.net/de/925", 0),
    ("https://m.education.example.com/en/453", 0), ("http://blog.travel.example.org/es/rutas", 0), ("https://music.example.net/en/albums/7", 0),
    ("http://old-town.example.com/en/14", 0), ("https://www.north-east.example.org/de/3?page=2", 0), ("http://long-road.example.net/es/61/", 0),
    ("https://m.question.example.com/en/9#top", 0), ("http://blog.weathering.example.org/fr/300", 0), ("https://tradition.example.net/en/41.html", 0),
    ("http://further.example.com/de/8", 0), ("https://www.nothing.example.org/en/77?utm_source=feed", 0), ("http://another.example.net/en/15", 0),
    ("https://m.together.example.com/fr/62/", 0), ("http://blog.nation.example.org/en/7084.html", 0), ("https://station-house.example.net/de/31", 0),
    ("http://thousand.example.com/es/5", 0), ("https://www.function.example.org/en/96#top", 0), ("http://moth.example.net/de/440", 0),
    ("https://m.within.example.com/en/27/", 0), ("http://blog.hand-made.example.org/fr/12", 0), ("https://thinking.example.net/en/3311", 0),
    ("http://earth.example.com/es/208.html", 0), ("https://www.strength.example.org/en/64", 0), ("http://thrift.example.net/fr/42", 0),
    ("https://m.theatre.example.com/en/2019/", 0), ("http://blog.mother.example.org/de/6", 0), ("https://pattern.example.net/en/73.html", 0),
    ("http://ninth.example.com/es/31", 0), ("https://www.southern.example.org/en/5150", 0), ("http://theory.example.net/fr/9/", 0),
    ("https://m.clothing.example.com/en/880", 0), ("http://blog.bathing.example.org/de/12", 0), ("https://whether.example.net/en/4#top", 0),
    ("http://thorough.example.com/es/66", 0), ("https://www.weathered.example.org/fr/207", 0), ("http://section.example.net/en/38", 0),
    ("https://m.mention.example.com/de/902.html", 0), ("http://blog.relation.example.org/es/17", 0), ("https://action.example.net/en/61/", 0),
    ("http://portion.example.com/fr/24", 0), ("https://www.caption.example.org/en/2750", 0), ("http://edition.example.net/de/8/", 0),
    ("https://m.nationwide.example.com/en/11", 0), ("http://blog.lotion.example.org/es/450", 0), ("https://auction.example.net/fr/77.html", 0),
    ("http://rational.example.com/en/93", 0), ("https://www.station-road.example.org/en/6", 0), ("http://gather.example.net/de/31", 0),
    ("https://m.thirteen.example.com/en/708/", 0), ("http://blog.thanks.example.org/fr/2", 0), ("https://breath.example.net/en/190.html", 0),
    ("http://tooth.example.com/es/63", 0), ("https://www.author.example.org/en/5?page=3", 0), ("http://method.example.net/de/144", 0),
    ("https://m.rhythm.example.com/fr/81/", 0), ("http://blog.lighthouse.example.org/en/27", 0), ("https://plinth.example.net/en/3600", 0),
    ("http://mathematics.example.com/es/9", 0), ("https://www.fifth.example.org/en/54/", 0), ("http://hearth.example.net/en/16", 0),
    ("https://m.thesis.example.com/de/2040", 0), ("http://blog.lantern.example.org/fr/35", 0), ("https://orchestra.example.net/en/7.html", 0),
    ("http://thimble.example.com/en/420", 0), ("https://www.panther.example.org/es/28/", 0), ("http://leather.example.net/en/91", 0),
    ("https://m.thermal.example.com/de/3", 0), ("http://blog.wreath.example.org/fr/650", 0), ("https://together-again.example.net/en/12/", 0),
    ("http://bother.example.com/en/83", 0), ("https://www.truth.example.org/es/47", 0), ("http://bakery.example.net/en/26", 0),
    ("https://m.farmers-market.example.com/en/9", 0), ("http://blog.village.example.org/fr/310", 0), ("https://school.example.net/de/45/", 0),
    ("http://harvest.example.com/en/700", 0), ("https://www.pharmacy-history.example.org/en/3", 0), ("http://trackside.example.net/fr/18", 0),
    ("https://m.moneywort.example.com/en/92.html", 0), ("http://blog.betterment.example.org/de/5", 0), ("https://advent.example.net/en/240", 0),
    ("http://farmland.example.com/es/33/", 0), ("https://www.windmill.example.org/en/71", 0), ("http://carpet.example.net/fr/64", 0),
    ("https://m.cinema.example.com/en/8", 0), ("http://blog.painting.example.org/de/119", 0), ("https://violin.example.net/en/52/", 0),
    ("http://concert.example.com/es/7", 0), ("https://www.planet.example.org/en/1206", 0), ("http://mountain.example.net/fr/29", 0),
    ("https://m.bridge.example.com/de/48.html", 0), ("http://blog.river.example.org/en/360", 0), ("https://forest.example.net/en/15/", 0),
    ("http://castle.example.com/es/84", 0), ("https://www.history.example.org/fr/22", 0),
]

COLUMNS = 1 << 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds (or replaces) host and path: both empty for null or without ``://``."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end")
    return df.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def _grams(text: str) -> str:
    marked = f"concat('^', {text}, '$')"
    return (
        f"flatten(transform(array(3, 4, 5), n -> if(length({marked}) >= n,"
        f" transform(sequence(1, length({marked}) - n + 1), i -> concat('{text} ', substring({marked}, i, n))), cast(array() as array<string>))))"
    )


def _with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("harrow_grams", F.expr(f"concat({_grams('host')}, {_grams('path')})"))


def fit_url_classifier(labelled: DataFrame, columns: int = COLUMNS, penalty: float = 0.003):
    """A Spark ML model from (url, label 0/1); null labels are left out. The table is a small one: it is fitted in one task.

    The model is saved and loaded: a fitted one carries its training summary, and with it
    the session, into every scoring task, and a session that has ever observed a metric
    (``DataFrame.observe``) can't be serialised.
    """
    stages = [HashingTF(inputCol="harrow_grams", outputCol="harrow_features", numFeatures=columns), LogisticRegression(featuresCol="harrow_features", labelCol="label", probabilityCol="harrow_p", predictionCol="harrow_y", rawPredictionCol="harrow_raw", regParam=penalty, maxIter=60)]
    rows = _with_grams(with_url_parts(labelled)).where("label is not null").select("harrow_grams", F.col("label").cast("double").alias("label"))
    path = staged_path(labelled.sparkSession, "url-classifier")
    Pipeline(stages=stages).fit(rows.coalesce(1)).write().save(path)
    return PipelineModel.load(path)


def held_out(labelled: DataFrame, parts: int = 5, **options) -> DataFrame:
    """``labelled`` with the block_probability of a classifier that was fitted without the url's host.

    Hosts are dealt to ``parts`` by a hash; each part is judged by the model of the others.
    """
    rows = with_url_parts(labelled).withColumn("harrow_part", F.pmod(F.xxhash64("host"), F.lit(parts)))
    out = None
    for part in range(parts):
        model = fit_url_classifier(rows.where(F.col("harrow_part") != part), **options)
        scored = model.transform(_with_grams(rows.where(F.col("harrow_part") == part))).withColumn("block_probability", vector_to_array("harrow_p")[1])
        out = scored if out is None else out.unionByName(scored)
    return out.select(*labelled.columns, "host", "path", "block_probability")


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = tuple(RULES), model=None, bar: float = 0.5, url: str = "url") -> DataFrame:
    """``df`` and host, path, rule, block_probability, verdict (columns of these names are replaced).

    A rule (``host/path``) fits its host and subdomains where the path starts with the
    rule's; the longest that fits gives rule and verdict, ties to the smaller text. Else
    rule is null and the verdict is ``block`` at a block probability of ``bar`` or more.
    Null url: empty host and path, judged by the classifier. Rows are never dropped,
    repeated ones are judged each; an empty table gives no rows.
    """
    spark = df.sparkSession
    model = model or fit_url_classifier(default_labels(spark))
    parts = with_url_parts(df.drop("rule", "block_probability", "verdict"), url)
    scored = model.transform(_with_grams(parts)).withColumn("block_probability", vector_to_array("harrow_p")[1])
    rule = verdict = None
    for text, answer in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = rule.when(fits, text) if rule is not None else F.when(fits, text)
        verdict = verdict.when(fits, answer) if verdict is not None else F.when(fits, answer)
    learned = F.when(F.col("block_probability") >= bar, "block").otherwise("allow")
    out = scored.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "verdict": F.coalesce(verdict, learned) if verdict is not None else learned})
    return out.drop("harrow_grams", "harrow_features", "harrow_raw", "harrow_p", "harrow_y")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``pages``, and the classifier's probability."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))

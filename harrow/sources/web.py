"""Fetching a corpus: two partitioned, retrying data sources for Spark, and the records made of what they read.

``harrow_articles`` asks an encyclopedia for one article a request, each partition its share
of the titles. ``harrow_feed`` pages through a feed of papers; its requests keep a distance
in time, so all topics are one partition's work. Both are read like any other format::

    spark.read.format("harrow_articles").option("topics", json).load()

Options: ``topics`` (JSON: a list of name, category, titles), ``endpoint``, ``retries``,
``backoff`` (seconds that the first wait lasts at most), and of the feed ``since``, ``until``
(the window of submission), ``count``, ``page``, ``interval``.
"""

from __future__ import annotations

import json
import logging
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError
from ..functions.text import cap_at_sections, squash, strip_back_matter
from ..operators.synthesis import mirrors
from ..staging import stage
from .corpus import build_corpus, write_jsonl

log = logging.getLogger("harrow")
# The public services, and how they ask to be used.
ARTICLES = "https://en.wikipedia.org/w/api.php"
FEED = "https://export.arxiv.org/api/query"
FEED_INTERVAL = 3.1
ARTICLE_PARTITIONS = 4
TRANSIENT = (406, 429, 500, 502, 503, 504)
ATOM = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
ARTICLE_LICENSE, PAPER_LICENSE = "CC BY-SA 4.0", "CC0 1.0 (arXiv metadata)"
USER_AGENT = "harrow corpus reader"
#: Entries asked for, for each that is wanted: others have another primary category.
OVERFETCH = 3
RETRIES, BACKOFF, LONGEST_WAIT = 5, 5.0, 90.0


def fetch(url: str, query: dict, retries: int = RETRIES, backoff: float = BACKOFF) -> bytes:
    """The body of a GET. Transient statuses and lost connections are tried again, each time after a longer random wait."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(query)}", headers={"User-Agent": USER_AGENT})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.read()
        except (urllib.error.URLError, TimeoutError, ConnectionError) as lost:
            status = getattr(lost, "code", None)
            if attempt == retries or (status is not None and status not in TRANSIENT):
                raise SourceError(f"GET {url} failed: {lost}") from lost
            time.sleep(random.uniform(0.5, 1) * min(LONGEST_WAIT, backoff * 2**attempt))
    raise AssertionError


@dataclass
class Titles(InputPartition):
    titles: list[tuple[str, str]]


class _Fetching(DataSource):
    """Options that both sources share."""

    def topics(self) -> list[dict]:
        try:
            return json.loads(self.options["topics"])
        except (KeyError, ValueError) as wrong:
            raise SourceError("the option topics must be a JSON list of name, category and titles") from wrong

    def number(self, name: str, default: float) -> float:
        return float(self.options.get(name.lower(), default))

    def get(self, default: str, query: dict) -> bytes:
        return fetch(self.options.get("endpoint", default), query, int(self.number("retries", RETRIES)), self.number("backoff", BACKOFF))


class Articles(_Fetching):
    """(topic, page_id, title, extract, revision_id) of every title, redirects followed; a missing one fails the read."""

    @classmethod
    def name(cls) -> str:
        return "harrow_articles"

    def schema(self) -> str:
        return "topic string, page_id long, title string, extract string, revision_id string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(self)


class ArticleReader(DataSourceReader):
    def __init__(self, source: Articles):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        titles = [(t["name"], title) for t in self.source.topics() for title in t.get("titles", [])]
        n = min(int(self.source.number("partitions", ARTICLE_PARTITIONS)), max(1, len(titles)))
        return [Titles(titles[k::n]) for k in range(n)]

    def read(self, partition: Titles) -> Iterator[tuple]:
        for topic, title in partition.titles:
            body = self.source.get(ARTICLES, {"action": "query", "format": "json", "formatversion": 2, "prop": "extracts|info", "explaintext": 1, "redirects": 1, "titles": title})
            pages = json.loads(body).get("query", {}).get("pages") or [{}]
            if pages[0].get("missing") or not pages[0].get("extract"):
                raise SourceError(f"there is no article {title!r}")
            yield topic, pages[0]["pageid"], pages[0]["title"], pages[0]["extract"], str(pages[0].get("lastrevid", ""))


class Feed(_Fetching):
    """(topic, id, title, summary, primary_category, published, place) of the newest papers of each topic's category in the window.

    Pages are asked for until ``count`` entries have the category as their primary one,
    ``OVERFETCH`` times as many were seen, or the feed ends.
    """

    @classmethod
    def name(cls) -> str:
        return "harrow_feed"

    def schema(self) -> str:
        return "topic string, id string, title string, summary string, primary_category string, published string, place long"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self)


class FeedReader(DataSourceReader):
    def __init__(self, source: Feed):
        self.source = source

    def read(self, partition) -> Iterator[tuple]:
        source, asked = self.source, 0
        count, page = int(source.number("count", 20)), int(source.number("page", 100))
        for topic in source.topics():
            if not topic.get("category"):
                continue
            search = f"cat:{topic['category']} AND submittedDate:[{source.options.get('since', '0')} TO {source.options.get('until', '999912312359')}]"
            seen = own = 0
            while own < count and seen < OVERFETCH * count:
                if asked:
                    time.sleep(source.number("interval", FEED_INTERVAL))
                asked += 1
                size = min(page, OVERFETCH * count - seen)
                entries = _entries(source.get(FEED, {"search_query": search, "start": seen, "max_results": size, "sortBy": "submittedDate", "sortOrder": "descending"}))
                for e in entries:
                    own += e[3] == topic["category"]
                    yield topic["name"], *e, seen
                    seen += 1
                if len(entries) < size:
                    break


def _entries(body: bytes) -> list[tuple[str, str, str, str, str]]:
    try:
        found = ElementTree.fromstring(body).findall("a:entry", ATOM)
    except ElementTree.ParseError as wrong:
        raise SourceError("the feed is malformed") from wrong
    rows = []
    for e in found:
        values = [e.findtext(f"a:{name}", None, ATOM) for name in ("id", "title", "summary", "published")]
        if None in values:
            raise SourceError("an entry of the feed lacks id, title, summary or published")
        primary = e.find("x:primary_category", ATOM)
        rows.append((*values[:3], "" if primary is None else primary.get("term", ""), values[3]))
    return rows


def _metadata(**values) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))


def encyclopedia_records(fetched: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Records of articles as read: back matter cut, whole sections up to ``max_chars``."""
    text = cap_at_sections(strip_back_matter("extract"), max_chars)
    meta = _metadata(source=F.lit("wikipedia"), topic=F.col("topic"), license=F.lit(ARTICLE_LICENSE), revision_id=F.col("revision_id").cast("string"))
    # As percent-encoding for a path leaves it: letters, digits and _ . - ~ / stand for themselves.
    page = F.regexp_replace(F.regexp_replace(F.url_encode(F.replace("title", F.lit(" "), F.lit("_"))), "%2F", "/"), "%7E", "~")
    page = F.regexp_replace(page, r"\*", "%2A")
    return fetched.select(F.concat(F.lit("wikipedia:"), F.col("page_id").cast("string")).alias("doc_id"), "title", text.alias("text"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), page).alias("source_uri"), meta.alias("metadata"))


def paper_records(entries: DataFrame, topics: DataFrame, count: int) -> DataFrame:
    """Records of feed entries: of each topic (topic, category) the first ``count`` in the feed's order whose primary category is its own.

    A version at the end of an id is dropped, white space squashed.
    """
    own = entries.join(F.broadcast(topics), "topic").where(F.col("primary_category") == F.col("category"))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("place"))).where(F.col("r") <= count)
    pid = F.regexp_replace(F.regexp_replace("id", "^.*/abs/", ""), r"v\d+$", "")
    meta = _metadata(source=F.lit("arxiv"), topic=F.col("topic"), license=F.lit(PAPER_LICENSE), published=F.col("published"), primary_category=F.col("primary_category"))
    return first.select(F.concat(F.lit("arxiv:"), pid).alias("doc_id"), squash("title").alias("title"), squash("summary").alias("text"), F.concat(F.lit("https://arxiv.org/abs/"), pid).alias("source_uri"), meta.alias("metadata"))


def fetch_corpus(spark: SparkSession, topics: list[dict], out: str, papers: int = 20, max_chars: int = 8000, mirrors_per_topic: int = 2, articles: dict | None = None, feed: dict | None = None) -> int:
    """Fetch, shape and write a corpus as JSONL in ascending doc_id; returns the number of documents.

    ``articles`` and ``feed`` are further options of the two sources. A topic with
    fewer papers than asked for is logged.
    """
    for source in (Articles, Feed):
        spark.dataSource.register(source)
    named = json.dumps(topics)
    pages = encyclopedia_records(spark.read.format("harrow_articles").options(topics=named, **(articles or {})).load(), max_chars)
    entries = spark.read.format("harrow_feed").options(topics=named, count=papers, **(feed or {})).load()
    categories = spark.createDataFrame([(t["name"], t.get("category")) for t in topics], "topic string, category string")
    # What was read once is not asked for again.
    pages, found = stage(pages), stage(paper_records(entries, categories, papers))
    for r in categories.where("category is not null").join(found.groupBy(F.col("metadata")["topic"].alias("topic")).count(), "topic", "left").fillna(0, ["count"]).where(F.col("count") < papers).collect():
        log.warning("topic %s has %d papers of %d", r.topic, r["count"], papers)
    corpus = stage(build_corpus(pages, found, mirrors(pages, mirrors_per_topic) if mirrors_per_topic else None))
    write_jsonl(corpus, out, order="doc_id")
    return corpus.count()

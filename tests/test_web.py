"""Fetching a corpus from a server of our own, which now and then is out of order."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from harrow.__main__ import main
from harrow.errors import SourceError
from harrow.sources import web as W

BODY = "Lead of {t}.\n\n== One ==\n" + "\n".join(f"line {i} of words" for i in range(30)) + "\n== References ==\nnot this"
TOPICS = [{"name": "one", "category": "c.A", "titles": ["Old name", "Ünder/the *sea~"]}, {"name": "two", "category": "c.B", "titles": ["Third (x)"]}, {"name": "three", "titles": []}]


class Server(BaseHTTPRequestHandler):
    asked: list = []
    fails: dict = {}

    def do_GET(self):  # noqa: N802
        path, _, query = self.path.partition("?")
        q = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        Server.asked.append((path, q))
        left = Server.fails.get(q.get("titles"), [])
        status = left.pop(0) if left else 200
        self.send_response(status)
        self.end_headers()
        self.wfile.write(b"busy" if status != 200 else self.articles(q) if path == "/articles" else self.feed(q))

    def articles(self, q):
        title = {"Old name": "New name"}.get(q["titles"], q["titles"])
        page = {"missing": True} if title == "Nowhere" else {"pageid": 100 + len(title), "title": title, "extract": BODY.format(t=title), "lastrevid": 7}
        return json.dumps({"query": {"pages": [page]}}).encode()

    def feed(self, q):
        if "c.bad" in q["search_query"]:
            return b"<feed"
        name, start = q["search_query"][4:7], int(q["start"])
        entries = "".join(
            f"<entry><id>http://x/abs/{name}.{i}v{i % 3 + 1}</id><title>Title\n {i}</title><summary> about  {i} </summary><published>2024-01-{28 - i:02}</published>"
            f'<p:primary_category term="{name if i % 2 else "other"}"/></entry>'
            for i in range(start, min(start + int(q["max_results"]), 9))
        )
        return f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:p="http://arxiv.org/schemas/atom">{entries}</feed>'.encode()

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    Server.asked, Server.fails = [], {}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_a_corpus_is_fetched_by_the_command(spark, tmp_path, site):
    (tmp_path / "topics.json").write_text(json.dumps(TOPICS))
    Server.fails = {"Third (x)": [503, 429]}
    sources = {n: json.dumps({"endpoint": f"{site}/{n}", "backoff": 0, "interval": 0, "page": 2, "since": "2024", "until": "2025"}) for n in ("articles", "feed")}
    assert main(["fetch-corpus", str(tmp_path / "topics.json"), str(tmp_path / "out.jsonl"), "--papers", "3", "--max-chars", "100", "--mirrors", "1", "--articles", sources["articles"], "--feed", sources["feed"]]) == 0
    files = sorted(f for f in (tmp_path / "out.jsonl").iterdir() if f.name.startswith("part-"))
    rows = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id["wikipedia:108"] == {"doc_id": "wikipedia:108", "title": "New name", "text": "Lead of New name.", "source_uri": "https://en.wikipedia.org/wiki/New_name", "metadata": {"source": "wikipedia", "topic": "one", "license": "CC BY-SA 4.0", "revision_id": "7"}}
    assert by_id["wikipedia:115"]["source_uri"] == "https://en.wikipedia.org/wiki/" + urllib.parse.quote("Ünder/the_*sea~")
    assert sorted(i for i in by_id if i.startswith("arxiv:")) == [f"arxiv:{c}.{i}" for c in ("c.A", "c.B") for i in (1, 3, 5)]
    assert by_id["arxiv:c.A.3"] == {"doc_id": "arxiv:c.A.3", "title": "Title 3", "text": "about 3", "source_uri": "https://arxiv.org/abs/c.A.3", "metadata": {"source": "arxiv", "topic": "one", "license": "CC0 1.0 (arXiv metadata)", "published": "2024-01-25", "primary_category": "c.A"}}
    assert sum(i.startswith("mirror:") for i in by_id) == 2 and len(rows) == 3 + 6 + 2
    assert sum(q.get("titles") == "Third (x)" for _, q in Server.asked) == 3  # twice in vain, and no second read
    feed = [q for p, q in Server.asked if p == "/feed"]
    assert [int(q["start"]) for q in feed] == [0, 2, 4] * 2 and feed[0]["search_query"] == "cat:c.A AND submittedDate:[2024 TO 2025]"


def test_short_feeds_missing_articles_and_bad_answers(spark, tmp_path, site, caplog):
    options = {"endpoint": f"{site}/feed", "interval": 0, "backoff": 0}
    assert W.fetch_corpus(spark, [{"name": "one", "category": "c.A"}], str(tmp_path / "out"), papers=20, articles=options, feed=options) == 4
    assert any("one has 4 papers of 20" in r.getMessage() for r in caplog.records)
    load = lambda kind, topics, **more: spark.read.format(kind).options(topics=json.dumps(topics), **({"endpoint": f"{site}/{'feed' if 'feed' in kind else 'articles'}", "backoff": 0, "retries": 2} | more)).load().collect()
    with pytest.raises(Exception, match="no article 'Nowhere'"):
        load("harrow_articles", [{"name": "x", "titles": ["Nowhere"]}])
    with pytest.raises(Exception, match="malformed"):
        load("harrow_feed", [{"name": "x", "category": "c.bad"}])
    Server.fails = {"A": [500] * 9, "B": [404]}
    for title, tries in (("A", 3), ("B", 1)):
        Server.asked.clear()
        with pytest.raises(Exception, match="failed: HTTP Error"):
            load("harrow_articles", [{"name": "x", "titles": [title]}])
        assert len(Server.asked) % tries == 0  # the task itself may be tried again
    with pytest.raises(SourceError):
        W.Articles({"topics": "?"}).topics()
    assert len(W.Articles({"topics": json.dumps(TOPICS), "partitions": "2"}).reader(None).partitions()) == 2

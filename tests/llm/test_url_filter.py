from __future__ import annotations

import itertools
import math

import pytest

from tablewright.llm.queries import URL_RULES
from tablewright.llm.url_filter import best_split, host_and_path, label_words, url_verdicts, word_counts

URLS = [
    (1, "http://A.Example.NET/en/1?x", "net fine"), (2, "https://example.net/fr/", None), (3, "x://net/", "p"), (4, "http://example.com/de/9", "p"),
    (5, "http://sub.example.com/de", "p"), (6, "http://y.org/fr/#", "p"), (7, None, None), (8, "no scheme", ""), (9, "http://", ""), (10, "http://h?q=http://net/", ""),
    (11, "ftp://freebets.io/win/22", "free bets free bets"), (12, "http://planet/", "p"), (13, "http://É.Net/e/", "p"), (14, "http://a.net", "p"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(*u, "z") for u in URLS] + [(*URLS[0], "z")], "page_id long, url string, html string, verdict string")
    rows = url_verdicts(pages, URL_RULES).collect()
    assert len(rows) == len(URLS) + 1
    found = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert found == {
        1: ("a.example.net", "/en/1", "example.net/en/"), 2: ("example.net", "/fr/", "net/"), 3: ("net", "/", "net/"), 4: ("example.com", "/de/9", "example.com/de/"),
        5: ("sub.example.com", "/de", None), 6: ("y.org", "/fr/", "org/fr/"), 7: ("", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("h", "", None),
        11: ("freebets.io", "/win/22", None), 12: ("planet", "/", None), 13: ("É.net", "/e/", "net/"), 14: ("a.net", "", None),
    }
    verdicts = {r.page_id: r.verdict for r in rows}
    assert verdicts[1] == verdicts[6] == "allow" and verdicts[2] == verdicts[4] == "block"
    assert set(verdicts.values()) <= {"allow", "block"}
    assert url_verdicts(pages.limit(0), URL_RULES).count() == 0
    assert {r.log_odds for r in url_verdicts(pages, ()).collect()} == {0.0}


def test_naive_bayes_by_hand(spark):
    rows = [(1, "http://free.net/win/", "free net good org zz " * 9), (2, "http://free.net/win/", ""), (3, "http://good.org/fr/", ""), (4, "http://free.zz/win", "")]
    found = {r.page_id: r for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    block, allow, size = 6, 3, 6  # tokens host:free host:net path:win, twice; host:good host:org path:fr
    odds = math.log(3 / 2) + sum(math.log((b + 1) / (block + size + 1)) - math.log((a + 1) / (allow + size + 1)) for b, a in ((2, 0), (0, 0), (2, 0)))
    assert found[4].log_odds == pytest.approx(odds) and found[4].verdict == "block" and found[4].rule is None


def test_best_split_is_best_of_all():
    counts, total = {"free": 5, "bets": 3, "freeb": 1, "ets": 1, "e": 2}, 12

    def cost(words):
        return sum(math.log10(total / counts[w]) if w in counts else math.log10(total) - 1 + len(w) for w in words)

    for label in ("freebets", "xfreee", "betsfree", "q"):
        cuts = itertools.product([0, 1], repeat=len(label) - 1)
        ways = []
        for c in cuts:
            edges = [0, *(i + 1 for i, x in enumerate(c) if x), len(label)]
            ways.append([label[a:z] for a, z in zip(edges, edges[1:])])
        assert cost(best_split(label, counts, total)) == pytest.approx(min(map(cost, ways)))


LONG = "longerthanahostlabelcanbe" * 3


def test_labels_meet_counts_of_whole_pages(spark):
    pages = spark.createDataFrame([(1, "<p class=x>Free BETS, free</p>"), (2, None), (3, "<b>bets " + LONG + " bets" * 7)], "page_id long, html string")
    counts = word_counts(pages, "html")
    assert {bytes(r.word): r.n for r in counts.collect()} == {b"free": 2, b"bets": 9, LONG.encode(): 1}
    words = {"freebets": ["free", "bets"], "x" * 100: ["x" * 100], "free" + LONG + "x" * 300 + "bets": ["free", LONG, "x" * 300, "bets"], "é": ["é"]}
    labels = spark.createDataFrame([(w,) for w in words], "label string")
    assert {r.label: r.words for r in label_words(labels, counts).collect()} == words
    assert label_words(labels, counts.limit(0)).count() == len(words)
    assert host_and_path() is not None

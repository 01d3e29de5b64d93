"""HTML text and URL reputation on hand-built pages; starts of repeated ids; secrets beside plain URLs."""

import time
from collections import defaultdict

import public_tokenizers
import pytest

from sellerscope.llm import html_text, secret_scan, token_files, url_filters
from sellerscope.session import staging_path

LONG = "The river rose in the night and the people of the town went to the hill with what they had in their hands. " * 3
OTHER = "It was not until the morning that the water fell, and by then the bridge that they had built was gone for good. " * 3


def clean(text):
    return " ".join(text.split())


PAGES = {
    "plain": (f"<html><body><p>{LONG}</p></body></html>", LONG),
    "share": (f"<div class='article share-count'><p>{LONG}</p><p>{OTHER}</p></div>", LONG + "\n" + OTHER),
    "states": (f"<div class='page-with-menu has-sidebar no-comments'><p>{LONG}</p></div>", LONG),
    "menus": (f"<ul class='main-menu'><li><a href=/a>{LONG}</a></li></ul><article><p>{OTHER}</p></article><div id=sidebar-left>{LONG}</div>", OTHER),
    "comments": (f"<article><p>{LONG}</p></article><section class='comment-list'><article><p>{OTHER}</p></article></section>", LONG),
    "slash": (f"<article><p><a href=/a/>x</a> {LONG}</p><div/><p>{OTHER}</p></article>", "x " + LONG + "\n" + OTHER),
    "references": ("<article><p>caf&eacute; &lt;b&gt; &#x4e2d;&amp;\n\t tea&nbsp;pot and the rest of the line</p></article>", "café <b> 中& tea pot and the rest of the line"),
    "broken": (f"<article><p>{LONG}<p>{OTHER}</div></span>", LONG + "\n" + OTHER),
    "scripts": (f"<script>if (a < b) '</p>'</script><style>p {{}}</style><main><p>{LONG}</p><form><p>{OTHER}</p></form></main>", LONG),
    "empty": ("<div><span></span></div>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, expected = PAGES[name]
    assert html_text.main_text(page) == "\n".join(clean(line) for line in expected.split("\n"))


def test_deep_pages_take_time_in_proportion():
    page = "<div><span>" * 16_000 + f"<p>{LONG}</p>" * 200
    start = time.perf_counter()
    assert html_text.main_text(page).count("\n") == 199
    assert time.perf_counter() - start < 3


def test_page_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGES["plain"][0], "x"), (3, "u", PAGES["plain"][0], "x"), (None, "u", "<p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect()), key=str)
    text = clean(LONG)
    assert found == sorted([(1, "", 0), (2, "", 0), (3, text, len(text)), (3, text, len(text)), (None, "", 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_reputation_blocks_bad_hosts_and_spares_good_ones(spark, staged):
    """A bad host below a good domain is blocked, a good host below a bad domain is not."""
    counts = {"bad.fine.info": (95, 100), "www.fine.info": (1, 400), "a.fine.info": (0, 300), "good.poor.info": (2, 300), "x.poor.info": (180, 200), "y.poor.info": (190, 200)}
    outcomes = [(host, int(k < bad)) for host, (bad, n) in counts.items() for k in range(n)]
    outcomes = spark.createDataFrame(outcomes, "host string, bad int")
    hosts = [*counts, "new.fine.info", "new.poor.info", "elsewhere.test"]
    pages = spark.createDataFrame([(i, f"http://{h}/p?q#f") for i, h in enumerate(hosts)] + [(99, None), (98, "no scheme")], "page_id long, url string")
    found = {r["host"]: r["verdict"] for r in url_filters.judge_pages(pages, outcomes, staged).collect()}
    assert [found[h] for h in ("bad.fine.info", "x.poor.info", "y.poor.info")] == ["block"] * 3
    assert [found[h] for h in ("www.fine.info", "a.fine.info", "good.poor.info", "new.fine.info")] == ["allow"] * 4


def test_rules_and_empty_tables_of_urls(spark, staged):
    outcomes = spark.createDataFrame([], "host string, bad int")
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/a", "http://example.com/de/x?y", "ftp://sub.example.com/de", "http://b.org/fr/", "x", None, "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_pages(pages, outcomes, staged).collect()}
    assert found[0] == ("a.net", "/x", "net/", "block") and found[1] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert found[2] == ("example.com", "/de/x", "example.com/de/", "block") and found[3][2] is None
    assert found[4] == ("b.org", "/fr/", "org/fr/", "allow") and found[5] == ("", "", None, "allow") and found[6] == ("", "", None, "allow")
    assert url_filters.judge_pages(pages.limit(0), outcomes, staged).collect() == []


def test_starts_follow_the_written_order_of_repeated_ids(documents, staged, spark):
    rows = [(1, "a b c d"), (1, "b"), (1, "c d"), (1, "d e f g h"), (0, "x"), (2, "y z"), (None, "null id")]
    path = staging_path(spark, "token-files")
    token_files.write_token_files(documents(rows), public_tokenizers.path("byte_bpe_50k.json"), path)
    tokens = token_files.read_token_files(spark, path)
    found = token_files.token_file_index(tokens, staged).collect()
    written = defaultdict(list)
    for r in tokens.coalesce(1).collect():
        written[r["doc_id"]].append(len(r["ids"]))
    at, expected = 0, []
    for i in (None, 0, 1, 2):
        for n in written[i]:
            expected.append((i, at, n))
            at += n
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in found), key=lambda x: x[1]) == expected


def test_plain_urls_are_no_secrets(documents, staged):
    url = "https://news.example.com/2024/03/some-article-title-here"
    texts = {1: f"see {url}", 2: f"see {url} user=bob", 3: f"{url} key 9f8Ab3dE5gH7jK1mN3pQ5"}
    found = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in secret_scan.find_secrets(documents(texts.items()), staged).collect()}
    assert found[1] == [] and found[2] == [] and found[3] == ["blob"]

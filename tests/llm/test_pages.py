"""Whole pages: blocks, templates of part of a host's pages, and text that has to stay."""

from __future__ import annotations

from parlance.llm import html, queries


def test_query_joins_blocks_by_two_line_breaks(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example/", "<h1>T</h1><p>a<br>b<p>c")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = queries.op7_html_extraction(spark, str(tmp_path)).first()
    assert row.text == "T\n\na b\n\nc" and row.n_chars == 9


LAYOUT = "<html><body><div class=top>Welcome to our paper</div>{1}<div>{0} has its own story</div><div>All rights reserved</div></body></html>"
SECOND = "<html><body><section>From our readers<b>Letters of the week</b></section><p>letter {0} of a reader</p><section>Write to us</section></body></html>"
NOTICE = "<div class=info><b>Now at a lower price</b><i>Only this month</i></div>"


def extracted(spark, pages, url="http://a.example/"):
    rows = [(k, url, page) for k, page in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_blank_and_odd_pages_leave_the_template(spark):
    pages = [LAYOUT.format(f"page {k}", "") for k in range(12)]
    assert extracted(spark, [*pages, None, "", "<p>an odd page"]) == [f"page {k} has its own story" for k in range(12)] + ["", "", "an odd page"]


def test_each_class_counts_on_the_pages_that_hold_it(spark):
    pages = [LAYOUT.format(f"page {k}", NOTICE if k % 2 else "") for k in range(10)] + [SECOND.format(k) for k in range(5)]
    assert extracted(spark, pages) == [f"page {k} has its own story" for k in range(10)] + [f"letter {k} of a reader" for k in range(5)]


def test_small_hosts_have_templates_and_copies_keep_their_text(spark):
    assert extracted(spark, [LAYOUT.format(f"page {k}", "") for k in range(4)]) == [f"page {k} has its own story" for k in range(4)]
    story = "<p>It was a long day by the sea.</p><p>Nobody had seen the boats come in, and the wind was cold.</p><p>{}</p>"
    near = [story.format(k) for k in range(4)]
    assert [t.count("\n") for t in extracted(spark, [*near, *[LAYOUT.format(f"page {k}", "") for k in range(9)]])[:4]] == [2] * 4
    assert [t.count("\n") for t in extracted(spark, [story.format("x")] * 9)] == [2] * 9


def test_text_that_has_to_stay():
    read = lambda page: html.main_text(page, {})
    assert read("<html><head><title>no</title><meta charset=utf-8><body><p>a") == read("<html><head><title>no</title><p>a") == read("<head>a") == "a"
    assert read("<html>a<p>b</p></html>") == "a\nb" and read("<html><body><p>a</p></body>b</html>") == "a\nb"
    assert read("<p>a<button>b<p>c<svg><p>d<select><p>e") == "a\nb\nc\nd\ne"
    assert read("<p>a<p><button>b</button><svg><text>c</text></svg><select><option>d</select><p>e") == "a\ne"
    assert read("<button>" * 3 + "a</button><p>b") == "b"
    assert read('<h1 class="header">a</h1><svg><g></svg>b<svg></svg>c') == "a\nb\nc"
    main = '<article><h2 id="market-share">a</h2><section id="related-work"><p class="social-order">b</p></section><div class="share">c</div><p>d</article>'
    assert read(main) == "a\nb\nd" and read('<h2 id="market-share">a</h2><section id="related-work">b</section><section id=comments>c</section>') == "a\nb"
    assert read("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be") == "let x=1 be"
    assert read("<h1>a</h1><article><p>b</article><p>c") == "a\nb\nc"


def test_tokens_that_move_about_are_no_template(spark):
    """A line of every second page stands in one gap of the layout, or in another gap on each page."""
    line = "<p>Heard in the street</p>"
    body = "<html><body><div class=top>Welcome to our paper</div>{0}<div><i>own {3}</i></div>{1}<h4>More from us</h4>{2}<div>All rights reserved</div></body></html>"
    at = lambda k, place: [line if k % 2 and i == place else "" for i in range(3)]
    assert extracted(spark, [body.format(*at(k, 1), k) for k in range(12)]) == [f"own {k}" for k in range(12)]
    assert extracted(spark, [body.format(*at(k, k // 2 % 3), k) for k in range(12)]) == [f"own {k}" if k % 2 == 0 else f"Heard in the street\nown {k}" if k // 2 % 3 == 0 else f"own {k}\nHeard in the street" for k in range(12)]


def test_gaps_of_classes():
    template = {1: 0, 2: 1, 3: 2, 7: 1 << 32, 8: 1 << 32 | 1}
    assert sorted(html.gaps([1, 7, None, 8, 2, 3, 8], template)) == [(7, 0, 1), (8, 0, 1)]
    assert sorted(html.gaps([7, 1, 2, 8, 3], template)) == [(7, 0, 0), (8, 0, 2)] and not list(html.gaps([None, 5], template))


def test_hosts_around_eight_pages_and_repeated_pages(spark):
    for n in (3, 7, 8):
        assert extracted(spark, [LAYOUT.format(f"page {k}", "") for k in range(n)]) == [f"page {k} has its own story" for k in range(n)]
    rows = [(k % 5, "http://a.example/", LAYOUT.format(f"page {k % 5}", ""), 1, "x") for k in range(10)] + [(None, "http://a.example/", None, 1, "x")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, tokens int, host string")).collect()
    assert sorted(r.text for r in out) == ["", *sorted(f"page {k % 5} has its own story" for k in range(10))]

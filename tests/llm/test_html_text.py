import html
import random
import re
from collections import Counter

import pyspark.sql.functions as F

from pageloom.llm import html_text as H

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_whole_table_against_the_article_element(spark):
    """Every page of the table has one article of h1 and p blocks, which a short pattern can cut out."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = H.digest(pages).collect()
    assert len(got) == len(source)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?:b|br)>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def stripped(page):
    """The page without any landmark: elements of a role become div, classes go."""
    page = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main)\b", r"<\1div", page)
    return re.sub(r' (?:class|id)="[^"]*"', "", page)


def test_pages_stripped_of_landmarks(spark):
    """Precision and recall of article lines where no element or class tells what is an article."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{LARGE}/pages.parquet").collect()]
    pages = spark.createDataFrame([(i, u, stripped(h)) for i, u, h in rows], "page_id long, url string, html string")
    right = told = wanted = 0
    source = {i: h for i, _, h in rows}
    for r in H.extract(pages).collect():
        want, got = H.text_of(H.page_lines(source[r.page_id])).split("\n"), r.text.split("\n")
        same = sum((Counter(want) & Counter(got)).values())
        right, told, wanted = right + same, told + len(got), wanted + len(want)
    print(f"line precision {right / told:.3f}, recall {right / wanted:.3f}")
    assert right / told >= 0.9 and right / wanted >= 0.9


def test_differencing_deletes_lines_of_the_given_pages(spark):
    got = H.extract(spark.read.parquet(f"{LARGE}/pages.parquet")).collect()
    n, lines = sum(r.n_deleted > 0 for r in got), sum(r.n_deleted for r in got)
    print(f"{lines} lines deleted on {n} of {len(got)} pages")
    assert n >= 0.4 * len(got)  # the pages of a host draw their menus and notices from many


def test_parts_that_are_no_article():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
    <div class="cookie-notice">We use <b>cookies</b></div><article class="post"><header><h1>The &amp; title</h1></header>
    <p>One <em>two</em>
       three<br>four &#233;&lt;</p><aside>side</aside><div class="ad">Buy</div><p>five<script>var a="</p>";</script> six<form><input>send</form>
    <ul><li>a</li><li>b</li></ul><section id="comments"><p>reader</p></section></article><footer>foot</footer>tail</body></html>"""
    text = lambda page, gone=(): H.text_of(H.page_lines(page), set(gone))
    assert text(page) == "The & title\nOne two three four é<\nfive six\na\nb"
    assert text("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>end") == "1 < 2 and 3 > 2\nend"
    assert text("a<p>b<!-- never closed <p>c") == "a\nb"
    assert text("<p>b</p><div cla") == "b" and H.page_lines("") == []
    assert text("<main><p class='ad'>no</p><p>yes</main>") == "yes"
    assert text('<div title="a > b">x</div>') == "x"
    parts = ("adBox", "ADS", "site-notice", "comment-list", "commentlist", "cookie_banner", "right-sidebar", "newsletter-signup", "main-menu", "related posts")
    for part in parts:
        assert text(f'<div class="{part}"><p>no</p></div><article><p>yes<div id="{part}">no</div></p></article>') == "yes"
    assert text('<div class="story-body"><p>a shadow</p></div><form><p>no</p></form>') == "a shadow"
    assert text("<p>x</p><a " + 'b="c" ' * 5000) == "x"


def test_what_is_kept_of_an_article():
    text = lambda page, gone=(): H.text_of(H.page_lines(page), set(gone))
    assert text("<article><p>The area is <math><mi>x</mi></math> units<svg/> and <svg><title>t</title></svg>more <object>this</object></p></article>") == "The area is x units and more this"
    for wrapper in ('div class="has-sidebar"', 'section class="with-comments no-ads"', "form", 'div class="page"'):
        assert text(f"<{wrapper}><article><h1>a</h1><p>b</p></article></{wrapper.split()[0]}>") == "a\nb"
    assert text("<form><p>all the page</p><label>no</label></form>") == "all the page"
    assert text("<article><p>a</p><article class='comment'><p>reader</p></article></article>") == "a"
    # a text block in doubt stays unless other pages share it; article lines are never deleted
    doubt = "<article><p>a</p><p class='note-alert'>b</p><p class='share'>c</p></article>"
    assert text(doubt) == "a\nb\nc" and text(doubt, [0, 2]) == "a\nb"
    # pages without an article: runs of links and rights are no text; a page never loses all
    open_page = "<div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><p>text with a <a>link</a></p><p><a>one link</a></p><p>© 2020 us</p>"
    assert text(open_page) == "text with a link\none link"
    assert text("<p>a</p><p>b</p>", [0]) == "b" and text("<p>a</p><p>b</p>", [0, 1]) == "a\nb"


def test_common_is_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        for most in (1 << 28, 4):
            got = H.common(a, b, most)
            assert len(got) == n[-1][-1] and got == sorted(set(got))
            it = iter(b)
            assert all(a[i] in it for i in got)


def story(k):
    return " ".join(f"w{k}x{j}" for j in range(12))


def test_nearest_page_differencing(spark):
    def page(own, host="h", more=""):
        return f"<body><div>{host} home</div><p>{own}</p><p>and more of {own}</p>{more}<div>all rights of {host} and others</div></body>"

    def text(own, more=""):
        return f"{own}\nand more of {own}{more}"

    rows = [(k, f"http://h.example.com/a/{k:03}", page(story(k))) for k in range(40)]
    want = {k: text(story(k)) for k in range(40)}
    rows += [(50 + k, "http://h.example.com/a/020" + "/copy" * k, page(story(20))) for k in range(30)]  # copies, some of one URL
    want |= {50 + k: text(story(20)) for k in range(30)}
    rows += [(100 + k, f"http://h.example.com/a/03{k:02}", page(story("n"), more=f"<p>edited {k}</p>")) for k in range(40)]  # near copies
    want |= {100 + k: text(story("n"), f"\nedited {k}") for k in range(40)}
    rows += [(200, "http://other.example.com/x", page("alone", "o"))]
    want[200] = "o home\nalone\nand more of alone\nall rights of o and others"
    rows += [(300, "http://copy.example.com/1", page("same", "c")), (301, "http://copy.example.com/2", page("same", "c"))]
    want |= dict.fromkeys((300, 301), "c home\nsame\nand more of same\nall rights of c and others")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.page_id: r.text for r in H.digest(pages).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_buckets_change_nothing(spark):
    """Shared lines found bucket by bucket are those of each host's pages in one list, also where buckets are small."""
    rng = random.Random(4)
    rows = [("ab"[k % 5 == 0], f"/{k:03}", [rng.randint(0, 30) for _ in range(rng.randint(1, 6))]) for k in range(150)]
    rows = sorted({(h, tuple(x)): (h, p, x) for h, p, x in reversed(rows)}.values(), key=lambda r: r[:2])
    want = {(h, p): sorted(g) for (h, p, x), g in zip(rows, H.differences([(h, x, [0] * len(x)) for h, _, x in rows], 3)) if g}
    frame = spark.createDataFrame([(h, p, k, k, 1, x, [0] * len(x)) for k, (h, p, x) in enumerate(rows)], "host string, path string, one long, two long, n long, lines array<long>, sizes array<int>")
    for bucket in (4, 50, 1000):
        got = {rows[r.one][:2]: r.gone for r in H.shared_lines(frame, 3, 3, bucket).collect()}
        assert got == want


def test_differences_against_all_earlier_and_later_pages():
    """Where no page is a copy, each page loses what a common subsequence with its nearest pages holds."""
    rng = random.Random(2)
    for _ in range(40):
        pages = [("h", [rng.randint(0, 12) for _ in range(rng.randint(0, 5))], [0] * 5) for _ in range(9)]
        pages = [(h, x, s[: len(x)]) for h, x, s in pages]
        got = H.differences(pages, 2)
        for k, (_, lines, _) in enumerate(pages):
            near = [pages[j][1] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(pages)]
            assert got[k] == set().union(*(H.common(lines, x) for x in near))


def test_defined_results(spark):
    rows = [(1, None, None), (2, "http://a/b", ""), (2, "http://a/b", ""), (None, "::bad[", "<p>x"), (3, None, "<p>" + "word " * 100_000 + "<p>end")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("q"))
    got = sorted((str(r.page_id), r.n_chars) for r in H.digest(pages).collect())
    assert got == [("1", 0), ("2", 0), ("2", 0), ("3", 500_003), ("None", 1)]
    assert H.digest(pages.limit(0)).collect() == []

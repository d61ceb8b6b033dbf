import json
import random
import re
import time
from collections import Counter
from html import unescape

from dayloom.llm import pages


def by_pattern(html):
    """The article of the given pages, whose markup is known."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.DOTALL).group(1)
    blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_text(frame).collect()}
    for r in frame.collect():
        text = by_pattern(r["html"])
        assert got[r["page_id"]] == (text, len(text))


def page(body, host="a.example", k=0):
    return (k, f"https://{host}/{k}", f"<html><head><title>t</title></head><body>{body}</body></html>")


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.main_text(frame).collect()}


def test_article_without_its_surroundings(spark):
    body = ("<header>Site</header><nav><a>Home</a></nav><main><article><h1>Head&amp;line</h1><p>One <b>bold\n word<p>Two"
            "<ul><li>x<li>y</ul><div class='adBox ad-slot'>Buy</div><aside>Side</aside><form>Mail <input></form><script>s()</script>"
            "<section id=comments><p>First!</p></section><div class=notice>We use cookies</div></article></main><footer>F</footer>")
    assert texts(spark, [page(body)]) == {0: "Head&line\nOne bold word\nTwo\nx\ny"}


def test_template_is_learnt_where_no_element_names_the_content(spark):
    rows = [page(f"<div>Welcome to our site</div><div><h3>Always here</h3><p>Story number {k} goes on for long. {'word ' * k}</p></div>"
                 "<div>All about us</div>", k=k) for k in range(1, 6)]
    got = texts(spark, rows)
    assert all(got[k] == f"Story number {k} goes on for long. {'word ' * k}".strip() for k in range(1, 6))


def test_equal_pages_of_a_host_keep_their_article(spark):
    rows = [page("<article><p>Same text on each page</p></article>", k=k) for k in range(4)]
    assert set(texts(spark, rows).values()) == {"Same text on each page"}


def test_edge_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (1, None, None), (2, "http://h/", ""), (3, None, "<p>free text"), (None, "x", "a < b & c"),
            (4, "http://h/", long), (5, "http://h/", "<div " * 50), (6, "http://h/", "<article><p>x<!-- open")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host_", "2 as pivot")
    got = Counter((r["page_id"], r["text"][:20]) for r in pages.main_text(frame).collect())
    assert got[1, ""] == 2 and got[2, ""] == 1 and got[4, ("word & word\n" * 3)[:20]] == 1 and got[6, "x"] == 1
    assert sum(got.values()) == len(rows)
    assert pages.main_text(frame.limit(0)).count() == 0


def test_tree_matching():
    a, b = (pages.encode_tree(pages.parse(h)[0]) for h in (
        "<body><div><p>x</p></div><section><p>y</p></section></body>",
        "<body><nav>n</nav><div><h1>t</h1><p>x</p></div><section><p>y</p></section></body>"))
    size, pairs = pages.match(a, b)
    assert size == 6 and len(pairs) == 6


def brute_match(a, b):
    """Size of the largest match, by the recursive definition."""
    below = [[[c for c, p in enumerate(t[2]) if p == n] for n in range(len(t[0]))] for t in (a, b)]

    def size(x, y):
        if (a[0][x], a[1][x]) != (b[0][y], b[1][y]):
            return 0
        xs, ys = below[0][x], below[1][y]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, c in enumerate(xs, 1):
            for j, d in enumerate(ys, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size(c, d))
        return best[-1][-1] + 1

    return size(0, 0)


def test_tree_matching_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        trees = []
        for _ in range(2):
            n = rng.randint(1, 14)
            trees.append([["#"] + [rng.choice("ab") for _ in range(n)], [0] * (n + 1), [-1] + [rng.randint(0, k) for k in range(n)]])
        size, pairs = pages.match(*trees)
        assert size == brute_match(*trees) == len(pairs) == len(dict(pairs)) == len({y for _, y in pairs})
        up = dict(pairs)
        for x, y in pairs:
            assert trees[0][0][x] == trees[1][0][y]
            assert x == 0 or up[trees[0][2][x]] == trees[1][2][y]


def test_deep_nesting_and_open_tags_are_linear(spark):
    deep = "<div>" * 10_000 + "in the depth"
    other = "<div>" * 9_000 + "<p>less deep</p><section>x</section>"
    began = time.monotonic()
    got = texts(spark, [page(deep, k=0), page(deep + "er", k=1), page(other, k=2), page("<p>end" + "<a " * 3_000_000, k=3),
                        page("<p><button>" + "<div>" * 20_000 + "y", "c.example", 4), page("<a '><a \"" * 100_000 + "z", "c.example", 5),
                        page("<p>x" + "<!" * 500_000, "c.example", 6)])
    assert got[0] == "in the depth" and got[3] == "end" and got[4] == "" and got[6] == "x"
    assert time.monotonic() - began < 60


def test_open_quotes_end_with_the_tag(spark):
    assert texts(spark, [page('<article><p title="a>Hello</p></article>')]) == {0: "Hello"}


def test_aligned_votes_decide(spark, monkeypatch):
    """Without an article: constant nodes around the story go, though pages differ in what stands before it."""
    own = [f"Story number {k} has a text of its own, long enough to be told {k}" for k in range(6)]
    promo = "<article><h2>Join the club today</h2></article>"
    rows = [page(f"{'<table><tr><td>Top</table>' if k % 2 else ''}<div class=box><h3>Daily page</h3></div>"
                 f"<div class=story><h1>Title {k}</h1><p>{t}</p><p>Read us daily</p></div>", k=k) for k, t in enumerate(own)]
    # The article is the same everywhere and the story stands beside it.
    rows += [page(f"{promo}<div class=story><p>{t}</p></div>", "b.example", 10 + k) for k, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["rule"]) for r in pages.main_text(frame).collect()}
    assert [got[k] for k in range(6)] == [(f"Title {k}\n{t}", "votes") for k, t in enumerate(own)]
    assert [got[10 + k] for k in range(6)] == [(t, "votes") for t in own]
    # The same wrapper without alignment: everything of the page stays.
    wrappers, _ = pages.induce(frame, pages.Scratch(spark, "pages_test"))
    w = wrappers.filter("host_ = 'a.example'").first()
    template = frozenset((t["node"], t["hash"]) for t in w["template"])
    assert pages.extract(rows[1][2], json.loads(w["pivot"]), w["content"], template) == got[1]
    monkeypatch.setattr(pages, "match", lambda a, b: (0, []))
    text, rule = pages.extract(rows[1][2], json.loads(w["pivot"]), w["content"], template)
    assert rule == "elements" and "Read us daily" in text and "Daily page" in text


def test_hot_hosts_meet_the_wrapper_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pages, "PART_PAGES", 3)
    rows = [page(f"<div><p>Story {k} is long enough {'word ' * k}</p><p>Always the same</p></div>", k=k) for k in range(1, 21)]
    got = texts(spark, rows)
    assert len(got) == 20 and all(got[k] == f"Story {k} is long enough {'word ' * k}".strip() for k in got)


def test_marked_elements_fold_apart(spark):
    body = ("<article><p>One<p hidden>no<p>Two<h2>A</h2><h2 id=search>no</h2><h3 id=related>no</h3><h3>B</h3>"
            "<ul><li>x<li style='display: none'>no<li>y</ul></article>")
    assert texts(spark, [page(body)]) == {0: "One\nTwo\nA\nB\nx\ny"}
    rows = "".join(f"<div{' hidden' if k == 11 else ''}>{k}</div>" for k in range(14))
    assert texts(spark, [page(f"<article>{rows}</article>")])[0].split() == [str(k) for k in range(14) if k != 11]


def test_named_wrappers_do_not_cover_the_content(spark):
    body = ("<div class='layout-with-sidebar'><article><p>Text</p><div class='ad'>Buy</div></article>"
            "<div class='related'><article>Card</article></div><div class='sidebar'>Side</div></div>")
    assert texts(spark, [page(body)]) == {0: "Text"}
    assert texts(spark, [page("<div id='page-nav-top'><main><p>Text</p></main></div>")]) == {0: "Text"}
    assert texts(spark, [page("<main><div class='has-sidebar'><article><p>Text</p></article></div></main>")]) == {0: "Text"}
    body = "<main><p>The post</p><div class='comments'><article class='comment'>A longer comment</article></div></main>"
    assert texts(spark, [page(body)]) == {0: "The post"}
    assert texts(spark, [page("<div hidden class='menu'><article>No</article></div><article>Yes</article>")]) == {0: "Yes"}


def test_votes_decide_inside_articles(spark):
    note = "<p>Support our work with a gift</p>"
    own = [f"Story number {k} has a text of its own, long enough to be told" for k in range(5)]
    rows = [page(f"<article><p>{t}</p>{note if k else ''}</article>", k=k) for k, t in enumerate(own)]
    # Two pages of another host do not agree on anything.
    rows += [page(f"<article><p>{own[k]}</p>{note}</article>", "b.example", 10 + k) for k in range(2)]
    got = texts(spark, rows)
    assert [got[k] for k in range(5)] == own
    assert got[10] == own[0] + "\nSupport our work with a gift"
    # Without an article: a constant paragraph between varying ones, missing on one page.
    rows = [page(f"<div><p>{t}</p>{note if k else ''}<p>{t[::-1]}</p></div>", k=k) for k, t in enumerate(own)]
    assert [texts(spark, rows)[k] for k in range(5)] == [f"{t}\n{t[::-1]}" for t in own]


def test_near_copies_keep_their_article(spark):
    rows = [page(f"<article><p>{'The same long text on every page. ' * 5}</p><p>Copy {k}</p></article>", k=k) for k in range(4)]
    assert all(len(t) > 100 for t in texts(spark, rows).values())

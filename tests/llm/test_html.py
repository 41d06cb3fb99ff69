from __future__ import annotations

import time

import pytest

from viewloom.llm import op8_html as H


def page(main, host="a.com", body=None):
    body = body if body is not None else f"<article>{main}</article>"
    return (
        f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> -->'
        f'<div class="ad">Buy</div>{body}<footer>&copy; {host}</footer></body></html>'
    )


def one(html):
    return H.main_text(html, None)


def test_article():
    assert one(page("<h1>A &amp; B</h1><p>One\n  two&nbsp;three.</p><p><b>Bold</b> i<i>t</i>.<br><p>Next")) == "A & B\nOne two three.\nBold it.\nNext"


def test_furniture_inside():
    inner = '<h1>T</h1><p>a</p><aside>side</aside><div class="share-buttons">share</div><form><p>f</p></form><p>b</p><section id="comments"><article class="comment"><p>c</p></article></section><script>x<p>y</p></script><div class="cookie-notice">ok</div>'
    assert one(page(inner)) == "T\na\nb"


def test_markup():
    assert one(page("<p>1 &lt; 2 &#233;&#x1F600; &unknown; a<b</p>")) .startswith("1 < 2 é😀 &unknown; a")
    assert one(page("<P CLASS='x>y'>up</P><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>")) == "up\none\ntwo\nc1\nc2"
    assert one(page('<p>see <a href="x">this</a> now<img alt="p"> ok</p>')) == "see this now ok"


def test_unclosed():
    assert one("<html><body><nav><ul><li>Home<article><p>a<p>b<footer>f") == "a\nb"
    assert one("<article><p>a") == "a"
    assert one("text only") == "text only"
    for html in ("", "<", "<p", "<!--", "<script>", "&", "</p></div>", "<>"):
        assert isinstance(one(html), str)


def test_main_and_role():
    assert one('<body><header>h</header><div role="main"><p>m</p></div></body>') == "m"
    assert one('<body><main><p>m</p><nav>n</nav></main></body>') == "m"


def test_headers_and_wrappers():
    assert one('<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>a</p></article></body>') == "Title\na"
    assert one('<body><div class="content with-sidebar"><article><p>a</p></article></div><section class="related"><article><h2>Other</h2></article></section></body>') == "a"
    assert one('<article><h2 class="header">T</h2><p>a</p><ol class="comments"><li><article><p>c</p></article></li></ol><p>b</p></article>') == "T\na\nb"


def test_density_without_marks():
    body = '<div id="top"><p><a href="/">Home</a> <a href="/b">B</a></p></div><div id="x"><p>Long text of the page.</p><p>More text here.</p></div><div class="sidebar"><p>Side text that is rather long as well, yes indeed it is.</p></div>'
    assert one(page("", body=body)) == "Long text of the page.\nMore text here."


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string").repartition(3)


def test_template_of_a_host(spark):
    def made(i):
        boiler = "<div><p>We are a shop with a long welcome text that stands on every page of this site, always the same.</p></div>"
        return page("", body=f"{boiler}<div><p>Story {i} tells.</p><p>It ends at {i}.</p></div><div><p>Bye</p></div>")

    rows = [(f"https://a.com/{i}", made(i)) for i in range(6)]
    # The three containers share their role: the text of all is the slot, and no text is lost.
    out = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert all(f"Story {i} tells.\nIt ends at {i}." in out[i] for i in range(6))

    def marked(i):
        return page("", body=f'<div class="w"><p>The same long welcome text on every page of the host, which no one reads, but it is long.</p></div><div class="b"><p>Story {i}.</p></div>')

    out = {r["page_id"]: r["text"] for r in H.extract(pages(spark, [(f"https://b.com/{i}", marked(i)) for i in range(6)])).collect()}
    assert out == {i: f"Story {i}." for i in range(6)}


def test_classes():
    rows = [dict(path=H.ROOT.path, parent=0, pages=4, vector=1, text=0, links=0, same=False), dict(path=11, parent=H.ROOT.path, pages=4, vector=1, text=0, links=0, same=False), dict(path=12, parent=11, pages=4, vector=2, text=400, links=0, same=False), dict(path=13, parent=11, pages=4, vector=1, text=900, links=0, same=True), dict(path=14, parent=99, pages=4, vector=3, text=0, links=0, same=False), dict(path=15, parent=11, pages=1, vector=4, text=9, links=0, same=False)]
    t = H.deduce(rows, 4)
    assert t.tokens == {H.ROOT.path, 11, 12, 13} and t.fixed == {13} and t.mains == (11,)


def test_deduction_by_brute_force(spark):
    """Classes by whole occurrence vectors, compared pairwise, give the tokens, fixed slots and containers that the aggregation gives."""
    htmls = [page("", body=f'<div class="w{i % 2}"><p>Same on all.</p><div id="post-{i}" class="post post-{i}"><h1>T{i}</h1>{"<p>x y z</p>" * (i % 3)}<ul><li>a {i}</li></ul></div></div><div class="z"><p>end {i % 4}</p></div>') for i in range(8)]
    stats = [H._page_stats(x) for x in htmls]
    paths = {p for s in stats for p in s}
    vector = {p: tuple(s.get(p, [0, 0])[1] for s in stats) for p in paths}
    support = {p: sum(map(bool, v)) for p, v in vector.items()}
    parent = {p: s[p][0] for s in stats for p in s}
    kept = {p for p in paths if support[p] >= max(2, H.MIN_SUPPORT * len(htmls))}
    inside = {H.ROOT.path}
    while new := {p for p in kept - inside if parent[p] in inside}:
        inside |= new
    fixed = {p for p in inside if support[p] >= 3 and len({s[p][4] for s in stats if p in s}) == 1}
    rows = [(f"https://a.com/{i}", x) for i, x in enumerate(htmls)]
    host = H.templates(pages(spark, rows)).first()
    tokens = [r.asDict() for r in host["tokens"]]
    t = H.deduce(tokens, host["host_pages"])
    assert host["host_pages"] == len(htmls) and t.tokens == inside and t.fixed == fixed
    same = {(a["path"], b["path"]) for a in tokens for b in tokens if a["vector"] == b["vector"]}
    assert same == {(a, b) for a in kept for b in kept if vector[a] == vector[b]}


def test_all_heavy_slots_and_layouts(spark):
    rows = [(f"https://a.com/{i}", page("", body=f'<div id="post-{i}" class="post"><h1>Title {i} of it</h1><p>Lead {i} text.</p><div class="body"><p>Body {i} text is longer.</p></div><ul><li>point {i} is here</li></ul></div>')) for i in range(4)]
    rows += [(f"https://a.com/x{i}", page("", body=f'<div class="story"><p>Other layout {i} with its own long text, quite long.</p></div>')) for i in range(4)]
    out = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert [out[i] for i in range(4)] == [f"Title {i} of it\nLead {i} text.\nBody {i} text is longer.\npoint {i} is here" for i in range(4)]
    assert [out[4 + i] for i in range(4)] == [f"Other layout {i} with its own long text, quite long." for i in range(4)]


def test_words_in_classes():
    assert one('<body><article class="post category-social format-aside no-sidebar"><p class="social">a</p><p class="alert">b</p><p class="ad">c</p></article></body>') == "a\nb"
    assert one('<body><div class="form"><p>The page stands in a form, as some systems make it.</p></div><div class="site-footer"><p>f</p></div></body>') == "The page stands in a form, as some systems make it."


@pytest.mark.parametrize("html", ["<a " * 340_000, "<a href='" * 120_000, "<!--" * 250_000, "<b>" * 300_000, "</p>" * 250_000, "<div>" * 30_000 + "</b>" * 100_000, "<script" * 140_000, "<b>" * 100_000 + "x<p></p>" * 50_000, "&" * 1_000_000])
def test_malformed_pages_are_linear(html):
    began = time.perf_counter()
    one(html)
    assert time.perf_counter() - began < 15


def test_unended_tags_take_under_a_second():
    began = time.perf_counter()
    one("<a " * 340_000)
    assert time.perf_counter() - began < 1


def test_marked_pages_are_extracted_by_the_template(spark):
    same = '<p class="note">This note stands in the article of every page.</p><ul class="more"><li><a href="/x">Read {0} and more</a></li></ul>'
    rows = [(f"https://a.com/{i}", page(f"<h1>Title {i}</h1><p>Story {i}.</p>{same.format(i)}")) for i in range(5)]
    rows.append(("https://one.com/", page("<p>Story.</p>" + same)))  # no template: the mark as it is
    out = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert [out[i] for i in range(5)] == [f"Title {i}\nStory {i}." for i in range(5)]
    assert out[5].startswith("Story.\nThis note stands")


def test_copies_are_one_page(spark):
    def plain(i):
        return page("", body=f'<div class="w"><p>Hello.</p></div><div class="b"><p>Story {i}.</p></div>')

    rows = [("https://copies.com/", plain(0))] * 5 + [("https://most.com/", plain(0))] * 9 + [(f"https://most.com/{i}", plain(i)) for i in (1, 2)]
    rows += [(f"https://foot.com/{i}", page("", host=f"{i}.com", body='<div class="b"><p>One story.</p></div>')) for i in range(4)]
    out = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert all("Story 0." in out[i] for i in range(5))
    assert [out[i] for i in range(5, 16)] == ["Story 0."] * 9 + ["Story 1.", "Story 2."]
    assert [out[i] for i in range(16, 20)] == ["One story."] * 4


def test_query_rows(spark):
    rows = [("https://a.com/1", page("<p>x</p>")), ("https://a.com/1", page("<p>x</p>")), (None, None), ("odd url", ""), ("https://A.com:80/2", page("<p>" + "long " * 50_000 + "</p>")), ("https://u@a.com/3", page(""))]
    out = {r["page_id"]: r for r in H.extract(pages(spark, rows)).collect()}
    assert [out[i]["text"] for i in (0, 1, 2, 3, 5)] == ["x", "x", "", "", ""]
    assert out[4]["n_chars"] == 5 * 50_000 - 1 and out[2]["n_chars"] == 0 and out[2]["url"] is None
    assert H.extract(pages(spark, rows).filter("false")).count() == 0
    hosts = {r["page_id"]: r["h"] for r in pages(spark, rows).select("page_id", H.host_of().alias("h")).collect()}
    assert hosts == {0: "a.com", 1: "a.com", 2: "", 3: "", 4: "a.com", 5: "a.com"}

import json

from parley.llm import html
from parley.llm.html import Wrapper, expression, host_wrappers, inferred, main_texts, page_tree

MENU = "<nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav>"
FOOT = "<footer>&copy; me &middot; all</footer></body></html>"


def page(body, head="t"):
    return f"<!DOCTYPE html><html><head><title>{head}</title><script>var t='</p>';</script></head><body>{MENU}{body}{FOOT}"


ARTICLES = [
    ("<div class='ad'>Buy</div><article><h1>One &amp;&amp</h1><p><b>a  b<br><p>c\n d</article>", "One &&\na b\nc d"),
    ("<article><header>By me</header><p>x</p><div class='user-comments'>no</div><ul><li>1<li>2</ul></article>", "x\n1\n2"),
    ("<main><p>p &lt;b&gt; &#233;&nbsp;q<!-- c --></p><form><p>f</p></form><aside>s</aside></main>", "p <b> é q"),
    ("<article><p>left open", "left open"),
    ("<article></article>", ""),
]
PLAIN = [
    f"<div class='wrap'><div class='notice-box'>Cookies</div><div class='body'><h2>Title {k}</h2>"
    + "".join(f"<p>Text {k} {j} that is longer than the rest of it.</p>" for j in range(k + 2))
    + "</div><div class='end'>Share this</div></div>"
    for k in range(4)
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/x", page(b)) for k, (b, _) in enumerate(ARTICLES)]
    rows += [(10 + k, "https://u@plain.example:80/p", page(b)) for k, b in enumerate(PLAIN)]
    rows += [(20, None, None), (21, "not a url", ""), (22, "http://h/", "no markup < 3 &am"), (None, "http://h/", "<p>x"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS h")
    got = main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    for k, (_, text) in enumerate(ARTICLES):
        assert texts[k] == text
    for k in range(4):
        lines = [f"Text {k} {j} that is longer than the rest of it." for j in range(k + 2)]
        assert texts[10 + k] == "\n".join([f"Title {k}", *lines])
    assert (texts[20], texts[21], texts[22], texts[None]) == ("", "", "no markup < 3 &am", "x")


def test_wrapper_has_slots_options_and_repeats():
    pages = ["<div><h1>A</h1><p>x</p><p>y</p></div>", "<div><h1>A</h1><i>n</i><p>z</p><table><tr><td>1</td></tr></table></div>"]
    found = inferred(pages)
    text = expression(found)
    assert "<h1>'A'</>" in text and "(<p>#</>)+" in text and "(<table>" in text and text.count(")?") == 2


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "x" + "</section>" + "<" * 50 + '<a href="' + "<p>" * 3000
    assert Wrapper(inferred([deep]), 1).main_text(deep).startswith("x")
    assert page_tree("<!-- open").kids == []


def test_no_pages(spark):
    assert main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def text_of(source):
    return Wrapper(inferred([source]), 1).main_text(source)


def test_text_and_noise_behind_and_below_a_deep_nest():
    nest = "<div>" * 200 + "in<aside><p>menu</p></aside>" + "</div>" * 200
    assert text_of(page(f"<div><article>{nest}<p>rest</p></article></div>")) == "in\nrest"
    open_divs = "<div>x" * 3000
    assert text_of(page(f"<article>{open_divs}<nav><p>menu</p></nav></article>")) == "\n".join("x" * 3000)


def test_a_class_word_removes_no_more_than_it_leaves():
    body = "<p>A text of some length.</p><div class='ad'>Buy</div>"
    wanted = "A text of some length."
    assert text_of(f"<body class='right-sidebar'>{MENU}<article>{body}</article></body>") == wanted
    assert text_of(page(f"<div class='content with-comments'><article>{body}</article></div>")) == wanted
    assert text_of(page(f"<article class='post has-share'>{body}</article><article class='comment'>No</article>")) == wanted
    assert text_of(page(f"<article><div class='body has-share'>{body}</div><p>end</p></article>")) == wanted + "\nend"
    assert text_of(page(f"<article>{body}</article><div class='comments'><article>No</article></div>")) == wanted


def test_the_article_of_a_page_counts_where_the_sample_has_none():
    wrapper = Wrapper(inferred([page(b) for b in PLAIN]), 4)
    assert wrapper.main_text(page("<div>menu without a tag</div><article><h2>Title</h2><p>Share this</p></article>")) == "Title\nShare this"


def test_the_wrapper_stops_at_containers_and_takes_other_pages_whole(spark):
    def page(body):
        return f"<html><body><div class='top'>Site</div><div class='box'>{body}</div></body></html>"

    sample = [page(f"<h2>Results</h2><p>{' '.join(f'word{k}{i}' for i in range(9))}</p>") for k in range(8)]
    wrapper = Wrapper(inferred(sample), len(sample))
    assert wrapper.main_text(page("<h2>New</h2><p>A</p><p>Results</p><p>B</p>")) == "New\nA\nResults\nB"
    # The heading that all of them share goes from its own place alone.
    assert wrapper.main_text(sample[0]) == " ".join(f"word0{i}" for i in range(9))
    other = "<html><body><section><p>One</p><p>Two</p></section></body></html>"
    assert wrapper.main_text(other) == "One\nTwo"


def test_fixed_parts_go_from_inside_articles_too(spark):
    def page(k):
        words = [" ".join(f"w{k}x{i}" for i in range(12)), f"Read next: ten things about {k}"]
        more = "<div class='most-read'>Read next: ten things</div>"
        return f"<body><article><p>{words[0]}</p>{more}<p>{words[1]}</p></article></body>", "\n".join(words)

    rows = [(k, "https://a.b/x", page(k)[0]) for k in range(5)]
    rows += [(10 + k, "https://c.d/x", f"<body><article><p>The same in all</p><p>{k}</p></article></body>") for k in range(4)]
    rows += [(20 + k, "https://e.f/x", page(k)[0]) for k in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert [got[k] for k in range(5)] == [page(k)[1] for k in range(5)]
    # What is most of an article stays in it, and two pages prove nothing.
    assert [got[10 + k] for k in range(4)] == [f"The same in all\n{k}" for k in range(4)]
    assert "ten things\n" in got[20]


def plain_blocks(html):
    """A plain extractor for pages of simple blocks: the texts of p, h1 and li inside the article."""
    import re
    from html import unescape

    article = re.search(r"(?s)<article[^>]*>(.*?)</article>", html)
    inside = re.sub(r"(?s)<(script|style|nav|aside|form)[^>]*>.*?</\1>", "", article.group(1))
    found = [unescape(re.sub(r"<[^>]+>", "", b)) for b in re.findall(r"(?s)<(?:p|h1|li)>(.*?)</(?:p|h1|li)>", inside)]
    return "\n".join(t for t in (" ".join(b.split()) for b in found) if t)


def test_simple_pages_equal_a_plain_extractor(spark):
    import random

    draw = random.Random(3)
    words = ["alpha", "b&amp;c", "<b>bold</b>", "d&#233;", "<a href='x'>link</a>", "  spaced\n out "]
    rows = []
    for k in range(60):
        def text():
            return " ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) + f" {draw.random()}"

        parts = [f"<h1>{text()}</h1>"] + [draw.choice([f"<p>{text()}</p>", f"<ul><li>{text()}</li><li>{text()}</li></ul>",
                 "<aside>An aside</aside>", "<script>var x = '<p>no</p>';</script>"]) for _ in range(draw.randint(1, 8))]
        rows.append((k, f"https://h{k % 3}.org/{k}", f"<html><body><nav><p>Menu</p></nav><article>{''.join(parts)}</article><footer><p>End</p></footer></body></html>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert got == {k: plain_blocks(html) for k, _, html in rows}


def article(k, head="The same heading", more=""):
    text = " ".join(f"w{k}x{i}" for i in range(12))
    return f"<body><article><h2>{head}</h2><p>{text}</p>{more}</article></body>", f"{text}"


def test_all_pages_of_a_host_say_what_is_fixed(spark):
    rows = [(k, "https://a.b/x", article(k)[0]) for k in range(60)]
    rows += [(100 + k, "https://c.d/x", article(k)[0]) for k in range(60)]
    # One page of many refutes that the heading is one of all pages.
    rows += [(200, "https://c.d/x", article(200, "Another heading")[0])]
    # What a few pages have, alike or not, is theirs.
    rows += [(300 + k, "https://e.f/x", article(k, more="<ul><li>Only here</li></ul>" if k < 4 else "")[0]) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert [got[k] for k in range(60)] == [article(k)[1] for k in range(60)]
    assert [got[100 + k] for k in range(60)] == [f"The same heading\n{article(k)[1]}" for k in range(60)]
    assert got[200] == f"Another heading\n{article(200)[1]}"
    assert [got[300 + k] for k in range(60)] == [article(k)[1] + ("\nOnly here" if k < 4 else "") for k in range(60)]


def test_wrappers_count_every_page_once_however_rows_are_dealt(spark, monkeypatch):
    import random

    monkeypatch.setattr(html, "TOGETHER", 2)
    monkeypatch.setattr(html, "HELD", 2000)
    draw = random.Random(7)
    parts = ["<p>a {}</p>", "<ul><li>b</li></ul>", "<table><tr><td>{}</td></tr></table>", "<h3>c</h3>", "<pre>{}</pre>"]
    pages = [article(k, more="".join(draw.choice(parts).format(k) for _ in range(draw.randint(0, 5))))[0] for k in range(50)]
    rows = [(f"h{k % 2}", k // 4, p) for k, p in enumerate(pages)]
    rows += [*rows[:9], *rows[:3], ("h3", 1, "")]
    seen = []
    for n in (1, 7):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "host string, page_id bigint, html string").repartition(n)
        found = host_wrappers(df.selectExpr("*", "xxhash64(html) AS h")).collect()
        assert {r.host: r.pages for r in found} == {"h0": 25, "h1": 25, "h3": 1}
        seen.append({r.host: (r.wrapper, r.rule) for r in found})
    assert seen[0] == seen[1]
    assert "<h2>'The same heading'</>" in next(r.expression for r in found if r.host == "h0")


def test_rare_parts_of_a_large_wrapper_go_alone(spark, monkeypatch):
    monkeypatch.setattr(html, "PARTS_MOST", 30)
    monkeypatch.setattr(html, "RARE", 4)
    rows = [("h", k, article(k, more=f"<div class='c{k}'>x</div>")[0]) for k in range(40)]
    df = spark.createDataFrame(rows, "host string, page_id bigint, html string").selectExpr("*", "xxhash64(html) AS h")
    (found,) = host_wrappers(df).collect()
    assert found.pages == 40 and html.n_parts(json.loads(found.wrapper)) <= 40
    assert Wrapper.read(found.rule).main_text(rows[0][2]) == article(0)[1] + "\nx"


def test_rare_parts_count_for_the_path(spark, monkeypatch):
    monkeypatch.setattr(html, "PARTS_MOST", 20)
    monkeypatch.setattr(html, "RARE", 4)
    side = "<div class='more'><ul>{}</ul></div>"

    def page(k):
        text = "\n".join(f"Text {k} {j}" for j in range(4))
        body = "".join(f"<p>{t}</p>" for t in text.split("\n"))
        return f"<body><div class='all'><div class='post-{k}'>{body}</div>{side.format(f'<li>{k}</li><li>{k}</li>')}</div></body>", text

    df = spark.createDataFrame([(k, "https://a.b/x", page(k)[0]) for k in range(40)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert all(got[k] == f"{page(k)[1]}\n{k}\n{k}" for k in range(40))

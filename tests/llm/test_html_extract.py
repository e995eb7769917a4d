import random
import re

import pytest

from heliograph.llm.html_extract import ANY, CONST, KEY, KIDS, MASS, MOST_KIDS, OPTIONAL, REPEATED, Node, decide, expression, extract_text, infer_wrappers, main_text, marked, merged, page_wrapper, read_page, weigh

SCHEMA = "page_id long, url string, html string, text int"


def wrapper(html):
    page = read_page(html)
    weigh(page)
    return page_wrapper(page)


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
    <body class="has-sidebar"><header>top</header><nav><ul><li>menu</li></ul></nav><!-- c <article> --><div class="ad">buy</div>
    <article class="post comment-open"><header><h1>Head &amp; line</h1></header><p>One  <b>two</b>
    three<br>four<p>A&nbsp;b &lt;i&gt; &eacute; &#233; &#x1F600;<div class="cookie-notice">notice</div><aside>side</aside>
    <form><p>field</p></form><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><span class="advert">no</span>tail</article>
    <section id="comments"><article><p>reader</p></article></section><footer>&copy; f</footer></body></html>"""
    want = "Head & line\nOne two three four\nA b <i> é é 😀\nx\ny\nc1\nc2\ntail"
    assert main_text(page) == want


def test_names_do_not_decide():
    assert main_text('<article><p class="reply">one</p><p id="social">two</p><div class="menu-of-the-day">three</div></article>') == "one\ntwo\nthree"
    assert main_text('<div>this is <span class="ad-hoc">ad hoc</span> text</div>') == "this is ad hoc text"
    page = "<h1>Head</h1><p>" + "long text " * 20 + "</p><article>teaser</article>"
    assert main_text(f"<body>{page}</body>").startswith("Head\nlong text")
    inner = "<article><h2 id='related-work'>R</h2><p>text of it</p><section id='side-effects'>s</section></article>"
    assert main_text(f"<div class='content with-sidebar'>{inner}</div>") == main_text(f"<div class='sidebar'>{inner}</div>") == "R\ntext of it\ns"
    assert main_text("<div class='comments'><p>all that there is on this page</p></div>") == "all that there is on this page"
    assert [x for x in ("ad", "site-footer", "comment-list-2", "ad-hoc", "menu-of-the-day", "header", "post") if marked(x)] == ["ad", "site-footer", "comment-list-2"]


def test_broken_and_other_pages():
    assert main_text("") == "" and main_text("<p>a<p>b") == "a\nb" and main_text("<div>plain &am") == "plain &am"
    assert main_text("<article><p>kept</p><p>cut of</p></arti") == "kept\ncut of"
    assert main_text("<body>x<main>m<p>n</main>y") == "m\nn" and main_text("<!-- open <p>x") == ""
    assert main_text("<p title='a>b'>q</p><p title=\"open>r</p>").startswith("q")
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert main_text("<script>never closed <p>x</p>") == ""
    assert len(main_text("<p>" + "w " * 200000)) == 399999 and main_text("<b>" * 50000 + "x") == "x" and main_text("<div>" * 20000 + "x") == "x"


def test_wrapper_algebra():
    assert expression(wrapper("<p>one</p><p>two</p><p>three</p><div>x</div>")) == "[p[#+]+ div[=]]"
    a, b = wrapper("<div>same</div><p>one<p>two<p>three"), wrapper("<div>same</div><h2>more</h2><p>four<p>five")
    w = merged(a, b, False)
    assert w[1] == 2 and expression(w) == "[div[=] h2[=]? p[#+]+]"
    assert expression(merged(w, a, False)) == expression(w)
    part = wrapper("<ul><li><a>1</a></li><li><a>2</a><div>new</div></li><li><a>3</a></li></ul>")  # a repeat with an optional part
    assert expression(part) == "[ul[li[#+ div[=]?]+]]"
    turns = wrapper("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><ul><li>e</ul><p>f</p><h2>g</h2>")
    assert expression(turns) == "[( h2[#+]+ ul[li[=]]? p[#+]+? )+]"


def accepts(part):
    """The wrapper as a pattern over streams of tags."""
    if part[KEY] == "#":
        out = "#"
    else:
        inner = "".join(map(accepts, part[KIDS]))
        out = f"(?:{inner})" if part[KEY].startswith("(") else f"(?:<{re.escape(part[KEY])}>{inner}</>)"
    if part[KEY].startswith("("):
        return f"(?:{out}+)?" if part[OPTIONAL] else f"{out}+"
    return out + {(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[part[OPTIONAL], part[REPEATED]]


def stream(node):
    return "".join(f"<{x.key}>{stream(x)}</>" if isinstance(x, Node) else "#" for x in node.kids if not isinstance(x, Node) or not x.drop)


def random_page(r, deep=0):
    out = []
    for _ in range(r.randrange(0, 5)):
        t = r.choice(["p", "h2", "div", "div class=a", "section", "ul"])
        name = t.split()[0]
        inner = "".join(f"<li>{r.randrange(9)}</li>" for _ in range(r.randrange(3))) if name == "ul" else random_page(r, deep + 1) if name in ("div", "section") and deep < 3 else f"t{r.randrange(99)}"
        out.append(f"<{t}>{inner}</{name}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(30))
def test_a_wrapper_accepts_every_page_that_it_comes_from(seed):
    r = random.Random(seed)
    pages = [read_page(random_page(r)) for _ in range(8)]
    for p in pages:
        weigh(p)
    parts = [page_wrapper(p) for p in pages]
    left = parts[0]
    for x in parts[1:]:
        left = merged(left, x, False)
    halves = [merged(merged(parts[i], parts[i + 1], False), merged(parts[i + 2], parts[i + 3], False), False) for i in (0, 4)]
    for w in (left, merged(*halves, False)):
        rx = re.compile("".join(map(accepts, w[KIDS])))
        assert all(rx.fullmatch(stream(p)) for p in pages)


def made():
    r = random.Random(1)
    rows = []
    for i in range(60):
        body = "".join(f"<p>w{r.randrange(10**6)} text</p>" for _ in range(r.randrange(1, 6)))
        rows.append((i, f"http://a.example/{i}" if i % 2 else f"https://b.example:80/{i}", f"<article><h1>t{i}</h1>{body}<div>Read us daily</div></article>", None))
    return rows + [(900, None, None, 1), (901, "", "", 1), (902, "http://c.example", "<article><div>Read us daily</div></article>", 1)] * 2


def test_template_text_and_rows(spark):
    rows = made()
    got = extract_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all("daily" not in by[i] and by[i].startswith(f"t{i}\nw") for i in range(60))
    assert by[900] == by[901] == "" and by[902] == "Read us daily"
    shuffled = extract_text(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    hosts = {r.host for r in infer_wrappers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert hosts == {"a.example", "b.example", "c.example", ""}
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_host_of_many_shapes_is_decided_by_its_wrapper(spark):
    """No article element, no telling names; some pages have more text beside their article than in it."""
    r, rows, want, alone = random.Random(4), [], {}, 0
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    for i in range(400):
        blocks = [say(5), *(say(r.choice([3, 30, 60])) for _ in range(r.randrange(1, 5)))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if j % 3 else f"<blockquote><p>{b}</p></blockquote>" for j, b in enumerate(blocks[1:]))
        extra = "".join(f"<div class='x{r.randrange(9)}'>{say(r.randrange(1, 4))}</div>" for _ in range(r.randrange(3)))
        page = f"<html><body><ul><li><a href=/>{say(2)}</a></li><li><a href=/x>{say(3)}</a></li></ul>{extra}<div class='c1'>{inner}</div><div class='c2'>{say(25)}</div></body></html>"
        rows.append((i, "http://hot.example/" + str(i), page, None))
        want[i] = "\n".join(blocks)
        alone += main_text(page) != want[i]
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(16)).collect()}
    assert got == want and alone > 40  # what a page's own structure gets wrong


def test_decision_is_small():
    w = wrapper("<body><div class='p1'><p>a</p></div></body>")
    for i in range(2000):
        w = merged(w, wrapper(f"<body><div class='k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>x{i}</div><div class='p1'><p>{i} and more text</p></div></body>"), False)
    assert len(str(w)) < 40000 and decide(w, 5)["path"][-1] == "div.p1" and w[CONST] == 0


BODY = "".join(f"<p>Sentence {i} of the article, which has some words.</p>" for i in range(4))
PLAIN_BODY = "\n".join(f"Sentence {i} of the article, which has some words." for i in range(4))


@pytest.mark.parametrize("part", ['<ol class="commentlist"><li>reader one<li>reader two</ol>', '<div class="ad-slot">buy</div>', '<div class="ad__unit">buy</div>', '<div class="adsbygoogle">buy</div>', '<div class="alert alert-info">note</div>', '<div id="gdpr">we use</div>', '<section id="comments">' + "<p>a reader says much</p>" * 60 + "</section>", '<div class="comments">' + "<article><p>a reader says much</p></article>" * 60 + "</div>"])
def test_comments_adverts_and_notices_inside_an_article_go(part):
    assert main_text(f"<body><article>{BODY}{part}</article></body>") == PLAIN_BODY
    if "comment" in part:
        assert main_text(f"<body><main><article>{BODY}</article>{part}</main></body>") == PLAIN_BODY


def test_heading_before_the_article():
    assert main_text(f"<body><h1>Site</h1><main><h1>Title</h1><article>{BODY}</article></main></body>") == "Title\n" + PLAIN_BODY


@pytest.mark.parametrize("deep", [50, 150, 3000])
def test_any_depth(deep):
    inner = "<div>" * deep + f"{BODY}<nav><ul><li>menu</ul></nav><div class='ad'>buy</div><aside>side</aside>" + "</div>" * deep
    assert main_text(f"<body><article>{inner}<p>end</p></article><footer>f</footer></body>") == PLAIN_BODY + "\nend"


def test_host_with_comments_and_adverts_but_no_article(spark):
    r = random.Random(6)
    rows, want = [], {}
    for i in range(60):
        body = [f"Part {k} of text {r.randrange(10**6)} and some more words." for k in range(r.randrange(3, 9))]
        readers = "".join(f"<li>reader {r.randrange(10**6)} wrote quite a lot of words here</li>" for _ in range(r.choice([0, 3, 40])))
        html = f"<body><div class='top'><a href='/'>home</a> <a href='/n'>news</a></div><div class='story'>{''.join(f'<p>{b}</p>' for b in body)}<div class='ad-slot'>ad {r.randrange(99)}</div></div><ol class='commentlist'>{readers}</ol><div class='foot'>All rights</div></body>"
        rows.append((i, f"https://h.example/{i}", html, 0))
        want[i] = "\n".join(body)
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def own_name(i, mark=""):
    return mark + "".join(chr(97 + i // 26**k % 26) for k in range(3))


@pytest.mark.parametrize("pages", [150, 250, 900])
def test_no_sibling_is_forgotten(pages):
    """Each page's article has a class of its own, beside a smaller part that all pages share."""
    say = lambda i, n: f"page {i} " + "w" * n
    made = [f"<body><div class='side'><p>{say(i, 60)}</p></div><div class='{own_name(i)}'><p>{say(i, 400)}</p></div><ul class='{own_name(i, 'ad-')}'><li>{say(i, 20)}</li></ul></body>" for i in range(pages)]
    parts = [wrapper(x) for x in made]
    w = parts[0]
    for x in parts[1:]:
        w = merged(w, x, False)
    body = w[KIDS][0]
    leaves = lambda part: part[MASS] if part[KEY] == "#" else sum(map(leaves, part[KIDS]))
    assert leaves(w) == w[MASS] == sum(x[MASS] for x in parts)
    inner = [y for x in body[KIDS] for y in (x[KIDS] if x[KEY].startswith("(") else [x])]
    assert len(inner) <= MOST_KIDS + 10 or pages < MOST_KIDS
    d = decide(w, 5)
    if pages > MOST_KIDS:
        assert ANY in d["path"][-1] and "div.side" in d["named"][-1]
        assert [main_text(x, d) for x in made] == [say(i, 400) for i in range(pages)]
    assert all(say(i, 400) in main_text(x, d) for i, x in enumerate(made))


def test_articles_of_many_names_on_one_host(spark):
    rows = [(i, f"http://m.example/{i}", f"<body><div class='side'><p>teaser {i} of the day</p></div><div class='{own_name(i)}'><p>text {i} {'long ' * 40}</p></div></body>", 0) for i in range(400)]
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    assert got == {i: f"text {i} {'long ' * 40}".strip() for i in range(400)}


def test_text_of_a_few_pages_is_no_template():
    made = [f"<body><article><p>text {i} and more</p>{'<div class=x>only here</div>' if i == 3 else ''}</article></body>" for i in range(10)]
    w = wrapper(made[0])
    for x in made[1:]:
        w = merged(w, wrapper(x), False)
    assert main_text(made[3], decide(w, 5)) == "text 3 and more\nonly here"

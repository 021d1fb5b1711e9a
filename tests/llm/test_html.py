import random
from html.parser import HTMLParser

import pytest

from graphloom.llm.html_wrappers import Wrapper, align, extract_main_text, extract_page, from_json, infer_wrappers, parse, to_items, to_json, to_regex

SHELL = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    '<header><h2>Site</h2></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy {n}</div><div id="cookie-notice">We use cookies</div>'
    "{body}<aside class=s>side</aside><form><p>name</p><input name=q></form><section class='comments'><article class=comment><p>first!</p></article></section>"
    "<footer>&copy; x</footer></body></html>"
)


def page(body, n=0):
    return SHELL.format(body=body, n=n)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; more</h1><p>One  two\n three.</p><p>Four &amp;amp; &eacute;</p></article>", "Head & more\n\nOne two three.\n\nFour &amp; é"),
        ("<article><h1>H</h1><p><b>bold.<br><p>Next <i>in</i>line<p>Last</article>", "H\n\nbold.\n\nNext inline\n\nLast"),
        ("<article><p>a<div class='share'>Share</div></p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "a\n\nx\n\ny\n\n1\n\n2"),
        ("<main><p>in main</p></main><p>outside</p>", "in main"),
        ('<div class="post-content"><p>in div</p></div><p>outside</p>', "in div"),
        ("<article><p title='a > b'>quoted</p><p title=\"it's\">x < y</p></article>", "quoted\n\nx < y"),
        ("<article><div class='adBox'>x</div><p id=comment12>y</p><p style='color:red; display: none'>z</p><p class='loader shadow'>kept</p></article>", "kept"),
        ("<article></article>", ""),
    ],
)
def test_article_of_one_page(body, want):
    assert extract_page(page(body)) == want
    assert extract_page(page(body).replace("</body></html>", "")) == want


def test_all_parts_of_the_best_rank_are_kept_once():
    assert extract_page(page("<article><p>one</p></article><p>x</p><article><p>two, longer</p><article>in</article></article>")) == "one\n\ntwo, longer\n\nin"
    assert extract_page(page("<div class='article-title'>Head</div><section class=content>a</section><section class=content>bb</section>")) == "Head\n\na\n\nbb"


def test_late_class_words_and_late_text_count():
    late = " ".join(f"a-utility-{c}" for c in "abcdefghij")
    assert extract_page(page(f"<article><p>kept</p><div class='{late} newsletter'>sign up</div></article>")) == "kept"
    pages = [f"<body><div>{'The same beginning ' * 6}and page {i}</div><p>{'Always the same text ' * 6}</p></body>" for i in "abcdef"]
    w = shape(pages[0])
    for p in pages[1:]:
        w = align(w, shape(p))
    assert Wrapper(w, 6).text(parse(pages[2])) == "The same beginning " * 6 + "and page c"


@pytest.mark.parametrize("source", [None, "", "plain", "<", "<p", "<article><p>cut off <b cla", "<div>" * 5000 + "deep", "</p></div>ok", "<script>never closed", "<a b='" + "='" * 3000])
def test_broken_pages_do_not_fail(source):
    t = extract_page(source)
    assert t == {"plain": "plain", "<": "<", "<article><p>cut off <b cla": "cut off", "</p></div>ok": "ok", "<div>" * 5000 + "deep": "deep"}.get(source, t)


def shape(source):
    return to_items(parse(source))


def test_alignment_makes_optional_and_repeated_parts():
    a, b = shape("<ul><li>x</li><li>y</li></ul><p>same</p><p>A</p>"), shape("<h2>t</h2><ul><li>x</li></ul><p>same</p>")
    w = align(a, b)
    assert to_regex(w) == "(<h2>t</h2>)?<ul>(<li>#</li>)+</ul>(<p>#</p>)+"
    r = random.Random(4)
    for _ in range(200):
        parts = ["<h2>{}</h2>", "<p>{}</p>", "<div class=k>{}</div>", "<ul><li>{}</ul>"]
        pages = [shape("".join(r.choice(parts).format(r.randint(0, 3)) for _ in range(r.randint(0, 9)))) for _ in range(6)]
        w = pages[0]
        for p in pages[1:]:
            w = align(w, p)
        assert all(covers(w, p) for p in pages), to_regex(w)
        assert len(w) <= 4 and all(bare(align(w, p)) == bare(w) for p in pages)


def bare(items):
    """A wrapper without its counts of letters."""
    return [{k: bare(v) if k == "k" else v for k, v in x.items() if k not in "cl"} for x in items]


def covers(wrapper, items):
    """Whether every item of a page has its place in the wrapper."""
    known = {y["s"]: y for x in wrapper for y in (x["k"] if x["s"] == "()" else [x])}
    for x in items:
        for y in x["k"] if x["s"] == "()" else [x]:
            if y["s"] not in known or y["s"] == "#" and known["#"]["t"] not in (None, y["t"]) or y["s"] != "#" and not covers(known[y["s"]]["k"], y["k"]):
                return False
    return True


def test_wrapper_drops_constant_texts_outside_articles():
    pages = [f"<body><div class=top>Welcome here</div><div class=x>Words {i}<span>, all</span></div><p>Mind the step</p></body>" for i in range(6)]
    w = shape(pages[0])
    for p in pages[1:]:
        w = align(w, shape(p))
    assert Wrapper(w, 6).text(parse(pages[2])) == "Words 2, all"
    assert Wrapper(w, 2).text(parse(pages[2])) == "Welcome here\n\nWords 2, all\n\nMind the step"


def test_frame(spark):
    rows = [(i, f"https://{'hot' if i % 3 else 'b'}.example/{i}", page(f"<article><h1>N{i}</h1><p>text {i}</p></article>", i), "e") for i in range(60)]
    rows += [(100, None, None, None), (100, None, None, None), (None, "no host", "<p>x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    got = extract_main_text(pages).collect()
    want = {i: f"N{i}\n\ntext {i}" for i in range(60)} | {100: "", None: "x"}
    assert len(got) == len(rows) and all(g.text == want[g.page_id] for g in got)
    hosts = {w.host: w.n_pages for w in infer_wrappers(pages).collect()}
    assert hosts == {"hot.example": 40, "b.example": 20, "": 3}
    assert extract_main_text(pages.limit(0)).count() == 0


def wrapper_of(pages, enough=5):
    w = shape(pages[0])
    for p in pages[1:]:
        w = align(w, shape(p))
    return Wrapper(w, len(pages), enough)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div>" * 400 + "<nav>MENU</nav><p>a</p><p>b</p>", "a\n\nb"),
        ("<body><nav>m</nav><div class='content has-sidebar'><p>text</p></div></body>", "text"),
        ("<body><article class='post comments-open'><p>text</p></article></body>", "text"),
        ("<body><p>an article of some length</p><div class='bg-white border-b p-4 margin-auto sidebar'>side</div></body>", "an article of some length"),
        ("<form><div><p>a page inside a form</p></div></form>", "a page inside a form"),
        ("<article><p>kept</p></article><div class='comment-list'><p>" + "reader words " * 50 + "</p></div>", "kept"),
    ],
)
def test_names_and_depth_do_not_decide_alone(source, want):
    assert extract_page(source) == want


def test_the_wrapper_decides_where_no_element_is_marked():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    links = lambda: "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(8))
    bodies = [[" ".join(word() for _ in range(20)) for _ in range(3)] for _ in range(8)]
    pages = [
        f"<body><div class=x1>Always here</div><ul class=x2>{links()}</ul><div class='x3 has-sidebar'>{''.join(f'<p>{p}</p>' for p in b)}</div><div class=x4><p>Call us</p></div></body>"
        for b in bodies
    ]
    w = wrapper_of(pages)
    for page_, b in zip(pages, bodies):
        assert w.text(parse(page_)) == "\n\n".join(b)
        alone = extract_page(page_)
        assert alone != w.text(parse(page_)) and alone.startswith("Always here")


def test_a_mark_counts_by_what_it_holds():
    # teasers stand in article elements, the article itself in a plain one
    pages = [f"<body><div class=x><p>{f'words of page {i} ' * 60}</p></div><div class=y><article>teaser {i}</article></div></body>" for i in "abcdefg"]
    assert wrapper_of(pages).text(parse(pages[0])).startswith("words of page a")
    # parts of one rank and length all count, in page order
    assert extract_page("<article>bbbb</article><article>aaaa</article>") == "bbbb\n\naaaa"


def test_long_lists_and_long_texts_are_aligned_whole():
    many = ["".join(f"<p class='k{chr(97 + i % 26)}{chr(97 + i // 26)}'>{j} {i}</p>" for i in range(600)) for j in range(2)]
    w = align(shape(many[0]), shape(many[1]))
    assert len(w) == 600 and all(x["k"][0]["t"] is None for x in w)
    pages = [f"<body><p>{'same words ' * 20}{i}</p></body>" for i in range(6)]
    assert wrapper_of(pages).text(parse(pages[3])).endswith("same words 3")


def test_wrappers_survive_being_written():
    deep = shape("<div>" * 3000 + "<p>x<a>y</a></p><p>z</p>")
    assert to_json(from_json(to_json(deep))) == to_json(deep)
    some = shape("<ul><li>x</li><li>y</li></ul><p>a</p><h2>b</h2><p>c</p>")
    assert from_json(to_json(some)) == some


class Plain(HTMLParser):
    """Blocks of a well-formed page in the plainest way: a list of pieces with breaks between blocks."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("nav", "aside", "footer") or self.skip > 0
        self.out.append("\0" if tag not in ("b", "i", "span") else "")

    def handle_endtag(self, tag):
        self.skip -= self.skip > 0
        self.out.append("\0" if tag not in ("b", "i", "span") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_rendering_by_brute_force():
    r = random.Random(8)

    def some(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["x &amp; y", " two  words\n", "é&eacute;", "&lt;p&gt;", "", "3 &#60; 4 "])
        tag = r.choice(["div", "section", "h2", "ul", "b", "i", "span", "nav", "aside", "footer", "blockquote"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(300):
        body = "".join(some(5) for _ in range(4))
        p = Plain()
        p.feed(body)
        want = "\n\n".join(t for b in "".join(p.out).split("\0") if (t := " ".join(b.split())))
        assert extract_page(f"<html><body><article>{body}</article></body></html>") == want

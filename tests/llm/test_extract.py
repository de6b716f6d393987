"""Extraction: pages of families that training never saw, a plain reading of blocks, broken and very long pages."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from accretion.llm import html_extract

#: Pages written by hand, none like the training templates; a main block begins with *.
PAGES = [
    # a newspaper of nested divisions
    """<html><head><title>Dam reopened - Valley Courier</title><meta charset="utf-8"></head><body class="front">
    <div id="wrapper"><div class="masthead"><a href="/">Valley Courier</a></div><div class="navbar"><span><a href="/n">News</a></span><div><a href="/s">Sport</a></div><div><a href="/w">Weather</a></div></div>
    <div class="story-body"><h1>*Dam reopened after two years of repairs</h1><div class="byline">By Our Staff</div>
    <p>*The dam above the valley was reopened on Monday, two years after cracks had been found in its wall.</p>
    <p>*Engineers said that the wall had been <em>strengthened</em> along its whole length, and that water would rise slowly until May.</p>
    <div class="advertisement">Buy two, get one free at Miller's this week only.</div>
    <p>*Farmers downstream, who had to do with less water, welcomed the news. &quot;We can plant again,&quot; one of them said.</p></div>
    <div class="sidebar"><h4>Most read</h4><div><a href="/1">Council votes on parking</a></div><div><a href="/2">Choir wins prize</a></div></div>
    <div class="footer">Copyright Valley Courier. All rights reserved.</div></div></body></html>""",
    # documentation with code and definition lists
    """<!doctype html><html><body><nav class="toc"><ol><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li><li><a href="#c">Options</a></li></ol></nav>
    <main><h1>*Using the sorter</h1><p>*The sorter reads lines from its input and writes them in order.</p><h2>*Options</h2>
    <dl><dt>*reverse</dt><dd>*Writes the largest line first.</dd><dt>*unique</dt><dd>*Writes equal lines once.</dd></dl>
    <pre>*sorter reverse names.txt</pre><p>*If no file is given, the sorter waits for lines to be typed.</p></main>
    <footer><p>Built from revision 12.</p></footer></body></html>""",
    # a blog with comments
    """<html><body><header><h2><a href="/">Pots and pans</a></h2></header><div class="post"><h2>*Soup for a cold day</h2>
    <p>*When it snows I cook what my grandmother cooked: onions, barley and a bone.</p><ul><li>*four onions</li><li>*a cup of barley</li><li>*one marrow bone</li></ul>
    <p>*Fry the onions slowly, add the rest with plenty of water, and leave the pot alone for three hours.</p><div class="share"><a href="#">Share</a> <a href="#">Pin</a></div></div>
    <div id="comments"><h3>2 replies</h3><div class="comment"><b>Ann</b><p>I made this yesterday and my children loved it, thank you.</p></div><div class="comment"><b>Joe</b><p>Could one use rice instead of barley? I have none here.</p></div></div>
    <form action="/c"><label>Your name</label><input name=n><textarea>Say something</textarea><button>Send</button></form></body></html>""",
    # an old page of tables, without classes
    """<html><head><title>History of the mill</title></head><body bgcolor=white><table><tr><td colspan=2><a href=i.html>Home</a> | <a href=m.html>Map</a> | <a href=l.html>Links</a></td></tr>
    <tr><td><a href=1>Village</a><br><a href=2>Church</a><br><a href=3>Mill</a></td><td><h1>*History of the mill</h1>
    <p>*The mill was built in 1712 by two brothers, who had come down the river with nothing but their tools.</p><p>*It burned twice, in 1780 and in 1833, and was rebuilt each time with a larger wheel.</p>
    <p>*Since 1950 it has been a museum, which opens on Sundays from May to September.</p></td></tr></table></body></html>""",
    # an encyclopedia's page with a notice and boxes
    """<html><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><header><form class="search"><input><button>Search</button></form></header>
    <main id="content"><h1>*Marsh heron</h1><p>*The marsh heron is a wading bird of still waters, known by its grey back and its long, yellow bill.</p>
    <figure><img src=h.jpg><figcaption>*A marsh heron in winter</figcaption></figure><h2>*Food</h2><p>*It lives on frogs and small fish, and stands without moving until one comes near.</p>
    <blockquote>*No bird has more patience, wrote an early observer.</blockquote></main><aside class="related"><h3>See also</h3><ul><li><a href=1>Bittern</a></li><li><a href=2>Egret</a></li></ul></aside>
    <footer><ul><li><a href=a>About</a></li><li><a href=b>Contact</a></li></ul><p>Text may be copied under a free licence.</p></footer></body></html>""",
    # a page of little besides its article
    """<html><body><article><h1>*Letter to a friend</h1><p>*I write to you from the train, as the lamps are being lit along the coast.</p><p>*Nothing has changed here.<p>*Or so it seems, from the window of a train.</article></body></html>""",
    # sections and popups
    """<html><body><div class="modal" role="dialog"><p>Subscribe to our newsletter and never miss a story.</p><a href="#">No thanks</a></div><div role="navigation"><a href=1>World</a> <a href=2>Money</a></div>
    <section class="article-text"><h1>*Markets calm after a week of losses</h1><p>*Shares rose a little on Friday, as traders returned from the holiday.</p><p>*Banks gained most, followed by makers of machines, while oil firms lost ground again.</p>
    <aside class="promo">Our app brings you all prices at once.</aside><p>*Analysts expect a quiet month, with few figures due before the end of it.</p></section><section class="recommended"><h2>Recommended</h2><p><a href=3>Why gold falls when it should rise</a></p><p><a href=4>Five questions on interest</a></p></section></body></html>""",
]


def marked(page):
    """(page without marks, texts of its blocks, which of them are main)."""
    found = [b[0] for b in html_extract.blocks(page)]
    return page.replace("*", ""), [t.lstrip("*") for t in found], [t.startswith("*") for t in found]


def test_other_families():
    chain, hit, said, true = html_extract.default_chain(), 0, 0, 0
    for raw in PAGES:
        page, texts, gold = marked(raw)
        found = html_extract.blocks(page)
        assert [b[0] for b in found] == texts
        got = chain.decode(chain.emissions(html_extract.features(found)).tolist())
        hit, said, true = hit + sum(a and b for a, b in zip(got, gold, strict=True)), said + sum(got), true + sum(gold)
    precision, recall = hit / said, hit / true
    assert 2 * precision * recall / (precision + recall) > 0.9, (precision, recall)


class Plain(HTMLParser):
    """Texts of blocks by Python's own parser, of pages whose tags are all closed and nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.hidden = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("" if self.hidden else " ")
        elif tag not in html_extract.INLINE | html_extract.HIDDEN | html_extract.RAW and not self.hidden:
            self.flush()
        if tag in html_extract.HIDDEN | html_extract.RAW:
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag not in html_extract.INLINE | html_extract.HIDDEN | html_extract.RAW and not self.hidden:
            self.flush()
        if tag in html_extract.HIDDEN | html_extract.RAW:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    @classmethod
    def blocks(cls, page):
        self = cls()
        self.feed(page)
        self.close()
        self.flush()
        return self.out


def grown(r, depth=0):
    """A random page whose tags are all closed."""
    out = ""
    for _ in range(r.randrange(1, 5)):
        tag = r.choice("div section span b ul blockquote h2 a script style svg video noscript br img text text text comment".split())
        if tag == "text":
            out += r.choice(["plain words", "a &amp; b", "x &lt; y", " \n ", "tail.", "&copy;", "5 < 6", "é&nbsp;ü"])
        elif tag == "comment":
            out += r.choice(["<!-- <p>no</p> -->", "<!--a--b-->", "<!doctype html>"])
        elif tag in ("br", "img"):
            out += f"<{tag}>"
        elif tag in html_extract.RAW:
            out += f"<{tag}>if (a<b) {{ x = '<p>' }}</{tag}>"
        elif depth < 5:
            attributes = r.choice(["", ' class="a>b"', " title='x\">y'", " hidden", ' id=k data-x="1"', ' alt="it\'s"'])
            out += f"<{tag}{attributes}>{grown(r, depth + 1)}</{tag}>"
    return out


def test_blocks_against_a_plain_reading():
    r = random.Random(11)
    for _ in range(400):
        page = grown(r)
        assert [b[0] for b in html_extract.blocks(page)] == Plain.blocks(page), page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>First one.</p><svg width="1"/><p>Second one.</p></article>', ["First one.", "Second one."]),
        ('<article><p>First one.</p><iframe src="x"/><p>Second one.</p></article>', ["First one.", "Second one."]),
        ("<article><p>First one.</p><video src=x><p>Second one.</article>", ["First one.", "Second one."]),
        ("<article><video src=x><p>no</p></video><p>Second one.</article>", ["Second one."]),
        ('<p title="it>First para', ["First para"]),
        ("<p title='a>b'>x</p><p title=it's>y", ["x", "y"]),
        ("<template><div>no</template>yes", ["yes"]), ("<p>one <svg><g><text>no</text></g></svg>two", ["one two"]),
        ("a<script>x", ["a"]), ("a<!-- b", ["a"]), ("a<!-->b", ["ab"]), ("a<p class='x", ["a"]), ("<STYLE>p{}</Style >z", ["z"]), ("1 < 2 <3 </ 4", ["1 < 2 <3 </ 4"]),
    ],
)
def test_broken_pages(page, want):
    assert [b[0] for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("unit", ['<a "', '<a b="', '<a b=">"', "<a b='>\"", "<b>", "<svg>", "<svg></b>", "<!--", "</b>", "<p><b>", "<video>x</p>", "<i></b>", "<p>word "])
def test_linear_time(unit):
    page = ("<b><div>" if "</b>" in unit else "") + unit * 50_000
    start = time.perf_counter()
    html_extract.blocks(page)
    assert time.perf_counter() - start < 10


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Sentence {i} of a long page, which goes on.</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, "<p>Only &eacute; this, I think.</p>")], "page_id long, url string, html string")
    got = html_extract.extracted(df).collect()
    assert [r.text.count("\n") for r in got if r.page_id] == [19_999] * 2
    assert next(r.text for r in got if r.page_id is None) == html.unescape("Only &eacute; this, I think.")

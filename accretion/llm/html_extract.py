"""HTML extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is read once, tag by tag; a leaf block is the text between two block-level tags. Its features are the tags and
class words of its ancestors and some of its text; the chain's labels are main text or not. Weights are learned with
forward-backward sums on labelled pages, which labelled_pages() builds from templates unlike each other, and pages are
decoded by Viterbi.

Defined results: null and empty pages give the empty text; tags that are never closed end with their parent, closing tags
without an opening one are skipped; a comment, script or style that never ends hides the rest, as does a tag that does, but
other elements that aren't shown (HIDDEN) hide what lies before their closing tag only, and nothing if there is none. A
quote counts after = only, and only if it is closed; where quotes would swallow the last > of a page, its tags end at the
next > from there on. Rows that repeat a page each give its text; time is linear in a page's length, and nothing is
dropped for length. Columns of pages named text and n_chars are replaced, all others stay.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's elements by kind, and words in classes and ids that tell what an element holds.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Elements within so many others open no level of their own, as in browsers; their text is that of the last level.
DEEPEST = 512
HIDDEN = frozenset("noscript template svg math iframe object canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th"}
TAGS = "head title nav header footer aside article main section form button select textarea fieldset ul ol li dl table tr td th h1 h2 h3 h4 h5 h6 p div blockquote pre figure figcaption menu dialog body details address".split()
HINTS = (
    "ad ads advert advertisement advertising adbox sponsor sponsored promo banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs toc comment comments reply replies respond discussion disqus footer foot header masthead top"
    " cookie cookies consent notice alert popup modal newsletter subscribe signup login search form share sharing social related recommended more widget tags tag meta author byline copyright legal pager pagination"
    " content article post entry story body text main page blog news lead title headline caption hidden"
).split()
TEXT = (
    "words<4 words<12 words<30 words<80 words>=80 links=0 links<.3 links<.7 links>=.7 ends_sentence ends_colon sentences>1 commas copyright rights cookie click digits shouted first last early late short_and_linked bias"
).split()
NAMES = [f"in {t}" for t in TAGS] + [f"like {h}" for h in HINTS] + TEXT + [f"leaf {t}" for t in TAGS]
PLACE = {n: i for i, n in enumerate(NAMES)}
TAG_BEGIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name. No alternative gives anything back, so a tag is read in one go.
TAG_REST = re.compile(r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
PLAIN_REST = re.compile(r"([^>]*+)>")
HINT_RE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_RE = re.compile(r"[a-z]+")


class Frame:
    """An open element: its tag and the features that it and its ancestors give."""

    __slots__ = ("features", "hidden", "leaf", "linked", "tag")

    def __init__(self, tag: str, features: frozenset, leaf: int | None, linked: bool, hidden: bool = False):
        self.tag, self.features, self.leaf, self.linked, self.hidden = tag, features, leaf, linked, hidden


@lru_cache(maxsize=50_000)
def _own(tag: str, words: str) -> frozenset:
    found = {PLACE[f"in {tag}"]} if f"in {tag}" in PLACE else set()
    return frozenset(found | {PLACE[f"like {w}"] for w in WORD_RE.findall(words) if f"like {w}" in PLACE})


def _opened(parent: Frame, tag: str, attributes: str) -> Frame:
    words = " ".join("".join(m) for m in HINT_RE.findall(attributes)).lower() if "=" in attributes else ""
    own = _own(tag, words)
    return Frame(tag, parent.features | own if own else parent.features, PLACE.get(f"leaf {tag}", parent.leaf) if tag not in INLINE else parent.leaf, parent.linked or tag == "a", parent.hidden or tag in HIDDEN)


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag; name is None for what is no element: comments, declarations, scripts."""
    at, rest, last_close = 0, TAG_REST, {}
    while (start := page.find("<", at)) >= 0:
        begin = TAG_BEGIN.match(page, start)
        if begin is None:
            what = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                # <!--> and <!---> are whole comments
                end = page.find("-->", start + 2)
                at = end + 3 if end >= 0 else len(page)
            elif what in ("!", "?") and (end := page.find(">", start)) >= 0:
                at = end + 1
            else:
                at = start + 1  # a character of the text
                continue
            yield start, at, False, None, ""
            continue
        name = begin[2].lower()
        found = rest.match(page, begin.end())
        if found is None:
            rest = PLAIN_REST
            found = rest.match(page, begin.end())
        if found is None:
            yield start, len(page), False, None, ""
            return
        at = found.end()
        if begin[1]:
            yield start, at, True, name, ""
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield start, at, False, None, ""
            continue
        attributes = found[1]
        if name in HIDDEN and not attributes.endswith("/"):
            if name not in last_close:
                last_close[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
            if last_close[name] < at:
                attributes += "/"  # nothing closes it, so it has no content
        yield start, at, False, name, attributes


def blocks(page: str) -> list[tuple[str, frozenset, int | None, int]]:
    """(text, features of the ancestors, leaf's feature, linked characters) of each block that isn't blank."""
    stack, out, parts, linked, at = [Frame("", frozenset(), None, False)], [], [], 0, 0
    open_tags: Counter = Counter()

    def take(text: str) -> None:
        nonlocal linked
        if stack[-1].hidden:
            return
        parts.append(text)
        if stack[-1].linked:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1].features, stack[-1].leaf, linked))
            parts.clear()
        linked = 0

    def cut(i: int) -> None:
        open_tags.subtract(f.tag for f in stack[i:])
        del stack[i:]

    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            take(page[at:start])
        at = end
        if tag is None:
            continue  # a comment, a declaration or what isn't shown
        if tag == "br":
            take(" ")
            continue
        inline = tag in INLINE or tag in HIDDEN
        if not inline and not stack[-1].hidden:
            flush()
        if closing:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    within = stack[-1].hidden
                    cut(i)
                    if within and not inline and not stack[-1].hidden:
                        flush()
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline tag doesn't end blocks within it
            continue
        if not inline:
            ends = CLOSES_SELF.get(tag, "").split() if tag in CLOSES_SELF else ["p"] if tag in CLOSES_P else []
            for i in range(len(stack) - 1, 0, -1) if any(open_tags[e] for e in ends) else ():
                if stack[i].tag in ends:
                    cut(i)
                    if tag not in ("tr", "thead", "tbody"):
                        break
                elif stack[i].tag not in INLINE and stack[i].tag not in ("tbody", "thead"):
                    break
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append(_opened(stack[-1], tag, attributes))
            open_tags[tag] += 1
    if at < len(page):
        take(page[at:])
    flush()
    return out


def features(found: list) -> list[list[int]]:
    """Places of the features of each block."""
    out, n = [], len(found)
    for i, (text, ancestors, leaf, linked) in enumerate(found):
        own = list(ancestors)
        if leaf is not None:
            own.append(leaf)
        words = text.count(" ") + 1
        share = linked / max(1, len(text))
        low = text.lower()
        add = [
            "words<4" if words < 4 else "words<12" if words < 12 else "words<30" if words < 30 else "words<80" if words < 80 else "words>=80",
            "links=0" if not linked else "links<.3" if share < 0.3 else "links<.7" if share < 0.7 else "links>=.7", "bias",
        ]
        add += [n_ for n_, yes in (
            ("ends_sentence", text[-1] in ".!?…\"”»"), ("ends_colon", text[-1] == ":"), ("sentences>1", ". " in text[:-1]), ("commas", ", " in text), ("copyright", "©" in text or "copyright" in low), ("rights", "rights reserved" in low),
            ("cookie", "cookie" in low), ("click", "click" in low or "subscribe" in low), ("digits", text[0].isdigit()), ("shouted", text.isupper()), ("first", n > 3 and i == 0), ("last", n > 3 and i == n - 1), ("early", n > 3 and i < 0.15 * n), ("late", n > 3 and i >= 0.85 * n),
            ("short_and_linked", words < 6 and share >= 0.7),
        ) if yes]
        own += [PLACE[a] for a in add]
        out.append(own)
    return out


# -- training -----------------------------------------------------------------------------------------------------------

SYLLABLES = "the an er on ti re ing ed es or ou ha st nd at en le de que ment ion un ge sch te ar as la os".split()


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages built from templates, with whether each of their blocks is main text."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(a, b)))
        style = r.random()
        return out.upper() if style < 0.05 else " ".join(w + r.choice(["***", "&amp;&amp;", "%%%", "!!"]) for w in out.split()) if style < 0.12 else out

    def sentence(a: int = 3, b: int = 60) -> str:
        return (words(a, b) + r.choice([".", ".", ".", "!", "?", ""])).capitalize() if r.random() < 0.95 else words(1, 3)

    pages = []
    for _ in range(n):
        labels: list[bool] = []

        def block(inner: str, main: bool, labels=labels) -> str:
            labels.append(main)
            return inner

        def links(k: int) -> str:
            return "<ul" + r.choice(["", ' class="menu"', ' class="links"']) + ">" + "".join(block(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>', False) for _ in range(k)) + "</ul>"

        def boiler(kind: str) -> str:
            if kind == "nav":
                return r.choice(["<nav>%s</nav>", '<div class="nav">%s</div>', '<div id="menu">%s</div>', '<nav class="navbar" role="navigation">%s</nav>', "<div>%s</div>", '<div class="breadcrumbs">%s</div>']) % links(r.randrange(2, 9))
            if kind == "ad":
                return r.choice(['<div class="ad">%s</div>', '<div class="advert"><p>%s</p></div>', '<div id="sponsored">%s</div>', '<aside class="promo"><p>%s</p></aside>', '<div class="ads banner">%s</div>']) % block(sentence(2, 25), False)
            if kind == "aside":
                inner = block(f"<h3>{words(1, 4)}</h3>", False) + (links(r.randrange(1, 6)) if r.random() < 0.6 else "") + "".join(block(f"<p>{sentence()}</p>", False) for _ in range(r.randrange(0, 3)))
                return r.choice(["<aside>%s</aside>", '<div class="sidebar">%s</div>', '<div id="side">%s</div>', '<div class="widget">%s</div>', '<section class="related">%s</section>', '<aside class="related">%s</aside>']) % inner
            if kind == "notice":
                return r.choice(['<div class="cookie-notice"><p>%s</p></div>', '<div id="notice">%s</div>', '<div class="alert" role="alert">%s</div>', '<div class="popup modal"><p>%s</p></div>', '<dialog>%s</dialog>', '<div class="newsletter">%s</div>']) % block(
                    r.choice(["We use cookies. ", "Click to subscribe. ", ""]) + sentence(4, 25), False
                )
            if kind == "form":
                return '<form action="/s">' + block(f"<label>{words(1, 4)}</label> <input name=q>", False) + (block(f"<p>{sentence(3, 15)}</p>", False) if r.random() < 0.5 else "") + block(f"<button>{words(1, 3)}</button>", False) + "</form>"
            if kind == "share":
                return r.choice(['<div class="share">%s</div>', '<div class="social">%s</div>', '<ul class="sharing"><li>%s</li></ul>']) % block(f'<a href="#">{words(1, 3)}</a>', False)
            inner = block(f"<h2>{words(1, 4)}</h2>", False) if r.random() < 0.7 else ""
            for _ in range(r.randrange(1, 6)):
                inner += r.choice(['<div class="comment">%s</div>', "<li>%s</li>", "<article class=\"comment\">%s</article>", "<div>%s</div>"]) % "".join(
                    [block(f'<p class="author">{words(1, 3)}</p>', False) if r.random() < 0.5 else "", *(block(f"<p>{sentence()}</p>", False) for _ in range(r.randrange(1, 3)))]
                )
            return r.choice(['<section class="comments">%s</section>', '<div id="comments">%s</div>', '<div class="discussion replies">%s</div>', '<section id="respond" class="comments">%s</section>']) % inner

        def main_block() -> str:
            x = r.random()
            if x < 0.8:
                inner = sentence() if r.random() < 0.85 else f'{sentence()} <a href="#">{words(1, 3)}</a> {sentence()}'
                return block(r.choice(["<p>%s</p>"] * 8 + ["<p><b>%s<br>", "<p><em>%s</em></p>", "<p class=\"text\">%s</p>", "<div>%s</div>"]) % inner, True)
            if x < 0.88:
                return block("<h%d>%s</h%d>" % (h := r.randrange(2, 5), words(1, 7), h), True)
            if x < 0.93:
                return "<ul>" + "".join(block(f"<li>{sentence(1, 15)}</li>", True) for _ in range(r.randrange(1, 5))) + "</ul>"
            if x < 0.96:
                return "<blockquote>" + block(f"<p>{sentence()}</p>", True) + "</blockquote>"
            if x < 0.98:
                return "<table>" + "".join("<tr>" + block(f"<td>{words(1, 4)}</td>", True) + block(f"<td>{words(1, 4)}</td>", True) + "</tr>" for _ in range(2)) + "</table>"
            return "<figure><img src=x>" + block(f"<figcaption>{sentence(2, 12)}</figcaption>", True) + "</figure>"

        title, bare = words(1, 8), r.random() < 0.2  # a bare page has little besides its article
        page = "<!DOCTYPE html><html><head><meta charset=utf-8>" + (block(f"<title>{title}</title>", False) if r.random() < 0.8 else "") + "<style>p{}</style><script>var a='<p>';</script></head><body" + r.choice(["", ' class="page"', ' class="single post"']) + ">"
        if r.random() < 0.5 and not bare:
            page += r.choice(["<header>%s</header>", '<div class="header">%s</div>', '<div id="masthead">%s</div>']) % (block(r.choice(["<h1>%s</h1>", '<a href="/">%s</a>', "<p>%s</p>"]) % words(1, 5), False) + (boiler("nav") if r.random() < 0.5 else ""))
        for kind in ("nav", "ad", "notice", "form", "aside"):
            if r.random() < (0.1 if bare else 0.7 if kind == "nav" else 0.3):
                page += boiler(kind)
        inner = ""
        if r.random() < 0.75:
            inner += r.choice(["%s"] * 3 + ["<header>%s</header>"]) % block(f"<h1>{title}</h1>", True)
        for _ in range(r.randrange(1, 4 if bare else 12) if r.random() < 0.9 else r.randrange(12, 40)):
            inner += main_block()
            if r.random() < 0.06:
                inner += boiler(r.choice(["ad", "ad", "share", "aside", "form", "nav"]))
        if r.random() < 0.2:
            inner += boiler("share")
        if r.random() < 0.15:
            inner += boiler("comments")
        page += r.choice(["<article>%s</article>"] * 5 + ["<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<div id="content"><div class="post">%s</div></div>', '<div class="entry-content">%s</div>', '<div class="article-body">%s</div>', "<div>%s</div>", '<section class="story">%s</section>', "%s"]) % inner
        for kind in ("comments", "aside", "ad", "form", "notice", "nav", "share"):
            if r.random() < (0.03 if bare else 0.25):
                page += boiler(kind)
        if r.random() < (0.3 if bare else 0.85):
            foot = block(r.choice(["<p>%s</p>", "%s", "<div>%s</div>"]) % (r.choice(["&copy; ", "Copyright ", ""]) + sentence(2, 25) + r.choice(["", " All rights reserved."])), False)
            page += r.choice(["<footer>%s</footer>"] * 3 + ['<div class="footer">%s</div>', '<div id="foot">%s</div>']) % ((boiler("nav") if r.random() < 0.3 else "") + foot)
        pages.append((page + r.choice(["</body></html>", "</body></html>", ""]), labels))
    for _ in range(n // 16):  # fragments: paragraphs and nothing else
        k = r.randrange(1, 5)
        pages.append(("".join(f"<p>{sentence()}</p>" for _ in range(k)), [True] * k))
    return pages


class Chain:
    """Weights of main text against the rest, of the four steps between labels, and of each label at the ends."""

    def __init__(self):
        self.weight, self.step, self.begin, self.end = np.zeros(len(NAMES)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def emissions(self, places: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(p) for p in places])
        flat = np.fromiter((x for p in places for x in p), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes) if len(flat) else np.zeros(0)

    def decode(self, emission: list[float]) -> list[bool]:
        """The likeliest labels of one page (Viterbi)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.begin[0], self.begin[1] + emission[0]
        back = []
        for e in emission[1:]:
            from0, from1 = a + s01 > b + s11, a + s00 >= b + s10
            back.append((from1, from0))
            a, b = (a + s00 if from1 else b + s10), (a + s01 if from0 else b + s11) + e
        now = b + self.end[1] > a + self.end[0]
        out = [now]
        for to0, to1 in reversed(back):
            now = not (to1 if now else to0)
            out.append(now)
        return [bool(x) for x in out[::-1]]


def trained(pages: list[tuple[str, list[bool]]], rounds: int = 70, rate: float = 0.2, ridge: float = 2e-4) -> Chain:
    """A chain of highest penalised likelihood, by full-batch steps of Adam."""
    rows, sizes, gold = [], [], []
    for page, labels in pages:
        found = features(blocks(page))
        if len(found) == len(labels) and found:
            rows += found
            sizes.append(len(found))
            gold += labels
    n, longest = len(sizes), max(sizes)
    dense = np.zeros((len(rows), len(NAMES)))
    for i, p in enumerate(rows):
        dense[i, p] = 1
    seat = np.concatenate([k * longest + np.arange(s) for k, s in enumerate(sizes)])
    y = np.zeros(n * longest, int)
    y[seat] = gold
    y, size, chain = y.reshape(n, longest), np.array(sizes), Chain()
    live = np.arange(longest)[None, :] < size[:, None]
    shape = [len(NAMES), 4, 2, 2]
    theta, m, v = np.zeros(sum(shape)), np.zeros(sum(shape)), np.zeros(sum(shape))
    for t in range(1, rounds + 1):
        weight, step, begin, end = np.split(theta, np.cumsum(shape)[:-1])
        step = step.reshape(2, 2)
        e = np.zeros(n * longest)
        e[seat] = dense @ weight
        e = np.stack([np.zeros((n, longest)), e.reshape(n, longest)], axis=2)
        f, b = np.empty_like(e), np.zeros_like(e)
        f[:, 0] = begin + e[:, 0]
        for i in range(1, longest):
            f[:, i] = np.logaddexp(f[:, i - 1, 0, None] + step[0], f[:, i - 1, 1, None] + step[1]) + e[:, i]
        last = np.arange(n), size - 1
        for i in range(longest - 1, -1, -1):
            at_end = (size - 1 == i)[:, None]
            if i + 1 < longest:
                nxt = b[:, i + 1] + e[:, i + 1]
                b[:, i] = np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None])
            b[:, i] = np.where(at_end, end, b[:, i])
        z = np.logaddexp(*(f[last] + end).T)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        g_weight = dense.T @ ((y == 1) - p[:, :, 1]).ravel()[seat]
        pair = np.exp(f[:, :-1, :, None] + step + (b + e)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        hot = lambda x: np.stack([x == 0, x == 1], axis=1).sum(axis=0)
        grad = np.concatenate([g_weight, (seen - pair.sum(axis=(0, 1))).ravel(), hot(y[:, 0]) - p[:, 0].sum(axis=0), hot(y[last]) - p[last].sum(axis=0)]) / len(gold) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    chain.weight, step, chain.begin, chain.end = np.split(theta, np.cumsum(shape)[:-1])
    chain.step = step.reshape(2, 2)
    return chain


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return trained(labelled_pages())


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, main in zip(found, chain.decode(chain.emissions(features(found)).tolist()), strict=True) if main)


def extracted(pages: DataFrame, chain: Chain | None = None, html_column: str = "html") -> DataFrame:
    """pages without html, with text (of the main blocks, one a line) and n_chars (its code points)."""
    chain = chain or default_chain()
    names = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    pages = pages.select(*names, html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p, chain) if p else "" for p in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars long")

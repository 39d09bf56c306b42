"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat text blocks. A block has these features:
its words and link density (words inside links per word), those of the block before and
after, whether it is a heading or list item, whether an article or main element is open
around it, whether it stands in the margins: in a boilerplate element (nav, aside,
footer, header outside an article, form, ...) or one that is named like boilerplate
(class, id, role: advert, comments, cookie, sidebar, ...); and whether an open element
has a name that may mean either (meta, popular, notice, ...).
Elements and names outside an article do not count inside it, nor do those that wrap
most of the running text of the page (a form around everything), replies excepted. A
CART tree, grown on the small labelled table PAGES below, keeps or drops each block:
where elements and names say nothing, words and link density of the block and of its
neighbours decide. Kept blocks are joined by one newline in page order; white space
inside a block becomes one space.

Scripts, styles, templates, titles, comments and tags are no text; character references
are decoded after tags are cut. A line break is white space, two in a row end a block.
End tags may be missing: an iframe, object, select, svg, ... that is not closed is a tag
without content, so that what follows stays; head needs no end. Truncated and badly
nested pages are read as far as they go, very long ones whole, in one pass.
Nulls: a null or empty page has an empty text. Repeated rows give equal results; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: A raw element ends at its end tag. Without one, script and style run to the end of the page, as in browsers;
#: of the others only the tag itself goes (a title ends at the next tag).
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|textarea|select|object|canvas)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?!<\2\b).)*?</\2\s*>"
    r"|<(title)\b[^<>]*>.*?(?:</title\s*>|(?=<(?!/?title))|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
HOLDERS = frozenset("address article aside blockquote button details dialog div dl fieldset figure footer form header label li main menu nav ol p section summary table ul a span".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME = frozenset("nav aside footer form menu button label fieldset dialog address".split())
#: elements that are margins however much they hold
FIRM = frozenset("nav aside footer header menu".split())
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names of boilerplate: parts of a class, id or role between spaces, hyphens and underscores. These are features of
#: a block; an element that wraps an article, or most of the page's running text, does not pass its name on.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|"
    r"share|sharing|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|popup|modal|contentinfo|complementary|dialog)(?:$|[\s_-]|\d)",
    re.I,
)
#: names that hold however much they wrap
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|respond|replies|disqus)(?:$|[\s_-]|\d)", re.I)
#: names that count as a whole class or id only: words that texts are named by as well
WEAK = re.compile(r"(?:^|\s)(?:side|rail|banner|(?:[\w]+-)?notices?|alert|notification|legal|disclaimer|copyright|foot|social|follow|popular|trending|search|overlay|skip|tags|meta|byline|copyright-notice)\d*(?:$|\s)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
LABEL = "data-main"
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "article", "margin", "weak")
#: a block of running text: this many words or more, fewer than this part of them linked
RUNNING, LINKED = 15, 0.3


class Block:
    __slots__ = ("article", "chrome", "heading", "hint", "holders", "item", "linked", "main", "replies", "text", "weak", "words")

    def __init__(self, text: str, words: int, linked: int, depth: dict[str, int], holders: list[Holder]):
        self.text, self.words, self.linked, self.holders = text, words, linked, holders
        self.heading, self.item, self.article, self.main = (depth[k] > 0 for k in ("h", "li", "article", "main"))
        self.replies, self.weak = depth["replies"] > 0, depth["weak"] > 0
        self.chrome = self.hint = False


class Holder:
    """An open element of boilerplate, by its kind or by its name, and the running text in it."""

    __slots__ = ("blocks", "chrome", "firm", "words")

    def __init__(self, chrome: bool, firm: bool):
        self.chrome, self.firm, self.words, self.blocks = chrome, firm, 0, 0


def _names(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is named like boilerplate, like replies, and like either (weakly)."""
    hint, replies, weak = bool(HIDDEN.search(attributes)), False, False
    for m in NAMED.finditer(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "")
        hint, replies, weak = hint or bool(HINT.search(value)), replies or bool(REPLIES.search(value)), weak or bool(WEAK.search(value))
    return hint, replies, weak


class Open:
    """An open element."""

    __slots__ = ("article", "holder", "main", "name", "replies", "weak")

    def __init__(self, name: str, attributes: str, in_article: bool):
        hint, self.replies, self.weak = _names(attributes) if attributes else (False, False, False)
        chrome = name in CHROME or (name == "header" and not in_article)
        self.name, self.main, self.article = name, LABEL in attributes, name in ("article", "main")
        self.holder = Holder(chrome, name in FIRM) if chrome or hint else None


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    open_tags: list[Open] = []
    many: dict[str, int] = {}  # open elements by name
    depth = dict.fromkeys(("a", "article", "main", "li", "h", "replies", "weak"), 0)
    holders: list[Holder] = []  # open ones since the innermost article
    aside: list[list[Holder]] = []  # those outside each open article
    breaks = 0

    def enter(tag: Open, by: int) -> None:
        many[tag.name] = many.get(tag.name, 0) + by
        for key in ("article", "main", "replies", "weak"):
            depth[key] += by * getattr(tag, key)
        depth["a"] += by * (tag.name == "a")
        depth["li"] += by * (tag.name == "li")
        depth["h"] += by * (len(tag.name) == 2 and tag.name[0] == "h" and tag.name[1].isdigit())

    def opened(tag: Open) -> None:
        open_tags.append(tag)
        enter(tag, 1)
        if tag.article:
            aside.append(list(holders))
            holders.clear()
        if tag.holder:
            holders.append(tag.holder)

    def close_from(at: int) -> None:
        for tag in reversed(open_tags[at:]):
            enter(tag, -1)
            if tag.holder:
                holders.pop()
            if tag.article:
                holders[:] = aside.pop()
        del open_tags[at:]

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            linked = len("".join(linked_parts).split())
            out.append(Block(" ".join(words), len(words), linked, depth, list(holders)))
            for holder in holders:
                holder.words += len(words) - linked
                holder.blocks += len(words) >= RUNNING and linked < LINKED * len(words)
        parts.clear()
        linked_parts.clear()

    def text(raw: str) -> None:
        nonlocal breaks
        if not raw:
            return
        if breaks and not raw.isspace():
            breaks = 0
        raw = entities.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if depth["a"]:
            linked_parts.append(raw)

    at = 0
    for m in TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        raw = m[1] or m[2] or m[3]
        if raw:
            if raw.lower() == "title":
                flush()
            elif raw.lower() not in ("object", "canvas", "svg"):
                parts.append(" ")
            continue
        name = (m[5] or m[8] or "").lower()
        if not name:
            continue
        closing, attributes = m[4] or m[7] or "", (m[6] or m[9] or "")
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in BLOCKS:
            flush()
            breaks = 0
        elif name in ("td", "th"):
            parts.append(" ")
        if closing:
            if many.get(name) and (name in HOLDERS or heading):
                close_from(next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i].name == name))
        elif (name in HOLDERS or heading) and name not in VOID and not attributes.endswith("/"):
            if many.get(name) and (name in ("p", "li", "a") or heading):  # these close an open one of their kind
                known = next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i].name == name or open_tags[i].name in ("ul", "ol", "div", "section", "article", "table"))
                if open_tags[known].name == name:
                    close_from(known)
            opened(Open(name, attributes, depth["article"] > 0))
    text(page[at:])
    flush()
    total = sum(b.words - b.linked for b in out)
    for b in out:
        # an element that wraps most of the running text of the page is no part of its margins
        for holder in b.holders:
            if holder.firm or not (holder.blocks >= 3 and 2 * holder.words > total):
                b.chrome |= holder.chrome
                b.hint |= not holder.chrome
        b.hint |= b.replies
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    words = np.array([0, *(b.words for b in blocks), 0], float)
    links = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    flags = np.array([(b.heading, b.item, b.article, b.chrome or b.hint, b.weak) for b in blocks], float).reshape(n, 5)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags])


class Tree:
    """A CART tree (Gini) of two classes (the least leaf was chosen by leaving out one page at a time); splits and ties are in feature and value order, so it is the same everywhere."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, leaf: int = 4):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y, depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(y.mean() >= 0.5)))
        if not depth or y.min() == y.max():
            return at
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                if leaf <= low.sum() <= len(y) - leaf:
                    impurity = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (y[low], y[~low]))
                    if impurity < best[0] - 1e-9:
                        best = (impurity, f, float(cut))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left = self._grow(x[low], y[low], depth - 1, leaf)
            right = self._grow(x[~low], y[~low], depth - 1, leaf)
            self.nodes[at] = (best[1], best[2], left, right, self.nodes[at][4])
        return at

    def keeps(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for i, row in enumerate(x.tolist()):
            at = 0
            while self.nodes[at][0] >= 0:
                f, cut, left, right, _ = self.nodes[at]
                at = left if row[f] <= cut else right
            out[i] = self.nodes[at][4]
        return out


#: The labelled table: pages whose main blocks lie in elements marked data-main.
PAGES = (
    """<html><head><title>Harbour</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav><div class="ad">Buy two pairs of boots and get one more for free today.</div>
    <article data-main><h1>The harbour opens again</h1><p>The harbour opened again on Monday after a long winter of repairs, and the first boats left before dawn with full crews.</p><p>It rained.</p><p>Many of the owners had waited since autumn for the new pier, which is longer and lower than the old one was.</p><p>Not all.</p></article>
    <footer>Copyright of the harbour paper. All the words are ours.</footer></body></html>""",
    """<body><header><a href="/">The Daily</a><p>News and views since the year of the flood</p></header><div id="cookie-notice">We use cookies to make this site work better for you and for our partners. Please read our policy.</div>
    <main><h1 data-main>How to bake bread</h1><p data-main>Mix the flour with water and salt, leave it alone for a night, and shape it in the morning with wet hands.</p><h2 data-main>Oven</h2><p data-main>Hot.</p><ul data-main><li>Flour, a pound of it</li><li>Salt</li><li>Water from the tap</li></ul><p data-main>Bake it until the crust is dark and the loaf sounds hollow, then let it cool on a rack.</p>
    <section class="comments"><h3>Comments</h3><p>I tried this last week and it was the best bread that I have ever made in my own kitchen, thank you so much for it.</p><p>Me too.</p></section></main><aside><h3>Most read</h3><ul><li><a href="/a">Ten soups for cold days</a></li><li><a href="/b">Why knives matter</a></li></ul></aside></body>""",
    """<div id="page"><div class="topbar"><a href="/in">Sign in</a> <a href="/up">Sign up</a></div><div class="sidebar"><p>About the author of this site, who has been writing about birds for twenty years and lives near the coast with two dogs.</p></div>
    <div class="content"><h1 data-main>Birds of the marsh</h1><p data-main>The marsh is home to more kinds of birds than any other place in the county, and most of them stay through the winter months.</p><p data-main>Geese come first, in long lines, and settle on the wet fields to the north of the road where nobody walks.</p><blockquote data-main>They never leave.</blockquote></div>
    <form action="/q"><label>Name</label><p>Tell us what you think of the site and we will write back to you within three days of your letter.</p><button>Send</button></form><div class="footer">Terms of use and privacy policy apply to every page of this site.</div></div>""",
    """<body><div><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a> <a href="/4">Four</a></div><div data-main><p>A plain page may have no names at all on its elements, and then only the words and the links can tell what is text.</p><p>This paragraph has <a href="/x">one link</a> in it, but most of its words are not linked, so that it is part of the text that people come to read.</p></div>
    <div><a href="/p">Previous</a> | <a href="/n">Next</a></div><div>Hosted by us</div></body>""",
    """<article><header data-main><h1>Rivers in spring</h1></header><div class="share"><a href="/t">Share this</a> Tell your friends about it</div><p data-main>Rivers rise in spring when the snow melts on the high ground, and the valleys fill with brown water for a week or two.</p><div class="advert">An offer for our readers: maps at half the price until the end of May.</div><p data-main>Then they fall.</p>
    <p data-main>By the summer most of them can be crossed on foot by anyone who does not mind getting wet.</p><div id="comments"><p>My grandfather used to tell us how the whole village stood in water up to the windows in that year.</p></div></article><nav><a href="/b">Back to the start</a></nav><footer><p>Written and printed in the valley, for the valley and by the people of the valley since long ago.</p></footer>""",
    """<body><div class="menu"><ul><li>Start</li><li>Shop</li><li>Help and contact for all our customers</li></ul></div><div role="banner">Free delivery on every order this week only</div><table data-main><tr><td>Height</td><td>12 m</td></tr><tr><td>Weight of the whole tower without the bells</td><td>40 t</td></tr></table><p data-main>The tower was built by the same masons who built the bridge, and it shows in the stones around the door and the windows.</p>
    <div class="related-posts"><h4>Related</h4><p>Read more about towers, bridges and walls in our long series about the masons of the county.</p></div><div class="newsletter-signup">Get our letter every Friday. No spam, ever.</div></body>""",
    """<article data-main><p><b>The night train left at ten.<br><p>Nobody spoke.</p><p>Ok.</p></article><div class="ad">Sleep better with our pillows.</div><nav><ul><li><a href="/z">zeta</a></li></ul></nav><footer>&copy; trains &middot; Every line of the land. Late again.</footer>""",
    """<body><div>Menu</div><h2 data-main>Notes on salt</h2><p data-main>Salt was worth more than silver in the hills, where there was none, and the roads that carried it are still there under the grass.</p><p data-main>It was cut in blocks and moved by mule, four blocks to a mule and ten mules to a man, for eleven days each way.</p><div>Page 3 of 9</div><ul><li><a href="/1">Contact</a></li><li><a href="/2">Imprint</a></li></ul></body>""",
    """<body class="blog"><div class="layout-side"><div><a href="/">Start</a> <a href="/all">All texts</a></div><article data-main><h1>On walls</h1><p>Dry walls stand for a hundred years if the stones are laid so that each of them rests on two others below it.</p><p class="meta">Nobody knows who built the first one, but the farms on the northern side were there before the church was.</p><p class="follow-up">The second winter showed which of the walls had been laid in haste, and most of them were.</p><p class="popular-science">Frost lifts the ground by the width of a hand, and what stands on it has to move or break.</p><p>See <a href="/1">the map of all the walls</a>, <a href="/2">the list of builders</a> and <a href="/3">the old report of the county</a> for more.</p><p>They are mended in May.</p></article></div><div>Page 1 of 4</div></body>""",
    """<div><div><a href="/a">Home</a></div><div><a href="/b">Archive</a></div><div><a href="/c">Contact us</a></div><div data-main>The ferry to the island leaves twice a day in summer and once in winter, if the wind allows it at all.</div><div data-main>In 1911 it did not come for forty days.</div><div data-main>People ate what they had stored, and when the boat came at last it brought only newspapers, as the tale goes on the island.</div><div data-main>It is told with pride, and the captain's <a href="/log">log book of that winter and the next</a> is shown to every visitor who asks for it.</div><div><a href="/d">Older text</a></div><div><a href="/e">Newer text</a></div><div>All rights reserved</div></div>""",
    """<table><tr><td><a href="/1">Index</a></td></tr></table><p>Log in to vote</p><h1 data-main>A clock without hands</h1><p data-main>The clock on the tower has had no hands since the storm, yet it strikes every hour and the town goes by the sound.</p><p data-main>Why not?</p><p data-main>A new pair would cost less than the scaffold that it takes to put them up, the council says each spring.</p><p data-main>So it stays.</p><p data-main>Visitors take pictures of it and ask in the shop what time it is, which the shop does not mind at all.</p><p><a href="/x">Back</a> to the <a href="/y">front page</a></p><p>Contact the editor</p>""",
    """<form id="aspnetForm" action="/"><div id="wrapper" class="page has-sidebar"><ul class="menu"><li><a href="/">Home</a></li><li>Our shop</li></ul><h2 data-main>Bees on the roof</h2><p data-main>Two hives stand on the roof of the library, and the bees fly to the lime trees along the river in June.</p><p data-main>The first honey was dark, because the trees were full of aphids that year, and it tasted of malt and smoke.</p><p data-main>Whoever returns a book on time in August gets a spoon of it, and the line is long on the last day.</p><p data-main>Stings are rare.</p><div class="newsletter"><p>Get news about the library once a month by mail and never miss a book sale or a reading again.</p></div><p class="copyright">The library and its friends</p></div></form>""",
    """<main><p class="byline">By our own writer</p><h1 data-main>Maps of the fen</h1><p data-main>Every map of the fen is wrong within ten years, since the ditches move and the paths move with them.</p><ul data-main><li>The first was drawn by a priest who never left his house</li><li>The second shows a lake</li><li><a href="/lake">The lake</a> was a mistake</li></ul><p data-main>The third is used to this day by those who cut reed and by those who look for them in fog.</p><p class="tags">fen maps reed</p><div class="social">Tell others</div><section id="replies"><article><p>I have walked there for thirty years and never needed a map, only good boots and a dog that knows the way home.</p></article><article><p>Which dog?</p></article></section></main>""",
    """<body><p><a href="/en">English</a> <a href="/fr">Français</a></p><p>You are here: <a href="/">Top</a></p><p data-main>Glass was made in the forest because the furnaces ate more wood than any road could bring to the town.</p><p data-main>When a valley was bare the whole works moved on, with the pots and the tools and the children, to the next one.</p><p data-main><a href="/w1">Waldhof</a>, <a href="/w2">Glashütte</a> and <a href="/w3">Ofenbach</a> are names that were left behind in this way.</p><p data-main>Green was the cheapest colour, as it came from the sand itself, and clear glass was for churches and kings.</p><p><a href="/p">Print</a></p><p>Seen 312 times</p><p><a href="/q">Report a mistake</a></p></body>""",
    """<body><div id="alert" class="alert">The office is closed on Friday.</div><div class="banner">Winter sale in all our shops</div><div data-main><h1>How snow is counted</h1><p>A stake with marks stands on every pass, and somebody looks at it each morning at seven and writes the number down.</p><p>The numbers go back to the year in which the road was built, and they have been falling since the war.</p><p>Not every year.</p><p>In the worst of winters the stake itself was not to be seen, and the book says only: more.</p></div><div class="legal">Prices are given without tax.</div><div><a href="/i">Imprint</a></div></body>""",
    """<div><p>Sign in or register</p><p>Basket is empty</p><p data-main>The pans are cast in sand, one mould for each, and the mould is broken to get the pan out of it.</p><p data-main>Handles come later.</p><p data-main>A pan that rings when it is struck is sound, and one that does not goes back into the fire with the others of the day.</p><p data-main>About one in nine.</p><p data-main>The men who strike them are nearly deaf, and they say that they hear it in the wrist and not in the ear.</p><p>Free returns</p><p>Pay by card</p><p><a href="/t">Terms</a></p></div>""",
    """<article><nav><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></nav><h2 data-main>Lamps</h2><p data-main>Oil.</p><p data-main>The first lamps burned whatever oil there was, and the rooms smelled of fish or of olives by where one lived.</p><figure data-main><img src="x.png"><figcaption>A lamp of the third century</figcaption></figure><div class="related"><p>Read more on candles, on torches and on the long night of the year in our winter series from the north.</p></div><p data-main>Then gas came.</p></article><aside><p>Our reporters are out in all weathers to bring the light of truth to your home, and you can help them to go on.</p></aside>""",
    """<article data-main><h1>Only a text</h1><p>Some pages hold nothing but the text itself, from the first line to the last, and end with it.</p></article>""",
    """<div data-main><p>A page may well be cut off before its end, and then the last block that is there belongs to the text like the others.</p></div>""",
    """<p data-main>One single paragraph is a page too, if there is nothing else on it, and nothing before or after it can tell more.</p>""",
    """<article data-main><p>Short texts end soon.</p><p>Ask for more.</p></article>""",
    """<article data-main><h1>Stone</h1><p>Granite.</p></article>""",
    """<nav><a href="/">Home</a> <a href="/n">News</a></nav><main data-main><h2>Where to read on</h2><p>The best book on the old roads is <a href="/b">the one by the two sisters from the mill</a>, which is <a href="/c">out of print</a> but can be <a href="/d">read here</a>.</p><p>Another one, <a href="/e">by their brother</a>, is longer and has better drawings of the bridges that fell in the flood.</p></main>""",
    """<div><a href="/">Home</a> <a href="/z">Zoo</a></div><div data-main>The bear was brought by train in a crate with three locks, and it slept from one end of the country to the other.</div><div data-main>It woke up in the market hall, where nobody was glad to see it, and went to sleep again among the cabbages.</div>""",
    """<div><p data-main>The kiln is filled in March and lit in April, when the wind comes from the sea and keeps the smoke away.</p><p data-main>Those who want to see it can come by <a href="/boat">the morning boat</a> or walk <a href="/path">along the cliff path</a>, which takes an hour.</p><p data-main>It burns for nine days and nights, and two people sit by it at all times with a book and a bucket.</p></div>""",
    """<body><p data-main>Each of the seven villages had a baker once, and each of the bakers had a bread that the others could not make.</p><p data-main><a href="/v1">Upper village</a>, <a href="/v2">Lower village</a> and <a href="/v3">Mill village</a> still have theirs, all others buy it.</p><p data-main>The rye comes from the plain and is ground by water, at night, since the mill sells its power by day to the town.</p><footer>Made by the seven villages</footer></body>""",
    """<section data-main><h3>Wells</h3><p>The deepest of them is as deep as the tower is high, which was done on purpose, as the story has it.</p><p>Its water is cold.</p></section>""",
    """<article data-main><p>The road over the moor was laid by soldiers who had nothing else to do between two wars, and it shows.</p><p>See <a href="/1">the milestones</a> and <a href="/2">the inn</a>.</p><p>It goes straight where it should bend, and it bends where a general had lunch, as they say on the moor.</p><p><a href="/3">The inn of the two foxes</a> is still open.</p><p>Beds are hard and the beer is good, and the same family has kept the house for as long as there was a road.</p></article><div><a href="/4">Older</a> <a href="/5">Newer</a></div>""",
    """<div><a href="/">All texts</a></div><article data-main><h1>Sources</h1><p>Everything that is known of the singer comes from four letters and a bill for candles that was never paid.</p><p><a href="/l1">The first letter</a> and <a href="/l2">the second</a> are in the town archive, the others in private hands.</p><p>All of them are short, and one is only an excuse for being late with another, which has not been found.</p><p>The bill: <a href="/bill">forty candles, white</a></p></article><div>Read by <a href="/r">nine people</a></div><div><a href="/top">To the top of the page</a></div>""",
    """<header><div class="topbar"><p>Call us now</p></div><div class="menu"><p>Menu</p><p>More</p></div></header><article data-main><h1>Eels</h1><p>They come up the river in May, on nights without a moon, and nobody has ever seen where they come from.</p><p>They taste of mud.</p><p>The trap is a basket with a door that opens only one way, and it is set where the bank is steep.</p></article><div class="cookie-bar"><p>We use cookies.</p><p>Accept</p></div><div class="share"><p>Share this text with your friends</p></div><form><label>Your mail</label><p>We write once a month</p><button>Send</button></form><div class="related"><p>More on fish and rivers</p></div><div class="footer"><p>Printed on the river</p><p>Imprint</p></div>""",
    """<div class="ad"><p>Boots at half price</p></div><div class="login"><p>Sign in</p></div><div class="content"><h2 data-main>Smoke</h2><p data-main>It rises straight on the day before snow, or so the shepherds say, and they are right more often than not.</p><div class="promo"><p>Order our calendar for the next year now</p></div><p data-main>On other days it lies in the valley.</p><p data-main>Whoever wants to know more has to ask the wind, which answers in its own time and seldom to the point.</p></div><div class="widget"><p>Weather: dry</p></div><div class="sidebar"><p>Most read</p><p>Ten ways to stack wood</p></div><div class="comments"><p>So true</p><p>My uncle says the same of fog.</p></div><footer><p>Since 1889</p></footer>""",
    """<aside><p>Today: sunny</p></aside><form><p>Search this site</p></form><main data-main><p>Ink was made of galls.</p><p>They were crushed and left in rain water for a week, and then iron was added until it turned as black as the night.</p><p>It eats the paper in the end.</p></main><div class="banner"><p>Spring sale</p></div><div id="cookie-consent"><p>This site sets cookies for its own ends and for those of others who pay for it</p><button>Fine</button></div><div class="pagination"><p>1 2 3</p></div><div class="newsletter"><p>Stay in touch</p></div>""",
    """<div class="side"><article data-main><h1>Left bank</h1><p class="legal">The law of the river gives every house on the left bank the right to as much water as a horse can carry in a day.</p><p>Few keep a horse.</p><p class="search">They searched the bed of the old arm for the bell that was lost there, and found nine anchors and a plough instead.</p></article></div>""",
    """<article data-main><p class="popular">Most of those who came to see the comet came for the soup that was sold on the hill, and said so in their letters.</p><p class="notice">It was noticed first by a boy who had been sent out to look for goats and came back without them at dawn.</p><p class="tags">Nobody tagged the trees that were to be felled, so that in the end the wrong ones fell, all along the western road.</p></article><p class="meta">Posted on Monday</p><p class="social">Tell a friend</p>""",
)


def fit_tree() -> Tree:
    """The tree of the labelled table."""
    x, y = [], []
    for page in PAGES:
        blocks = blocks_of(page)
        x.append(features_of(blocks))
        y += [b.main for b in blocks]
    return Tree(np.concatenate(x), np.array(y, float))


def extract(page: str | None, tree: Tree) -> str:
    """The main text of a page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    keep = tree.keeps(features_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    ship(pages.sparkSession)
    tree = fit_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(v.as_py(), tree) for v in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main-text extraction from flat text blocks (operator 1).

A page is cut into flat blocks at block-level tags. Every block gets its word
count and link density, those of its neighbours, and what its place says
(inside an element that by tag or class name is furniture, or content; a
heading; ends like a sentence). A class or id token counts as a furniture name
only as a whole, and never on ``article``, ``main`` or ``body``; elements that
are not shown (``hidden``, ``aria-hidden``, inline style) count as furniture. A decision tree, trained on the small labelled
table below by Gini impurity, says which blocks are main text.

Scripts, styles and other invisible elements never make blocks. Character
references are decoded, white space inside a block (``<br>`` included) becomes
one space, blocks are joined in page order by one newline.

Edge cases: null or empty html, and pages without main text, give an empty
text. Broken markup is read as far as it goes: an unclosed tag is text, an
unclosed script or comment runs to the end, a stray end tag is ignored. Very
long pages are one row's work and never cut. Repeated rows give one row each;
a null page_id or url is carried through. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices

# Element names by role.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select",
          "head", "audio", "video")
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Class and id words that tell furniture from content.
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline
comment comments consent cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr header hidden
links login masthead menu menus message modal nav navbar navigation newsletter notice notices notification overlay
pager pagination popup privacy promo promoted promotion recommended related replies reply respond responses search
share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar warning
widget widgets""".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Parts of a class or id that say only where or in what shape: side-by-side with a furniture word they change nothing.
LAYOUT_WORDS = frozenset("""area bar block blocks bottom box col column container global group holder inner item items
layer left list outer page panel primary right row secondary section site top wrap wrapper""".split())
#: What these elements are is not for their class words to say; those of a body often tell about the rest of the page.
FIRM_TAGS = CONTENT_TAGS | {"body", "html"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|"
    r"<(?P<hidden>" + "|".join(HIDDEN) + r")\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=hidden)\s*>|\Z))|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_MARK = re.compile(r"""\bdata-main\s*=\s*"([01])""")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("parts", "words", "link_words", "furniture", "content", "heading", "mark", "text")

    def __init__(self, furniture: bool, content: bool, heading: bool, mark: int | None):
        self.parts: list[str] = []
        self.words = self.link_words = 0
        self.furniture, self.content, self.heading, self.mark = furniture, content, heading, mark
        self.text = ""


def _named_furniture(token: str) -> tuple[bool, set[str]]:
    """(is the class or id token as a whole a furniture name, its words): ``cookie-banner`` is, ``has-sidebar`` is not."""
    words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
    known = words <= FURNITURE_WORDS | CONTENT_WORDS | LAYOUT_WORDS
    return known and not words.isdisjoint(FURNITURE_WORDS), words


def _roles(tag: str, attrs: str) -> tuple[bool, bool]:
    """(furniture, content) by the element's name, its class, id and role words, and whether it is shown."""
    furniture, content = tag in FURNITURE_TAGS, tag in CONTENT_TAGS
    if attrs and not attrs.isspace():
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "style" and _GONE.search(value) or (
                    name == "aria-hidden" and value.strip().lower() == "true"):
                return True, False
            if name in ("class", "id", "role"):
                for token in value.split():
                    named, words = _named_furniture(token)
                    furniture = furniture or named and tag not in FIRM_TAGS
                    content = content or tag not in ("body", "html") and not words.isdisjoint(CONTENT_WORDS)
    return furniture, content and not furniture


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty text blocks in order."""
    out: list[Block] = []
    if not page:
        return out
    # Open elements: (tag, furniture, content, label), with what encloses them folded in.
    stack: list[tuple[str, bool, bool, int | None]] = []
    links = 0
    current: Block | None = None

    def close() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                current.words = current.text.count(" ") + 1
                current.link_words = min(current.link_words, current.words)
                out.append(current)
            current = None

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if current is None:
                if text.isspace():
                    continue
                top = stack[-1] if stack else ("", False, False, None)
                heading = any(len(t[0]) == 2 and t[0][0] == "h" and t[0][1] in "123456" for t in stack[-3:])
                current = Block(top[1], top[2], heading, top[3])
            if "&" in text:
                text = html.unescape(text)
            current.parts.append(text)
            if links:
                current.link_words += len(text.split())
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        attrs = m["attrs"]
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag == "a":
            links = 1
        if tag in BLOCK and stack and stack[-1][0] != tag:
            # A block element ends an open paragraph, with the inline elements in it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    links = 0
                    break
                if stack[i][0] in BLOCK:
                    break
        elif tag in ("p", "li") and stack and stack[-1][0] == tag:
            stack.pop()
        top = stack[-1] if stack else ("", False, False, None)
        furniture, content = _roles(tag, attrs)
        if tag == "header" and top[2] and not top[1]:
            furniture = False  # the head of an article belongs to it
        mark = _MARK.search(attrs) if "data-main" in attrs else None
        stack.append((tag, top[1] or furniture, (top[2] or content) and not furniture,
                      int(mark[1]) if mark else top[3]))
    close()
    return out


#: Feature names, in the order of ``features``.
FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
            "furniture", "content", "heading", "sentence")
_SENTENCE = re.compile(r"""[.!?…:]["'»”)\]]*$""")


def features(page_blocks: list[Block]) -> list[tuple[float, ...]]:
    density = [b.link_words / b.words for b in page_blocks]
    words = [min(b.words, 60) for b in page_blocks]  # more words say no more
    n = len(page_blocks)
    return [(words[i], density[i], words[i - 1] if i else 0, density[i - 1] if i else 0.0,
             words[i + 1] if i + 1 < n else 0, density[i + 1] if i + 1 < n else 0.0,
             float(b.furniture), float(b.content), float(b.heading), float(bool(_SENTENCE.search(b.text))))
            for i, b in enumerate(page_blocks)]


#: The labelled table: small pages in common layouts; ``data-main`` labels the text below it.
LABELLED_PAGES = (
    """<body><nav data-main="0"><ul><li><a href="/">Home</a></li><li><a href="/n">News today</a></li></ul></nav>
    <div class="ad" data-main="0">Buy the new kettle now and save a lot of money this week only.</div>
    <article data-main="1"><h1>River level falls</h1><p>The river fell by two metres during the dry month of May.</p>
    <p>Boats wait.</p><p>Officials in the town said that they would open the upper gate on Monday if no rain came, as
    they had done in other years.</p></article>
    <footer data-main="0">&copy; 2020 The Daily. All rights reserved by the owners of this paper.</footer></body>""",
    """<body><header data-main="0"><a href="/">The Site</a><p>A paper for the whole valley, since the old days.</p>
    </header><div id="main"><div data-main="1"><h2>New bridge</h2><p>Work on the bridge started in the spring and is
    expected to go on until the first snow, a spokesman told the paper.</p><p>It will cost four million.</p>
    <blockquote>We have waited for a long time, and now it is here.</blockquote></div>
    <div class="comments" data-main="0"><p>I have driven there for years and I think this is a very good thing.</p>
    <p>Nonsense.</p></div></div><aside data-main="0"><h3>Most read</h3><p>How the mayor spent a quiet summer at home.</p>
    </aside></body>""",
    """<body><div class="cookie-notice" data-main="0">We use cookies to make this site work. Please accept them all to
    go on reading the news.</div><main data-main="1"><h1>Bread</h1><ul><li>Mix the flour and the water in a bowl.</li>
    <li>Salt</li><li>Wait</li></ul><p>Bake it for an hour, then let it rest on the rack until it is cool, as bread that
    is cut while hot will be heavy.</p></main><form data-main="0">Your name<label>Write to us and we will answer
    you within two days.</label></form><div class="sidebar" data-main="0"><p>Other recipes from our kitchen that you
    may like to cook some day.</p></div></body>""",
    """<body><table><tr><td data-main="0"><a href="1">One</a> <a href="2">Two</a> <a href="3">Three</a></td></tr>
    <tr><td data-main="1">The old mill stood empty for thirty years before a young couple from the coast bought it and
    began to mend the roof.</td></tr><tr><td data-main="1">They moved in before the winter came, with two dogs and a
    stove, and have stayed there ever since then.</td></tr><tr><td data-main="0"><a href="x">Next page</a> |
    <a href="y">Back to top</a></td></tr></table></body>""",
    """<body><div data-main="0"><a href="a">Start</a></div><div data-main="0"><a href="b">Sport</a></div><div
    data-main="0">Log in</div><div data-main="1">On Sunday the team won its third match in a row, with two late goals by
    the captain and a fine save at the end.</div><div data-main="1">The coach was pleased with how the young players
    held the ball when it mattered, and said so after the game.</div><div data-main="0">Terms</div><div data-main="0">
    Contact us</div><div data-main="0"><a href="c">More sport from the region this week and last week too</a></div>
    </body>""",
    """<body><article data-main="1"><header><h1>Night train</h1></header><p>The train left at nine.</p><p>Nobody spoke
    until the border, where the guard asked for papers and the lamps were lit again in the corridor.</p><h2>Morning</h2>
    <p>Snow.</p><div class="share" data-main="0">Share this with your friends on all of the usual sites.</div>
    <section class="comments" data-main="0"><h3>Comments</h3><p>What a lovely story, I read it twice last night.</p>
    </section></article><div class="newsletter" data-main="0">Get our best stories by mail each week.</div></body>""",
    """<body><ul class="menu" data-main="0"><li>Home</li><li>About</li><li>Archive of all the issues so far</li></ul>
    <div class="post-content" data-main="1"><p>Seeds should be kept dry. Most of them will last for two or three years
    in a cool room.</p><p>Beans last longer</p><p>Label every bag.</p></div><div class="related" data-main="0"><a
    href="q">How to plant a tree</a><p>Ten plants for a shady garden that anyone can grow.</p></div></body>""",
    """<body><p data-main="1">In the first chapter the reader meets a clerk who has lost his only key and walks through
    the town at night to look for it.</p><p data-main="1">He finds a dog, a shoe and a friend, and by the end he has no
    more need of the key that he had lost.</p><p data-main="0"><a href="l">List of all books on this site</a></p>
    <p data-main="0">Page 3 of 9</p></body>""",
    """<body><div class="banner" data-main="0">Our summer sale starts today: come to one of our forty shops in the region
    and find shoes, coats, bags and hats at half the price you paid last year, while they last.</div><div
    data-main="1"><p>The harbour was built by monks, who needed a safe place for the boats that brought salt and cloth to
    the abbey, and it has been in use ever since.</p><p>Today it holds sixty boats.</p></div><div id="comments"
    data-main="0"><p>My grandfather worked in that harbour for most of his life and he told me that the monks had a
    tunnel from the abbey to the sea, though nobody has found it yet.</p><p>Lovely place. We went there last year with
    the whole family and our two dogs, and would go again if it were not so far from here.</p></div><div
    class="footer-text" data-main="0">This site is run by the friends of the harbour, who thank all those that gave time
    or money to keep the old walls and the light in good order for the future.</div></body>""",
    """<body><aside data-main="0"><p>In this series we visit the small museums of the coast, talk to the people who keep
    them open, and ask what they would save first if the water came over the wall one night.</p></aside><p
    data-main="1">The museum of lamps has two rooms, one of which is always dark so that visitors can see how the lamps
    were meant to be seen when they were made.</p><form data-main="0"><p>Tell us what you think of this page: we read
    all that you send, answer most of it within a week, and print the best letters in the next issue of the magazine.
    </p></form><footer data-main="0"><p>No part of this page may be copied or sent on without the written leave of the
    editors, who can be reached at the address given on the first page of every issue.</p></footer></body>""",
    """<body><div data-main="0"><a href="1">Ten ways to fix a roof that leaks when it rains all day and night</a> <a
    href="2">Why the birds leave early this year and where they go when they do</a> <a href="3">A map of all the wells in
    the old part of town</a></div><div data-main="1">Roofs of slate last longer than those of wood, but a broken slate
    has to be found and changed before the frost, see <a href="s">our guide</a> for how that is done.</div></body>""",
    """<body><header data-main="0"><p>The valley paper</p></header><div data-main="1"><p>The wind took the roof of the
    school on Friday night, and on Saturday forty men and women came with ladders, ropes and nails to put up a new one
    before the rain that was said to come.</p></div><footer data-main="0"><p>Printed in the valley.</p></footer></body>""",
    """<body><article data-main="1"><p>A long walk along the dyke takes you past three locks and a house where the keeper
    once lived with nine children, four of whom became keepers in their turn.</p></article><footer data-main="0">&copy;
    The walkers of the dyke. Write to us.</footer></body>""",
    """<body><nav data-main="0"><a href="/z">Towns</a></nav><div class="notice" data-main="0">Parts of this page are out of
    date.</div><div data-main="1"><p>Salt was carried over the pass by mules, six to a man, and every village on the way
    took its share in tolls until the railway came and the trade stopped.</p></div><div class="sidebar"
    data-main="0"><p>More on salt.</p><p>Mules of the world and what they carry on their backs.</p></div><footer
    data-main="0"><p>The pages of the pass. Made by hand.</p></footer></body>""",
)


def labelled_table() -> list[tuple[tuple[float, ...], int]]:
    rows = []
    for page in LABELLED_PAGES:
        found = blocks(page)
        rows += [(x, b.mark) for x, b in zip(features(found), found) if b.mark is not None]
    return rows


#: A leaf of fewer labelled blocks says too little.
MIN_LEAF = 3


def _gini(rows: list) -> float:
    p = sum(y for _, y in rows) / len(rows)
    return len(rows) * 2 * p * (1 - p)


def grow(rows: list, depth: int = 6) -> tuple | int:
    """A decision tree: (feature, threshold, below or equal, above), or a class."""
    vote = int(2 * sum(y for _, y in rows) >= len(rows))
    if depth == 0 or _gini(rows) == 0:
        return vote
    best: tuple | None = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            t = (a + b) / 2
            low, high = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
            cost = _gini(low) + _gini(high)
            if best is None or cost < best[0] - 1e-9:
                best = cost, f, t, low, high
    if best is None or best[0] >= _gini(rows) - 1e-9:
        return vote
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@lru_cache(maxsize=1)
def trained_tree() -> tuple | int:
    return grow(labelled_table())


def classify(tree: tuple | int, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: tuple | int | None = None) -> str:
    tree = trained_tree() if tree is None else tree
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, features(found)) if classify(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""
    tree = trained_tree()

    def run(batches):
        for b in slices(batches):
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))

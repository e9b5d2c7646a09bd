"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is read once, in time linear in its length, into words and tags with
their open elements. Scripts, styles, forms, navigation, footers, asides, hidden
parts and elements that their class, id or role names as adverts, notices,
sidebars, reader comments and the like are cut out first. Of what is left each
word scores the log odds that words of its context (inside the marked article or
not, kind of block, in a link or not, sentence or scrap) are main text, and each tag a negative
figure by the same odds for its name. One linear scan finds the contiguous run
with the highest sum. The run is widened to whole blocks, and to the whole of the
article element if it lies in one.

The weights come from labelled pages: all pages of the table that mark one
article themselves, counted in Spark, and the labelled SAMPLES, which stand for
pages without such marks. Both have an equal say in a context that both know.

Defined cases: null html counts as empty, an empty page or one without words
gives the empty text. Very long pages and pages of any nesting take linear time.
Unclosed comments, scripts and quoted tags reach to the end of the page, as in
browsers. Repeated rows and repeated ids each keep their row; equal sums go to
the earlier run. Columns of the input stay; one whose name an added column takes
keeps its name, and the added one gets an underscore.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
#: Elements that hold no main text.
CUT = frozenset("aside audio button canvas dialog embed footer head iframe map menu nav noembed noframes noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of classes and ids that name what is not main text, and those that turn such a name into its opposite.
NAMES = frozenset(
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager sidebar widget widgets rail header masthead topbar footer colophon copyright share sharing social follow subscribe "
    "subscription newsletter signup signin login register form search searchform hidden".split()
)
FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion outbrain taboola comment comments commentlist "
    "respond reply replies disqus discussion related recommended recommendations trending popular teaser".split()
)
NEGATING = frozenset("no not has with without".split())

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?/])")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?))?)?""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ZEROS, BEYOND = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#(?:[0-9]{8,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)

MOST = 4.0  # bound of a weight
FEW = 5  # shorter runs of words that end no sentence count as contexts of their own
ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)]?\s?\Z")
LEAST_TAG = -0.05
NONE, HARD, NAMED, FIRM, ARTICLE = range(5)


def _named(value: str) -> int:
    """What a class or id attribute says: NONE, NAMED or FIRM."""
    why = NONE
    for name in value.split():
        pieces = [p.lower() for p in PIECE.findall(name)]
        if pieces and pieces[0] not in NEGATING:
            why = max(why, *(FIRM if p in FIRM_NAMES else NAMED if p in NAMES else NONE for p in (*pieces, name.lower())))
    return why


def decoded(text: str) -> str:
    """Character references resolved; numbers of any length beyond Unicode become U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = BEYOND.sub("\ufffd", ZEROS.sub("&#", text))
    return unescape(text)


class Page:
    """Elements (parent, name, why they may be cut) and the words and tags of a page, in order."""

    def __init__(self, html: str):
        self.parent, self.name, self.why, self.main = [-1], ["#page"], [NONE], [False]
        self.tokens: list[tuple[int, int, str, int]] = []  # element, block or -1 for a tag, text or name, place
        self._stack, self._depths, self._walls, self._block = [0], {}, [0], 0
        self._read(html)
        self._decide()

    # ---- reading

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self._text(html[at:lt], at)
            if lt == end:
                return
            m = OPEN.match(html, lt)
            if not m:
                self._text("<", lt)
                at = lt + 1
            elif not m[2]:
                mark = "-->" if m[3] else ">"
                at = html.find(mark, lt + 2)
                if at < 0:
                    return
                at += len(mark)
            else:
                name, at, attributes = m[2].lower(), m.end(), None
                if at < end and html[at] != ">":
                    attributes = {}
                    while at < end and html[at] != ">":
                        a = ATTRIBUTE.match(html, at)
                        if a[1]:
                            attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
                        elif a.end() == at:
                            at += 1
                            continue
                        at = a.end()
                if at >= end:
                    return
                at += 1
                if m[1]:
                    self._close(name, lt)
                    continue
                self._open(name, attributes, lt)
                if name in RAW:
                    m = RAW[name].search(html, at)
                    if not m:
                        return
                    at = m.start()

    def _text(self, text: str, at: int) -> None:
        if self.name[self._stack[-1]] == "head" and not text.isspace():
            self._pop(len(self._stack) - 1)
        self.tokens.append((self._stack[-1], self._block, text, at))

    def _depth(self, name: str) -> int:
        d = self._depths.get(name)
        return d[-1] if d else -1

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._depths[self.name[self._stack.pop()]].pop()
            if self._walls[-1] == len(self._stack):
                self._walls.pop()

    def _open(self, name: str, attributes: dict | None, at: int) -> None:
        if name not in IN_HEAD and name != "head" and (d := self._depth("head")) > 0:
            self._pop(d)
        if name in BLOCKS:
            self._block += 1
            if (d := self._depth("p")) > self._walls[-1]:
                self._pop(d)
        if name in IMPLIED:
            same, scope = IMPLIED[name]
            d = max(map(self._depth, same))
            if d > max(map(self._depth, scope)):
                self._pop(d)
        elif name == "a" and (d := self._depth("a")) > self._walls[-1]:
            self._pop(d)
        self.tokens.append((self._stack[-1], -1, name, at))
        if name in VOID:
            if name == "br":
                self.tokens.append((self._stack[-1], self._block, " ", at))
            return
        if name in ("html", "body") and self._depth(name) > 0:
            return
        self._depths.setdefault(name, []).append(len(self._stack))
        if name in BLOCKS and name != "p":
            self._walls.append(len(self._stack))
        self.parent.append(self._stack[-1])
        self.name.append(name)
        self._stack.append(len(self.name) - 1)
        why, main = HARD if name in CUT else NAMED if name in ("header", "form") else NONE, name == "main"
        if attributes and why != HARD and name not in ("html", "body"):
            role = attributes.get("role", "").lower()
            main = main or role == "main" or attributes.get("itemprop", "").lower() == "articlebody"
            if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
                why = HARD
            elif not main:
                said = max(why, NAMED if role in ROLES else NONE, _named(attributes.get("class", "")), _named(attributes.get("id", "")))
                why = ARTICLE if said and name == "article" else said
        self.why.append(why)
        self.main.append(main)

    def _close(self, name: str, at: int) -> None:
        self.tokens.append((self._stack[-1], -1, name, at))
        if name in ("html", "body"):
            self._block += 1
            return
        d = self._depth(name)
        if name in BLOCKS:
            self._block += 1
            if d > 0 and (name != "p" or d > self._walls[-1]):
                self._pop(d)
        elif d > self._walls[-1] or (d > 0 and name in CUT):
            self._pop(d)

    # ---- what is cut, and where the page marks its article

    def _decide(self) -> None:
        self._cut(0)
        if not self.mark and any(self.main[e] or self.name[e] == "article" for e in range(len(self.name))):
            self._cut(1)
        if not self._words():
            self._cut(2)

    def _words(self) -> bool:
        return any(b >= 0 and not self.cut[e] and not t.isspace() for e, b, t, _ in self.tokens)

    def _cut(self, lifted: int) -> None:
        """Cut elements and the nearest marking element of each. Named ones stay if they hold the only mark (lifted 1; not adverts and comments) or all words (2)."""
        n = len(self.name)
        holds = [False] * n
        if lifted:
            for e in range(n - 1, 0, -1):
                if self.name[e] == "article" or self.main[e] or holds[e]:
                    holds[self.parent[e]] = True
        plain = any(self.name[e] == "article" and self.why[e] == NONE for e in range(n))
        self.cut, inside = [False] * n, [False] * n
        for e in range(1, n):
            p, why, article = self.parent[e], self.why[e], self.name[e] == "article"
            named = why == NAMED and not (lifted == 2 or lifted and holds[e]) or why == FIRM and lifted < 2 or why == ARTICLE and plain
            if named and self.name[e] == "header" and inside[p]:
                named = False
            self.cut[e] = self.cut[p] or why == HARD or named or (article and inside[p])
            inside[e] = inside[p] or (article and not self.cut[e])
        self.mark = "article" if any(self.name[e] == "article" and not self.cut[e] for e in range(n)) else "main" if any(self.main[e] and not self.cut[e] for e in range(n)) else ""
        self.marker = [0] * n
        for e in range(1, n):
            own = self.name[e] == "article" if self.mark == "article" else self.main[e] and bool(self.mark)
            self.marker[e] = e if own and not self.cut[e] else self.marker[self.parent[e]]

    # ---- words and tags with their contexts

    def kinds(self) -> list[str]:
        """The context of words of each element: in or out of the marked part (free: none is marked), kind of block, in a link or not."""
        out, blocks, links = [], [], []
        for e, name in enumerate(self.name):
            p = self.parent[e]
            kind = "h" if len(name) == 2 and name[0] == "h" and name[1].isdigit() else name if name in ("p", "li", "td") else "p" if name in ("blockquote", "pre", "dd") else "div" if name in BLOCKS else blocks[p] if e else "div"
            blocks.append(kind)
            links.append(e > 0 and (links[p] or name == "a"))
            out.append(f"{self._where(e)} {kind} {'link' if links[e] else 'text'}")
        return out

    def _where(self, e: int) -> str:
        return "free" if not self.mark else "in" if self.marker[e] else "out"

    def scored(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(context, count, element, block, place) of each run of words and each tag that is not cut."""
        kinds, seen = self.kinds(), {}
        for e, block, text, at in self.tokens:
            if self.cut[e]:
                continue
            if block < 0:
                key = seen.get((text, e))
                if key is None:
                    key = seen[text, e] = f"{self._where(e)} <{text if text in BLOCKS or text in ('a', 'b', 'i', 'em', 'strong', 'span', 'br', 'img', 'code') else 'other'}>"
                yield key, 1, e, block, at
            else:
                n = len(text.split())
                if n:
                    yield kinds[e] + (" few" if n < FEW and not ENDS.search(text) else ""), n, e, block, at

    def text(self, chosen: set[int]) -> str:
        """The chosen blocks, one line each."""
        pieces: dict[int, list[str]] = {}
        for e, block, text, _ in self.tokens:
            if block in chosen and not self.cut[e]:
                pieces.setdefault(block, []).append(decoded(text))
        lines = (" ".join("".join(p).split()) for p in pieces.values())
        return "\n".join(line for line in lines if line)


# ---- weights


def counts_of(page: Page, span: tuple[int, int] | None = None) -> Counter:
    """Contexts of a labelled page, by whether they are main text: inside ``span``, or inside the one article the page marks. Empty if it has no label."""
    if span is None:
        own = {m for e, m in enumerate(page.marker) if m and not page.cut[e]}
        if page.mark != "article" or len(own) != 1:
            return Counter()
    out: Counter = Counter()
    for key, n, e, _, at in page.scored():
        out[key, span[0] <= at < span[1] if span else bool(page.marker[e])] += n
    return out


def weights_of(*sources: Counter) -> dict[str, float]:
    """Log odds of each context; every source that knows it has the same say. Tags are negative."""
    out = {}
    for key in {k for s in sources for k, _ in s}:
        shares = [(s[key, True] + 0.5) / (s[key, True] + s[key, False] + 1) for s in sources if s[key, True] + s[key, False]]
        p = sum(shares) / len(shares)
        w = max(-MOST, min(MOST, math.log(p / (1 - p))))
        out[key] = min(w, LEAST_TAG) if key.endswith(">") else w
    return out


def fit(pages: DataFrame, html: str = "html", start: str | None = None, end: str | None = None) -> dict[str, float]:
    """Weights from labelled pages: those that mark one article or, with ``start`` and ``end``, the code points between them (null: no label). The contexts are a fixed set, so the driver gets a small table."""
    names = [html, *filter(None, (start, end))]

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            for text, *span in rows:
                if text and None not in span:
                    total.update(counts_of(Page(text), tuple(span) or None))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["key", "content", "n"])

    rows = pages.select(*names).mapInArrow(run, "key string, content boolean, n bigint").groupBy("key", "content").agg(F.sum("n").alias("n")).collect()
    return weights_of(Counter({(r["key"], r["content"]): r["n"] for r in rows}), sample_counts())


def sample_counts() -> Counter:
    out: Counter = Counter()
    for s in SAMPLES:
        a, z = s.index("{{"), s.index("}}")
        out.update(counts_of(Page(s.replace("{{", "").replace("}}", "")), (a, z - 2)))
    return out


# ---- extraction


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum, the earliest of equals; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    tokens = list(page.scored())
    unknown = {"w": 0.5, "t": -1.0}
    a, z = best_run([n * weights.get(k, unknown["t" if k.endswith(">") else "w"]) for k, n, *_ in tokens])
    words = [(e, block) for _, _, e, block, _ in tokens[a:z] if block >= 0]
    if not words:
        return ""
    around = page.marker[words[0][0]]
    if around and page.marker[words[-1][0]] == around:
        chosen = {block for e, block, _, _ in page.tokens if block >= 0 and page.marker[e] == around}
    else:
        chosen = {block for _, block in words}
    return page.text(chosen)


def main_text(df: DataFrame, weights: dict[str, float], html: str = "html") -> DataFrame:
    """Add text and n_chars (code points)."""
    names = df.columns
    extra = free_names(("text", "n_chars"), names)
    schema = df.select("*", F.lit("").alias(extra[0]), F.lit(0).cast("bigint").alias(extra[1])).schema

    def run(batches):
        for b in slices(batches, html):
            texts = [extract(t, weights) for t in b.column(html).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns)] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *extra])

    return df.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """op12: the main text of every page, with weights from all pages that mark their article."""
    rows = pages.select("page_id", "url", "html")
    return main_text(rows, fit(rows)).select("page_id", "url", "text", "n_chars")


#: Labelled pages of kinds that do not mark an article, or mark more than one; main text stands between {{ and }}.
SAMPLES = (
    "<body><div id=top><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a></div><div class=story>{{<h1>Harbour bridge opens after two years of work</h1>"
    "<p>The bridge over the harbour was opened this morning after two years of work.</p><p>Traffic had been led through the old town since the floods, and shops there had <a href=/x>complained</a> about the noise.</p>"
    "<p>The mayor thanked all who had waited.</p>}}</div><div>All rights reserved <a href=/terms>Terms</a> <a href=/privacy>Privacy</a></div></body>",
    "<body><table><tr><td><a href=1>Index</a><br><a href=2>Archive</a><br><a href=3>Links</a><br><a href=4>Contact</a></td><td>{{<h2>On keeping bees</h2>Bees need water near the hive in the dry months."
    "<br><br>Put a flat dish with stones where the morning sun reaches it, and fill it every day before noon so that they learn the place.<p>In autumn the dish should be taken in.</p>}}</td></tr></table><div><a href=5>Next</a> <a href=6>Previous</a></div></body>",
    "<body><ul><li><a href=a>Sport</a></li><li><a href=b>Weather</a></li><li><a href=c>Culture</a></li><li><a href=d>Travel</a></li></ul><div>{{<h1>Rain expected</h1><p>A front from the west brings rain by the evening, and the wind turns to the north in the night.</p>"
    "<ul><li>Coast: strong wind and high waves until the early morning</li><li>Hills: sleet above eight hundred metres with slippery roads</li></ul><p>The weekend will be dry.</p>}}</div><ul><li><a href=e>Imprint</a></li><li><a href=f>Jobs</a></li></ul></body>",
    "<body><div><span>Log in</span> <span>Register</span></div><div>{{<div>The recipe takes an hour. Cut the onions into thin rings and let them soften in butter over a small flame.</div><div>Add the flour, stir, and pour in the stock little by little so that no lumps form.</div>"
    "<div>Serve with bread.</div>}}</div><div><a href=1>More soups</a></div><div><a href=2>More breads</a></div><div>Version 3</div></body>",
    "<body><div><a href=/>Start</a> | <a href=/map>Map</a></div><main>{{<h1>Opening hours</h1><p>The museum is open from ten to five on all days but Monday.</p><table><tr><th>Season</th><th>Hours</th></tr><tr><td>Summer months</td><td>ten to seven</td></tr>"
    "<tr><td>Winter months</td><td>eleven to four</td></tr></table><p>Groups should write a week before their visit.</p>}}</main><p>Last change in May</p><p><a href=/up>Top of page</a></p></body>",
    "<body><p><a href=/>Back to the list</a></p><article>{{<h1>Lamp with three arms</h1><p>The lamp came to the collection from a farm in the north.</p><ul><li><a href=1>Drawing of the base</a></li><li>Two arms were made again from iron</li></ul><p>It hangs in the hall.</p>}}</article>"
    "<p>You have 3 articles left this month</p><div>Page served in 12 ms</div></body>",
    "<body><p>Welcome, guest</p><p><a href=1>Shop</a> <a href=2>Basket</a></p><article>{{<h2>First frost</h2><p>The first frost came early and took the beans.</p>}}</article><div>Tip of the day: save often</div></body>",
    "<body><div><b>Site name</b></div><div><div>{{<h3>Notes on the second printing</h3><p>Two errors in the tables were mended and the index now lists the plates.</p><pre>plate 4 was page 81\nplate 5 was page 93</pre><blockquote>No book is ever finished.</blockquote>"
    "<p>Readers who find more are asked to write.</p>}}</div></div><div><i>Powered by pages</i></div></body>",
)


SQL = r"""
with inner_html as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as x from pages),
blocks as (select page_id, url, list_transform(regexp_split_to_array(x, '</?(?:h1|p)>'), lambda b: regexp_replace(b, '<[^>]*>', ' ', 'g')) as b from inner_html),
decoded as (select page_id, url, list_transform(b, lambda t: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'),
    '&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as b from blocks),
texts as (select page_id, url, array_to_string(list_filter(b, lambda t: t <> ''), chr(10)) as text from decoded)
select page_id, url, text, cast(length(text) as bigint) as n_chars from texts
"""

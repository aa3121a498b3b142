"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The DOM trees of a host are merged: elements with the same path of tags and classes from the root are one node of the host's tree. A
node's presentation importance is the entropy of the child layouts it shows; its content importance falls with the entropy with which
the same text is spread over the host's pages; both are normalised by the number of its occurrences and combined with the weight
GAMMA, and multiplied with a weight for what the node says of itself. Branches whose node is below LEAST are removed from each page.

An occurrence of a node is a page's text below it, together with the text around it (that of the parent), each counted once. Identical
pages and pages that differ in hinted parts alone are therefore one occurrence, and a line counts as repeated only if what stands around it differs.

Weights carry what entropy cannot see on hosts of few pages, and nowhere in reader comments, since no two are alike. A node's key holds its
weight: HINT for elements and class words of menus, headers, footers, sidebars, notices, adverts, forms and comments, and for
what lies outside the article or main element of a page that has one; 1 for the rest, within the article too. Never removed: what leads to an
article or main element, these themselves, headings, plain flow elements inside them, and the node that holds half of a page's text or more.
A class word does not count on article, main and body, nor beside a word of state ("comments-open", "no-sidebar"), nor where it would take the only article.

The tree is kept as counts and 64-bit digests, aggregated by Spark, so no task holds a host; pages are not shuffled while the list of low
nodes is small enough to broadcast, and dealt over SALTS tasks a host otherwise.

Text: character references decoded, white space inside a block as one space, blocks in page order joined by one space. Defined cases:
null and empty html give empty text; markup that ends early counts up to its end; a null url is a host of its own; repeated rows are one
occurrence and each get their text; further columns pass through, except that `text` is the result; an empty table gives an empty result;
time and memory are linear in the size of a page.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint

GAMMA, LEAST, HINT = 0.9, 0.45, 0.4
#: Low nodes (host and path) up to which their list is broadcast: some 10 MB.
MAX_BROADCAST_NODES = 200_000
#: Tasks over which the pages of a host are dealt where the list is joined.
SALTS = 32
#: Polynomial digests of runs of text pieces.
BASE, PRIME = 0x1B873593CC9E2D51, (1 << 61) - 1

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An opening tag of the key closes an open element of the value, up to the nearest of SCOPES.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("html body table ul ol dl select article section div main td th li".split())
CLOSES_P = BLOCKS - frozenset("br button caption dd dt frameset head html body iframe li noscript optgroup option select tbody td template textarea tfoot th thead title tr".split()) | {"li", "dd", "dt"}

NOISE_TAGS = frozenset("head title nav header footer aside form script style noscript template iframe svg math canvas object button select textarea input dialog menu audio video map datalist search".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer colophon copyright sidebar sidebars aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations pagination pager skip toolbar tagcloud".split()
)
STATE_WORDS = frozenset("has no not with without is are open opened closed close enabled disabled on off allowed hide show fixed sticky active".split())
#: Never read as text, in the tree or on the page: scripts, styles, forms and their like.
UNREAD = frozenset("head title script style noscript template form button select textarea input object svg math canvas iframe audio video map datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article these are text and no layout, unless they have a class or id.
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption br hr figure figcaption details summary".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*?)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'<>`]+))?""")
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d{3,}")


def digest(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


@lru_cache(1 << 16)
def hinted(token: str) -> bool:
    """Whether a class or id names a part that is not the main text; camelCase is cut too."""
    words = WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    return not NOISE_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words)


class Page:
    """Elements in page order: parent, tag, name (tag and classes), key (digest of the path in the host's tree), hints, and the run of text pieces below each."""

    __slots__ = ("begin", "by_word", "end", "key", "name", "noise", "parent", "pieces", "plain", "tag")

    def __init__(self, html: str | None):
        self.parent, self.tag, self.name, self.key, self.begin, self.end = [-1], ["#"], ["#"], [0], [0], [0]
        self.noise, self.by_word, self.plain = [False], [False], [True]
        self.pieces: list[tuple[int, str | None]] = []  # the element that holds the text; None: a block ends
        self.parse(html or "")

    def open(self, parent: int, tag: str, attributes: str) -> int:
        name, noise, by_word, plain = tag, tag in NOISE_TAGS, False, True
        if attributes.strip(" /\t\n\r\f"):
            got = {}
            for k, v in ATTRIBUTE.findall(attributes):
                got.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" and v else v)
            classes = got.get("class", "").split()
            if classes or got.get("id"):
                plain = False
                by_word = tag not in ("article", "main") and any(map(hinted, (*classes, got.get("id", ""))))
                # numbers of posts and pages would make each page's node its own
                name = tag if tag in ("html", "body") else f"{tag}.{'.'.join(sorted({DIGITS.sub('0', c.lower()) for c in classes}))}"
            noise = noise or got.get("role", "").lower() in NOISE_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        own = tag not in ("html", "body")
        i = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(name)
        self.key.append(digest(f"{self.key[parent]}/{name}"))
        self.noise.append(noise and own)
        self.by_word.append(by_word and own and not noise)
        self.plain.append(plain)
        self.begin.append(len(self.pieces))
        self.end.append(-1)
        return i

    def parse(self, html: str) -> None:
        stack, pieces, at, size = [0], self.pieces, 0, len(html)
        tags = self.tag

        def close(depth: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                if tags[i] in BLOCKS:
                    pieces.append((stack[-1], None))
                self.end[i] = len(pieces)

        def close_nearest(names, scopes) -> None:
            for d in range(len(stack) - 1, 0, -1):
                if tags[stack[d]] in names:
                    close(d)
                    return
                if tags[stack[d]] in scopes:
                    return

        while at < size:
            m = TOKEN.match(html, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    pieces.append((stack[-1], htmllib.unescape(text) if "&" in text else text))
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "br":
                    pieces.append((stack[-1], None))
                elif tag == "p" and not any(tags[i] == "p" for i in stack):
                    pieces.append((stack[-1], None))
                else:
                    stop = SCOPES - {tag} if tag not in BLOCKS else ()
                    close_nearest((tag,), stop)
                continue
            if tag in CLOSES_P:
                close_nearest(("p",), SCOPES)
            if tag in CLOSES:
                closing = CLOSES[tag]
                close_nearest(closing, SCOPES.difference(closing))
            if tag in ("html", "body") and tag in (tags[i] for i in stack):
                continue
            if tag == "body":
                close_nearest(("head",), ())
            i = self.open(stack[-1], tag, m[3] or m[6] or "")
            if tag in BLOCKS:
                pieces.append((stack[-1], None))
            if tag in VOID:
                self.end[i] = len(pieces)
                continue
            stack.append(i)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                body = html[at : stop.start() if stop else size]
                if tag in ("title", "textarea"):
                    pieces.append((i, htmllib.unescape(body)))
                at = stop.start() if stop else size
                if not stop:
                    break
        close(1)
        self.end[0] = len(pieces)

    def text(self, begin: int, end: int, dropped=None) -> str:
        """The text of a run of pieces, without those of dropped elements."""
        blocks, now = [], []
        for i, t in self.pieces[begin:end]:
            if t is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif dropped is None or not dropped[i]:
                now.append(t)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return " ".join(b for b in blocks if b)

    def inside(self, flags) -> list[bool]:
        """Whether an element or one above it is flagged."""
        out = list(flags)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def scope(self) -> tuple[list[bool], list[bool], list[bool]]:
        """Of each element: whether it is hinted itself, whether it is outside the article or main elements that the page has, and whether it is one of them or leads to one."""
        hint = [a or b for a, b in zip(self.noise, self.by_word, strict=True)]
        tops: list[int] = []
        # second, the hints of class words are passed over: they would take the only article
        for flags in (self.inside(hint), self.inside(self.noise)):
            for tag in ("article", "main"):
                tops = tops or [i for i, t in enumerate(self.tag) if t == tag and not flags[i]]
        spine = [False] * len(self.tag)
        for i in tops:
            while i >= 0 and not spine[i]:
                spine[i] = True
                i = self.parent[i]
        chosen = set(tops)
        within = self.inside([i in chosen for i in range(len(self.tag))])
        return [h and not s for h, s in zip(hint, spine, strict=True)], [bool(tops) and not w and not s for w, s in zip(within, spine, strict=True)], spine

    def nodes(self, hint: list[bool], outside: list[bool], spine: list[bool]) -> list[int]:
        """The elements that the tree judges: hinted ones, not what is in them, and other blocks."""
        has_article, below, judged = any(spine), self.inside(hint), []
        for i in range(1, len(self.tag)):
            tag = self.tag[i]
            if hint[i]:
                if not below[self.parent[i]] and tag not in UNREAD:
                    judged.append(i)
            elif not below[i] and not spine[i] and tag in BLOCKS and tag not in VOID and tag not in ("html", "body"):
                if not (tag in HEADINGS or (has_article and not outside[i] and self.plain[i] and tag in FLOW)):
                    judged.append(i)
        return judged

    def measures(self, off: list[bool]) -> tuple[list[int], list[int], list[int]]:
        """Prefix digests, counts and lengths of the text pieces outside `off`: what any run holds, in constant time."""
        value, count, size = [0], [0], [0]
        for i, t in self.pieces:
            words = "" if t is None or off[i] else " ".join(t.split())
            value.append((value[-1] * BASE + digest(words)) % PRIME if words else value[-1])
            count.append(count[-1] + bool(words))
            size.append(size[-1] + len(words))
        return value, count, size

    def place(self, i: int, hint: list[bool], outside: list[bool]) -> tuple[str, float]:
        """The node of a judged element and its weight. A hinted node has no classes: whatever they are, it has one weight."""
        return (f"{self.key[self.parent[i]]}/{self.tag[i]}!", HINT) if hint[i] else (f"{self.key[i]}^", HINT) if outside[i] else (str(self.key[i]), 1.0)

    def branches(self) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(key, name, weight, digest of the text, of the text around it, of the child layouts) of every node on the page; elements of one node are taken together."""
        hint, outside, spine = self.scope()
        unread = self.inside([t in UNREAD for t in self.tag])
        whole, rest = self.measures(unread), self.measures(self.inside([h or t in UNREAD for h, t in zip(hint, self.tag, strict=True)]))

        def text(i: int, measure) -> int:
            value, count, _ = measure
            a, b = self.begin[i], self.end[i]
            return (value[b] - value[a] * pow(BASE, count[b] - count[a], PRIME)) % PRIME

        layouts: dict[int, list[str]] = {}
        for i in range(1, len(self.tag)):
            if self.tag[i] in BLOCKS and not unread[i]:
                own = layouts.setdefault(self.parent[i], [])
                if not own or own[-1] != self.name[i]:
                    own.append(self.name[i])
        found: dict[str, list] = {}
        for i in self.nodes(hint, outside, spine):
            measure = whole if hint[i] else rest
            if measure[2][self.end[i]] > measure[2][self.begin[i]]:
                key, weight = self.place(i, hint, outside)
                row = found.setdefault(key, [self.tag[i] if hint[i] else self.name[i], weight, 0, 0, []])
                row[2] = (row[2] * BASE + text(i, measure)) % PRIME
                row[3] = (row[3] * BASE + text(self.parent[i], rest)) % PRIME
                row[4].append(" ".join(layouts.get(i, ())))
        for key, (name, weight, own, around, shape) in found.items():
            yield digest(key), name, weight, own, around, digest("|".join(shape))

    def main_text(self, low: frozenset[int] | set[int]) -> str:
        """The text without the branches of the given nodes, but for one of weight 1 that holds half of it."""
        hint, outside, spine = self.scope()
        found = [(i, *self.place(i, hint, outside)) for i in self.nodes(hint, outside, spine)] if low else []
        found = [(i, key, weight) for i, key, weight in found if digest(key) in low]
        light = {i for i, _, weight in found if weight < 1}
        gone = self.inside([t in UNREAD or i in light for i, t in enumerate(self.tag)])
        heavy = [(i, key) for i, key, weight in found if weight >= 1 and not gone[i]]
        if heavy:
            size, held = self.measures(gone)[2], {}
            for i, key in heavy:
                held[key] = held.get(key, 0) + size[self.end[i]] - size[self.begin[i]]
            removed = {i for i, key in heavy if 2 * held[key] < size[-1]}
            gone = self.inside([g or i in removed for i, g in enumerate(gone)])
        return self.text(0, len(self.pieces), gone)


def host_of(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, key, name, weight, occurrences, importance, before its weight) of the merged trees; pages has host and html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            # a batch may hold copies; a set drops them before the shuffle
            seen = {(host, *b) for host, html in zip(df["host"], df["html"], strict=True) for b in Page(html).branches()}
            yield pd.DataFrame(list(seen), columns=["host", "key", "name", "weight", "text", "around", "layout"])

    rows = pages.select("host", "html").mapInPandas(run, "host string, key long, name string, weight double, text long, around long, layout long")
    once = rows.groupBy("host", "key", "text", "around").agg(F.min("layout").alias("layout"), F.min("name").alias("name"), F.min("weight").alias("weight"))
    values = once.select("host", "key", "name", "weight", F.explode(F.array(*[F.struct(F.lit(c).alias("content"), F.col(v).alias("value")) for c, v in enumerate(("layout", "text"))])).alias("v"))
    counts = values.groupBy("host", "key", "v.content", "v.value").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("weight").alias("weight"))
    # sum(n log n) gives both entropies: of layouts, log m - sum / m; of a text over the occurrences that have it, log n
    sums = counts.groupBy("host", "key").agg(
        F.min("name").alias("name"),
        F.min("weight").alias("weight"),
        F.sum(F.when(F.col("content") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("content") == 0, F.col("n") * F.log("n"))).alias("layout"),
        F.sum(F.when(F.col("content") == 1, F.col("n") * F.log("n"))).alias("text"),
    )
    m = F.col("m")
    spread = F.when(m > 1, 1 - F.col("layout") / (m * F.log(m))).otherwise(1.0)
    fresh = F.when(m > 1, 1 - F.col("text") / (m * F.log(m))).otherwise(1.0)
    return sums.select("host", "key", "name", "weight", m.alias("occurrences"), (F.lit(1 - GAMMA) * spread + F.lit(GAMMA) * fresh).alias("importance"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", hints: bool = True) -> DataFrame:
    """Add `text`, the main text of each page, and drop nothing else. Without hints all weights are 1 and the entropies alone decide."""
    columns = [c for c in pages.columns if c not in (html, "text")]
    hosted = pages.select(*columns, F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    tree = style_tree(hosted.select(F.col("__host").alias("host"), F.col("__html").alias("html")))
    weighted = F.col("importance") * (F.col("weight") if hints else F.lit(1.0))
    low = checkpoint(tree.where(weighted < LEAST).groupBy(F.col("host").alias("__host")).agg(F.collect_list("key").alias("__low")))
    n = low.agg(F.coalesce(F.sum(F.size("__low")), F.lit(0)).alias("n")).first().n
    if n <= MAX_BROADCAST_NODES:
        marked = hosted.join(F.broadcast(low), "__host", "left")
    else:
        salted = hosted.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int"))
        marked = salted.join(low.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"], "left")

    @F.pandas_udf("string")
    def main(htmls: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([Page(h).main_text(frozenset() if x is None else frozenset(x)) for h, x in zip(htmls, lows, strict=True)], dtype=object)

    return marked.select(*columns, main("__html", "__low").alias("text"))

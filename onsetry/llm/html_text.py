"""Main text of web pages by tree scoring (operator 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from onsetry.llm.registry import query, read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul br hr".split()
) - {"br"}  # a break is white space inside its block
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas audio video menu "
    "dialog search".split()
)
CLOSED_BY = {  # elements whose end tag may be left out, and what ends them
    "p": BLOCK - {"html", "body", "head", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
SCOPE = frozenset("html body table td th ul ol dl div article section main blockquote".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice gdpr sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments disqus respond replies share sharing social related recommended popup modal "
    "overlay newsletter subscribe subscription signup login pagination pager widget toolbar skip".split()
)
GOOD_WORDS = frozenset("article body content entry main page post story text blog".split())
PRIOR = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0}
#: Names that mark what readers or the site add; other bad names also occur in the names of whole layouts.
STRONG = frozenset("comment comments disqus respond replies cookie cookies gdpr nav navbar navigation breadcrumb breadcrumbs pagination newsletter login signup".split())
NAMED, STRONGLY = 0.5, 0.9  # a box with a bad (strong) name stays from this share of the page's points on
DECAY = 0.5  # of the points of a container that reach the one around it
TEXT_TAGS = frozenset("p pre td li blockquote h1 h2 h3 h4 h5 h6 dd dt".split())
SHARE = 0.2  # of the best score, from which a sibling of the best container is kept


class _Node:
    __slots__ = ("parent", "tag", "points", "mass", "chars", "links", "dropped", "names", "share", "n_links", "kept", "linked")

    def __init__(self, parent: _Node | None, tag: str, dropped: bool, names: frozenset, share: float = 0.0):
        self.parent, self.tag, self.dropped, self.names, self.share = parent, tag, dropped, names, share
        self.points, self.mass, self.chars, self.links, self.n_links, self.kept, self.linked = 0.0, 0.0, 0, 0, 0, False, False


class _Page(HTMLParser):
    """Builds the tree and the blocks of text, in page order; iterative, so depth does not matter."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = _Node(None, "#root", False, frozenset())
        self.blocks, self.nodes = [], []
        self.text, self.links, self.depth_a, self.n_links, self.opened = [], 0, 0, 0, Counter()

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line and not self.node.dropped:
            owner = self.node
            while owner.parent is not None and owner.tag not in BLOCK:
                owner = owner.parent
            self.blocks.append((owner, line, min(self.links, len(line)), self.n_links))
        self.text, self.links, self.n_links = [], 0, 0

    def open(self, tag: str) -> bool:
        return self.opened[tag] > 0

    def pop_to(self, tag: str) -> None:
        while True:
            last, self.node = self.node, self.node.parent
            self.opened[last.tag] -= 1
            if last.tag == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag in VOID:
            (self.text.append(" ") if tag != "hr" else self.flush())
            return
        if tag in BLOCK:
            self.flush()
            n = self.node
            while n.parent is not None and n.tag not in SCOPE | {"li", "tr", "p", "dt", "dd"}:
                n = n.parent
            while n.parent is not None and tag in CLOSED_BY.get(n.tag, ()):
                self.pop_to(n.tag)
                n = self.node
                while n.parent is not None and n.tag not in SCOPE | {"li", "tr", "p", "dt", "dd"}:
                    n = n.parent
        given, within = dict(attrs), self.open("article") or self.open("main")
        # of a paragraph or heading the class alone tells; its id is an anchor
        hints = f"{given.get('class') or ''} {'' if tag in TEXT_TAGS else given.get('id') or ''}".lower()
        names = frozenset(re.split(r"[^a-z]+", re.sub(r"(?<!\S)(?:with|without|has|no|is|show)[-_]\S*", "", hints))) - {""}
        bad = tag in DROPPED or (given.get("role") or "") in BAD_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
        bad = bad or re.search(r"display\s*:\s*none", given.get("style") or "") is not None or (tag == "header" and not within)
        named = frozenset() if tag in ("html", "body") or (names & GOOD_WORDS and tag in ("article", "main")) else names & BAD_WORDS
        named -= {"header"} if within else frozenset()
        share = STRONGLY if named & STRONG else NAMED if named else 0.0
        self.node = _Node(self.node, tag, self.node.dropped or bool(bad), names, share)
        self.opened[tag] += 1
        self.nodes.append(self.node)
        if tag == "a":
            self.depth_a += 1
            self.n_links += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style", "title", "textarea", "p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "p" and not self.open("p"):
            self.flush()
            return
        if tag in VOID or not self.open(tag):
            return
        if tag in BLOCK:
            self.flush()
        if tag == "a":
            self.depth_a = max(0, self.depth_a - 1)
        if tag not in BLOCK:  # a stray inline end tag closes nothing outside its block
            n = self.node
            while n.tag != tag:
                if n.tag in BLOCK:
                    return
                n = n.parent
        self.pop_to(tag)

    def handle_data(self, data):
        if not self.node.dropped:
            self.text.append(data)
            if self.depth_a:
                self.links += len(" ".join(data.split()))


def main_text(html: str | None) -> str:
    """The text of the best container and its good siblings; "" if there is none.

    A block of text earns one point, one for each comma and up to three for its length, less the share of it that is
    link text. Its nearest container gets all, and each further one half of what the one inside it has. The container
    with the best points, times the share of its text outside links, is lifted to the article around it, if any.
    Siblings of a container that is no article stay if they reach a fifth of its score. Inside, lists and boxes that
    are mostly links are left out, and so are elements that tag or role name as menus, headers, footers, sidebars,
    notices, adverts, forms or comments. A class or id that does so counts against a box only if the box holds less
    than half of the page's points (nine tenths for names that layouts do not bear, as of comments). Work is
    proportional to the page, however deep it nests.
    """
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    if page.rawdata.startswith("<!--"):  # a comment that never ends
        page.rawdata = ""
    page.close()
    page.flush()
    worth = [(1 + line.count(",") + min(len(line) / 100, 3.0)) * (1 - links / len(line)) for _, line, links, _ in page.blocks]
    for (owner, *_), points in zip(page.blocks, worth):
        owner.mass += points
    for n in reversed(page.nodes):  # children come after their parents
        n.parent.mass += n.mass
    for n in page.nodes:
        n.dropped = n.dropped or n.parent.dropped or n.mass < n.share * page.root.mass
    kept_blocks = [(*block, points) for block, points in zip(page.blocks, worth) if not block[0].dropped]
    for owner, line, links, n_links, points in kept_blocks:
        owner.chars, owner.links, owner.n_links = owner.chars + len(line), owner.links + links, owner.n_links + n_links
        container = owner.parent if owner.tag in TEXT_TAGS else owner
        container.points += points
    for n in reversed(page.nodes):
        up = n.parent
        up.points, up.chars, up.links, up.n_links = up.points + DECAY * n.points, up.chars + n.chars, up.links + n.links, up.n_links + n.n_links

    def score(n: _Node) -> float:
        prior = PRIOR.get(n.tag, 0.0) + (10.0 if n.names & GOOD_WORDS else 0.0)
        return (n.points + prior) * (1 - n.links / n.chars) if n.chars and n.points > 0 else 0.0

    top, best = None, 0.0
    for n in page.nodes:
        if not n.dropped and n.tag != "html" and (s := score(n)) > best:
            top, best = n, s
    if top is None:
        return " ".join(line for _, line, links, _, _ in kept_blocks if links * 2 < len(line))
    n = top
    while n is not None:
        if n.tag == "article":
            top = n
        n = n.parent
    top.kept = True
    if top.tag not in ("article", "main", "body"):
        for n in page.nodes:
            if n.parent is top.parent and not n.dropped:
                n.kept = n.kept or score(n) >= max(10.0, SHARE * best) or (n.tag == "p" and n.chars > 80 and n.links * 4 < n.chars)
    for n in page.nodes:
        if n.parent.kept and not n.kept:
            boxed = n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.n_links >= 3 and n.links * 2 > n.chars
            n.kept, n.linked = True, n.parent.linked or boxed
    return " ".join(line for owner, line, *_ in kept_blocks if owner.kept and not owner.linked)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, "" if none) and ``n_chars``, instead of columns of these names.

    Each page is parsed whole by itself, in Arrow batches, so neither equal pages nor hosts gather anywhere; null and
    empty pages give an empty text, broken markup is closed as browsers do, no rows give no rows.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*[f"`{c}`" for c in columns])
    at = columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(at)]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*columns, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{fields}, text string, n_chars long")


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")

"""Main text of web pages by composite text density.

The page is parsed to a tree.  Every node has its characters, link characters, tags and link tags;
its composite text density is characters for each tag, adjusted by the share of links, and its
density sum is the sum of its children's densities.  The node of the largest density sum holds the
article; the smallest density on its path to the body is the threshold, and every other subtree
that reaches the threshold gives its own node of the largest density sum.  Where a page has one ``article``,
that is the article, however short; of several, those that reach the threshold are, unless they hold less than
three tenths of the text; else ``main`` is searched, and only then the body.  Navigation, footers,
forms, notices, adverts, comments and the like are taken out before, by element, role, or class and
id names.  A name with a word of this kind and others that are not known counts unless the node holds most of the page's
text and there is no article elsewhere.  Words that may belong to an article too (``legal``, ``related`` and
the like) only count where the node is rich in links or short; a marked element that holds an article stays.

The scanner reads on and never back: tags end at a ``>`` outside quotes, and once none is left before the page's
end, at the next ``>`` or before the next ``<``; a page takes time in proportion to its length.

Text is read block by block: character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined by a newline.  Nothing is capped.

Defined results: a null or empty page, and one without text, gives an empty string; text outside
any element counts as body text; unclosed and stray tags are closed as browsers do in the common
cases; repeated rows are each answered; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, read

#: A tag: closing slash, name, attributes.  A quote opens a value only after an equals sign.
TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>""",
    re.S,
)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+""", re.S)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes xmp".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
DROPPED = frozenset(
    """script style noscript template button select textarea iframe svg math object embed audio video canvas head title
    dialog menu noembed noframes xmp input""".split()
)
#: Elements that hold no article text, unless an article stands in them or a form is around a page's long text.
ASIDE = frozenset("nav aside footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names.  A name marks a node if all its words are marks, hints or frames: with a mark always, with
#: hints if the node is rich in links or short.  Of a mark among other words, :func:`measure` decides by what else the page holds.
MARKS = frozenset(
    """nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead sidebar aside ad ads advert adverts
    advertisement adsense sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login
    comment comments commentlist disqus pagination pager toolbar notice notices""".split()
)
HINTS = frozenset(
    """promo promotion teaser teasers banner alert popup modal overlay search share sharing social respond response
    responses reply replies related recommended recommendations widget copyright legal disclaimer skip form header""".split()
)
FRAMES = frozenset(
    """site page main global box bar list listing section wrapper wrap container block area panel group inner outer top
    bottom left right item items row col column links link buttons button icons posts post stories articles results unit
    slot the footer""".split()
)
#: Words that frame a mark, but may name the article itself where they stand with a hint.
OWN = frozenset("article articles post entry story blog content reader readers user users visitor visitors guest guests member members thread threads".split())
#: Words of reader comments that may name a section of the article too.
TALK = frozenset("discussion discussions feedback thread threads conversation conversations forum guestbook reactions".split())
SHORT = 400  # characters
KEPT = frozenset("html body article main".split())
SCOPES = frozenset("ul ol dl table select li dt dd tr td th option".split())
CLOSES_P = BLOCK - frozenset("br body html option optgroup".split())
P_END = re.compile(r"</?(?:" + "|".join(sorted(CLOSES_P)) + r")\b", re.I)
COMMENT_END = re.compile("--!?>")


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "link_chars", "tags", "link_tags", "density", "sum", "mark", "holds", "scope")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent, self.items, self.mark = tag, parent, [], mark
        self.scope = self if parent is None or tag in SCOPES else parent.scope  # the nearest list, table or item
        self.holds = 0  # articles
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def attributes(raw: str) -> dict[str, str]:
    got: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        got.setdefault(name.lower(), value[1:-1] if quoted else value)  # the first of a name counts
    return got


def marked(tag: str, raw: str, in_article: bool) -> str:
    """"drop" for what is never text, "mark" and "hint" for what :func:`measure` decides on, else nothing."""
    if tag in KEPT:
        return ""
    if tag in DROPPED:
        return "drop"
    mark = "mark" if tag in ASIDE and not (tag == "header" and in_article) else ""
    if not raw or raw.isspace():
        return mark
    got = attributes(raw)
    if "hidden" in got or got.get("role", "").lower() in ROLES or "display:none" in got.get("style", "").replace(" ", "").lower():
        return "drop"
    if mark or tag in ("b", "i", "em", "strong", "br", "img", "a") or tag[0] == "h" and tag[1:].isdigit():
        return mark
    for kind in ("class", "id"):
        for name in got.get(kind, "").split():
            words = {w.lower() for w in PART.findall(name) if not w.isdigit()}
            if words & MARKS:
                if words <= MARKS | HINTS | FRAMES | OWN | TALK:
                    return "mark"
                mark = mark or ("rich" if in_article else "weak")
            elif words & TALK and words <= TALK | HINTS | FRAMES | OWN:
                section = kind == "id" and tag == "section"
                if not section:
                    return "mark"
                mark = mark or ("rich" if in_article else "weak")
            elif words & HINTS and words <= HINTS | FRAMES:
                mark = mark or ("hint, article" if in_article else "hint")
    return mark


def boilerplate(node: Node) -> bool:
    """Whether a marked node is none of the article, by its counts."""
    if node.mark == "mark":
        page_form = node.tag == "form" and node.parent is not None and node.parent.parent is None
        return not node.holds and not (page_form and node.chars >= 5 * SHORT and 3 * node.link_chars < node.chars)
    if node.mark == "weak":
        return False  # see measure
    rich = 3 * node.link_chars >= node.chars
    return rich or node.mark != "rich" and node.chars < SHORT and not node.holds


def parse(page: str) -> Node:
    """The tree under the page's body; items are child nodes and decoded text."""
    root = Node("body", None)
    open_, inside = root, 0
    at, size, last = 0, len(page), page.rfind(">")
    skip, depth, strict = "", 0, True
    opened: Counter = Counter()  # open elements by tag

    def add(text: str) -> None:
        if text and not skip:
            open_.items.append(html.unescape(text))

    def leave(node: Node) -> None:
        """Closes all up to and with the node."""
        nonlocal open_, inside
        while open_ is not node.parent:
            inside -= open_.tag in ("article", "main")
            opened[open_.tag] -= 1
            open_ = open_.parent

    text_from = 0  # where text that is not yet added begins
    while True:
        cut = page.find("<", at)
        if cut < 0 or cut + 1 >= size:
            add(page[text_from:])
            break
        after = page[cut + 1]
        if after in "!?" or after == "/" and not page[cut + 2 : cut + 3].isascii() or after == "/" and not page[cut + 2 : cut + 3].isalpha():
            add(page[text_from:cut])
            if page.startswith("<!--", cut):
                if page.startswith((">", "->"), cut + 4):
                    at = page.find(">", cut + 4) + 1
                else:
                    end = COMMENT_END.search(page, cut + 4)
                    at = end.end() if end else size
            else:
                at = page.find(">", cut) + 1 if cut < last else size
            text_from = at
            continue
        if after != "/" and not ("a" <= after <= "z" or "A" <= after <= "Z"):
            at = cut + 1
            continue
        token = TAG.match(page, cut) if strict and cut < last else None
        if token is None:
            strict = False
            token = LOOSE.match(page, cut)
        add(page[text_from:cut])
        at = text_from = token.end()
        close, name, raw = token.group(1, 2, 3)
        tag = name.lower()
        if close:
            if skip:
                if tag == skip:
                    depth -= 1
                    skip = skip if depth else ""
                continue
            if opened[tag]:
                node = open_
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        own_end = raw.rstrip().endswith("/") or tag in VOID
        if skip:
            depth += tag == skip and not own_end
            continue
        if tag in RAW:
            if tag not in ("svg", "math") or not own_end:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                close_at = page.find(">", end.end()) + 1 if end and end.end() <= last else 0
                at = text_from = close_at or size
            open_.items.append(Node(tag, open_))
            continue
        if tag in ("html", "body"):
            continue
        if (tag in CLOSES_P or tag == "p") and opened["p"]:
            node = open_
            while node is not root and node.tag not in ("p", "div", "td", "li", "article", "section", "main", "table"):
                node = node.parent
            if node.tag == "p":
                leave(node)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if any(opened[t] for t in alike):
                node = open_.scope
                while node is not root and node.tag not in ("ul", "ol", "dl", "table", "select", *alike):
                    node = node.parent.scope
                if node.tag in alike:
                    leave(node)
        mark = marked(tag, raw, inside > 0)
        if mark == "drop":
            if not own_end:
                skip, depth = tag, 1
                if tag == "p":  # its end tag may be left out
                    end = P_END.search(page, at)
                    skip, depth, at = "", 0, end.start() if end else size
                    text_from = at
            continue
        node = Node(tag, open_, mark)
        open_.items.append(node)
        if not own_end:
            open_ = node
            opened[tag] += 1
            inside += tag in ("article", "main")
    return root


def _counted(order: list[Node]) -> None:
    for node in reversed(order):
        node.chars = node.link_chars = node.tags = node.link_tags = node.holds = 0
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
                node.holds += x.holds + (x.tag in ("article", "main"))
            else:
                node.chars += sum(map(len, x.split()))
        if node.tag == "a":
            node.link_chars = node.chars
        if node.mark and boilerplate(node):
            node.items = []
            node.chars = node.link_chars = node.tags = node.link_tags = 0


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with counts, densities and density sums."""
    order = [root]
    for node in order:
        order.extend(x for x in node.items if isinstance(x, Node))
    _counted(order)
    # a name with a mark among other words: an article elsewhere, or most of the text, speaks against the node
    weak = [n for n in order if n.mark == "weak" and n.chars and not n.holds and (root.holds or 2 * n.chars <= root.chars)]
    if weak:
        for node in weak:
            node.items = []
        _counted(order)
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
            node.density = c / t * max(math.log(c * t / (max(lc, 1) * lt)), 0.0) / math.log(max(base, 1.0) + math.e - 1)
    for node in order:
        node.sum = sum(x.density for x in node.items if isinstance(x, Node))
        if any(isinstance(x, str) and not x.isspace() for x in node.items):
            node.sum += node.density  # its own text counts as a child
    return order


def largest(top: Node) -> Node:
    best, work = top, [top]
    while work:
        node = work.pop()
        if node.sum > best.sum or (node.sum == best.sum and best is top and node.chars == top.chars):
            best = node
        work.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return best


def uppermost(root: Node, tag: str) -> list[Node]:
    """Elements with text that stand in no other of their kind, in page order."""
    out, work = [], [root]
    while work:
        node = work.pop()
        if node.tag == tag:
            if node.chars:
                out.append(node)
        elif node.holds:
            work.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def block_of(node: Node) -> Node:
    """The node, or its block if it is inline."""
    while node.parent is not None and node.tag not in BLOCK:
        node = node.parent
    return node


def path_threshold(node: Node) -> float:
    """The smallest density on the way to the body."""
    least = node.density
    while node is not None:
        least = min(least, node.density)
        node = node.parent
    return least


def headed(article: Node, root: Node) -> list[Node]:
    """The article, behind the first headings of its ``main`` if it has none of its own."""
    if any(uppermost_heading(article)):
        return [article]
    node = article
    while node is not None and node.tag != "main":
        node = node.parent
    return [*(uppermost_heading(node) if node else []), article]


def uppermost_heading(top: Node) -> list[Node]:
    """Headings of the first level under a node, without those of articles in it."""
    out, work = [], [top]
    while work:
        node = work.pop()
        if node.tag == "h1":
            out.append(node)
        elif node is top or node.tag != "article":
            work.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def selected(root: Node) -> list[Node]:
    measure(root)
    articles = uppermost(root, "article")
    if len(articles) == 1:
        return headed(articles[0], root)
    if 10 * sum(a.chars for a in articles) >= 3 * root.chars > 0:
        best = max(map(largest, articles), key=lambda n: n.sum)
        threshold = path_threshold(best)
        up = best
        while up not in articles:
            up = up.parent
        return [a for a in articles if a is up or a.density >= threshold]
    if mains := uppermost(root, "main"):
        return mains
    best = largest(root)
    threshold = path_threshold(best)
    chosen: list[Node] = []
    picked: set[int] = set()
    above: set[int] = set()  # nodes on the way to a chosen one

    def choose(node: Node) -> None:
        chosen.append(node)
        picked.add(id(node))
        while node is not None and id(node) not in above:
            above.add(id(node))
            node = node.parent

    choose(block_of(best))
    work = [root]
    while work:
        node = work.pop()
        if id(node) in picked:
            continue
        if id(node) not in above and node.chars and node.density >= threshold:
            choose(block_of(largest(node)))
        else:
            work.extend(x for x in node.items if isinstance(x, Node))
    return chosen


def blocks(root: Node, chosen: list[Node]) -> list[str]:
    """Blocks of the chosen subtrees in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    picked = {id(c) for c in chosen}
    work: list = [(root, False, False)]
    while work:
        item, inside, done = work.pop()
        if isinstance(item, str):
            if inside:
                line.append(item)
            continue
        block = item.tag in BLOCK
        if block or id(item) in picked:
            end()
        if done:
            continue
        inside = inside or id(item) in picked
        if block or id(item) in picked:
            work.append((item, inside, True))
        work.extend((x, inside, False) for x in reversed(item.items))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(root, selected(root)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.  One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p.as_py()) for p in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return arrow_map(pages.select(id_col, url_col, html_col),
        work, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    )


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))

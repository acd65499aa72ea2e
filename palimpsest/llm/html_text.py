"""Main text of HTML pages by composite text density.

Of every node: characters for each tag, lowered where much of it is links. The node whose children's densities sum to
the most holds the article. The least density on the path from it up to the body is the threshold: what stands beside
that path and reaches the threshold, or stands in its container and isn't mostly links, belongs to the text too.

The density is chars / tags * ln(chars / link chars * tags / link tags) / ln(chars / plain chars * link chars + the body's
share of links * chars + e). The quotient of logarithms stands for a logarithm to the base of the second one, which
doesn't exist where a page has no links (a base of 1); it is at least 1 for a node without links.

Names of page furniture in class or id, and forms, are a prior beside length and links: what is mostly links or short
goes by its name, what holds most of the body's text outside links never does. A name that is nothing but furniture also
keeps a node from being chosen first; in what was chosen and in its container its long text stays, comments excepted.
What holds the first main or article is spared by name, and a header inside one is not the page's; beyond that, these
elements are nodes like all others.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import slices
from palimpsest.llm.common import prepare

# Element names of HTML by how they are treated, and names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = RAW | frozenset("head nav footer aside button select input menu dialog canvas audio video object map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination footer masthead comment comments respond replies disqus share sharing social related recommended widget toolbar skip hidden".split())
COMMENTS = frozenset("comment comments respond replies disqus".split())
FILLERS = frozenset("site page post posts article articles story stories link links list section area thread wrapper wrap container box block bar button buttons icon icons item items form slot unit inner outer top bottom left right".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fewer characters than this are short. What a name says: nothing, a word of it, a form, all of it, other people's text.
SHORT = 100
PLAIN, HINT, FORM, NAMED, OTHERS = range(5)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol menu dl table select body html div article section main td th".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "attributes", "drop", "name", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.items: list[Node | str] = []
        self.drop, self.name = False, PLAIN
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def tree(page: str) -> Node:
    """The page's elements and texts; tags that are left open are closed as HTML does it."""
    top = at = Node("html", None)
    i, n = 0, len(page)
    while i < n:
        m = TOKEN.match(page, i)
        i = m.end()
        name = m[2]
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                at.items.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            x = at
            while x is not None and x.tag != name:
                x = x.parent
            if x is not None and x.parent is not None:
                at = x.parent
            elif name == "br":
                at.items.append(Node("br", at))
            continue
        if name == "html":
            continue
        if name in BLOCKS and name not in ("option", "optgroup"):  # they end an open paragraph
            x = at
            while x is not None and x.tag not in SCOPES and x.tag != "p":
                x = x.parent
            if x is not None and x.tag == "p":
                at = x.parent
        if name in CLOSES:
            x = at
            while x is not None and x.tag not in SCOPES - CLOSES[name]:
                if x.tag in CLOSES[name]:
                    at = x.parent
                x = x.parent
        node = Node(name, at, m[3])
        at.items.append(node)
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, i)
            i = end.end() if end else n
        elif name not in VOID and not (m[3].endswith("/") and name not in BLOCKS):
            at = node
    return top


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes.strip() else {}


def _is_furniture(node: Node, inside: bool) -> bool:
    """By the element or its attributes, whatever it holds. inside: an article or main element stands above."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("body", "article", "main") and not inside:
        return False
    a = _attributes(node)
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""))) or a.get("role", "").lower() in ROLES


def _named(node: Node, inside: bool) -> int:
    """What class and id say. A slug like related-work only hints at furniture; related-posts is nothing else."""
    kind = FORM if node.tag == "form" else PLAIN
    if not node.attributes or node.tag in ("body", "article", "main") and not inside:
        return kind
    a = _attributes(node)
    if a.get("role", "").lower() == "form":
        kind = FORM
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = [x for x in NAME_PARTS.split(name) if x]
        if not any(x in FURNITURE for x in parts) and not ("site" in parts and "header" in parts):
            continue
        if all(x in FURNITURE or x in FILLERS or x.isdigit() or x == "header" for x in parts):
            kind = max(kind, OTHERS if any(x in COMMENTS for x in parts) else NAMED)
        else:
            kind = max(kind, HINT)
    return kind


def _goes(x: Node, inside: bool, most: float) -> bool:
    """Whether a name is borne out by the length and the links of the text. inside: in the article or the chosen subtree."""
    plain = x.chars - x.link_chars
    if x.name == PLAIN or plain > most:
        return False
    if plain <= x.link_chars:
        return True
    if inside and x.tag in HEADINGS:
        return False
    if x.name == OTHERS or x.name == NAMED and not inside:
        return True
    return x.chars < SHORT and not (inside and x.name == HINT)


def _count(order: list[Node]) -> None:
    """Characters and tags of nodes, children behind parents, without what is dropped."""
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for c in x.items:
            if isinstance(c, str):
                n = len("".join(c.split()))
                x.chars += n
                x.link_chars += n if x.tag == "a" else 0
            elif not c.drop:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if x.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")


def _density(x: Node, body: Node) -> float:
    density, linked = x.chars / max(1, x.tags), x.link_chars
    plain = max(1, x.chars - linked)
    base = math.log(x.chars / plain * linked + body.link_chars / max(1, body.chars) * x.chars + math.e)
    ratio = x.chars / max(1, linked) * max(1, x.tags) / max(1, x.link_tags)
    return density * math.log(max(ratio, 1.0)) / base if linked or x.link_tags else density * max(1.0, math.log(max(ratio, 1.0)) / base)


def _measure(top: Node) -> tuple[list[Node], Node, float]:
    """All kept nodes, children behind parents, with their counts; the body; what is most of its text."""
    body, order, stack, holding = top, [], [(top, False)], set()
    everything = [top]
    for x in everything:
        everything += [c for c in x.items if isinstance(c, Node)]
    for x in everything:  # breadth first: the outermost article or main comes first
        if x.tag == "body":
            body = x
    lead = first = next((x for x in everything if x.tag == "main"), None) or next((x for x in everything if x.tag == "article"), None)
    while lead is not None:
        holding.add(id(lead))
        lead = lead.parent
    while stack:
        x, inside = stack.pop()
        # what holds the first article isn't furniture, whatever it is called
        spared = x.parent is None or id(x) in holding
        x.drop = not spared and _is_furniture(x, inside)
        if x.drop:
            continue
        x.name = PLAIN if spared else _named(x, inside)
        order.append(x)
        inside = inside or x.tag in ("article", "main")
        stack += [(c, inside) for c in x.items if isinstance(c, Node)]
    _count(order)
    most = (body.chars - body.link_chars) / 2
    if any(x.name for x in order):
        kept, stack = [], [(top, False)]
        while stack:
            x, inside = stack.pop()
            # beside an article, a node with most of the text isn't a wrapper of it
            x.drop = _goes(x, inside, most if inside or first is None else math.inf)
            if x.drop:
                continue
            kept.append(x)
            inside = inside or x.tag in ("article", "main")
            stack += [(c, inside) for c in x.items if isinstance(c, Node) and not c.drop]
        order = kept
        _count(order)
    for x in reversed(order):
        if x.chars:
            x.density = _density(x, body)
        x.sum = sum(c.density for c in x.items if isinstance(c, Node) and not c.drop)
    return order, body, most


def _content(top: Node) -> list[Node | str]:
    """Nodes and bare texts that make the main text, in page order."""
    order, body, most = _measure(top)
    if not body.chars:
        return []
    parts = _chosen(order, body, most)
    stack = [x for x in parts if isinstance(x, Node)]
    while stack:  # what was chosen is judged as an article is
        x = stack.pop()
        for c in x.items:
            if isinstance(c, Node) and (c.name or not c.drop):
                c.drop = _goes(c, True, most)
                stack += [] if c.drop else [c]
    return parts


def _chosen(order: list[Node], body: Node, most: float) -> list[Node | str]:
    below, inside = {id(body)}, []
    for x in order:  # parents come before children
        if id(x) in below or x.parent is not None and id(x.parent) in below:
            below.add(id(x))
            inside.append(x)
    best = max(inside, key=lambda x: (x.sum if x.tag in BLOCKS else 0.0, x.density if x is not body else 0.0))
    if not best.sum:
        return [body]
    path, x = [], best
    while x is not body:
        path.append(x)
        x = x.parent
    path.append(body)
    least = min(x.density for x in path)
    on_path = {id(x) for x in path[1:]}

    out: list[Node | str] = []
    stack = [(body, c) for c in reversed(body.items)]
    while stack:
        node, c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.drop:
            if c.name not in (PLAIN, OTHERS) and c.tag in BLOCKS and node is not body and not _goes(c, True, most) and (_density(c, body) >= least or c.chars > 3 * c.link_chars):
                c.drop = False
                out.append(c)
        elif id(c) in on_path:
            stack += [(c, x) for x in reversed(c.items)]
        elif c is best or c.tag in BLOCKS and (c.density >= least or node is not body and c.chars > 3 * c.link_chars):
            out.append(c)
    return out if best is not body else [body]


def _blocks(parts: list[Node | str]):
    """Texts between block boundaries."""
    held: list[str] = []
    stack: list = [iter(parts)]
    names = [""]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if names.pop() in BLOCKS:
                yield "".join(held)
                held = []
        elif isinstance(x, str):
            held.append(x)
        elif x.tag in ("br", "wbr"):
            held.append("\n" if x.tag == "br" else "")
        elif not x.drop:
            if x.tag in BLOCKS:
                yield "".join(held)
                held = []
            stack.append(iter(x.items))
            names.append(x.tag)
    yield "".join(held)


def main_text(page: str) -> str:
    """The article of a page, a line for each block; empty if there is none."""
    lines = (" ".join(html.unescape(x).split()) for x in _blocks(_content(tree(page))))
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row. Narrow, one page in hand at a time, whole pages.

    Null html is empty and gives an empty text; null ids and urls stay; repeated rows stay; of equally dense nodes the first
    counts; an empty table gives an empty result; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            out = [main_text(x) for _, part in slices(batch.column(2)) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))

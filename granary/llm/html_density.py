"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every element has a density: characters per tag, adjusted for links, so that menus
score low and prose high. The densities of an element's children add up to its density sum, and the element with the
largest sum holds the article, together with its article element or headings. Densities on the way from the body to it
are the threshold that branches beside this way have to reach to be taken as well.

Scripts, styles, menus, footers, side columns, notices, adverts and comments of readers are no candidates: they are
taken out by element, role or class before densities are computed. A class or id marks an element only if all of its words
are known (``ad-box``, not ``ad-hoc``), and everyday words (``notice``) mark nothing inside an article unless the element
holds controls or little but links. Forms go if they hold little prose for their controls, asides unless they are
quotations in an article.

Each page is parsed on its own in one pass over its tags; nothing is shuffled.

Results in special cases: NULL or empty html gives an empty text; text outside any element counts as part of the
body; unclosed and misplaced tags close as browsers close them, in short; repeated rows are extracted each; an empty
table gives no rows; further columns are carried along if named in ``keep``.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr rb rp rt rtc ruby "
    "math menclose mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
DROPPED = frozenset(
    "script style noscript template head title meta link nav footer button select option input textarea fieldset iframe object embed applet svg annotation annotation-xml canvas audio video map dialog menu xmp noembed noframes".split()
)
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements that a closing tag or an implied close does not reach out of.
WALLS = frozenset("table td th body html article section div ul ol dl".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark what is no article, wherever it stands.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored outbrain taboola "
    "nav navbar breadcrumb breadcrumbs pagination sidebar sidebars cookie cookies gdpr paywall popup newsletter signup "
    "comment comments commentlist disqus replies sharing hidden screenreader sr".split()
)
#: Words that do so outside of an article; inside of one, only if the element is made of links or controls.
DOUBTFUL = frozenset(
    "banner banners promo promotion navigation menu menus pager topbar toolbar masthead footer foot colophon copyright "
    "asides rail widget widgets consent notice notices disclaimer modal overlay subscribe subscription login "
    "respond discussion share social related recommended recommendations trending skip".split()
)
#: Words that say where or what for an element is; a name is marked only if it has no words but these and the ones above.
PLACES = frozenset(
    "area bar block body bottom box btn btns button buttons column container content desktop entry form group heading holder icon icons inner "
    "item items left link links list main message mobile module more only outer page panel post posts primary reader readers region right "
    "article articles row secondary section site slot sticky stories story text thread title to top unit user users wrap wrapper zone".split()
)
PAGE_PARTS = re.compile(r"(?:site|page|global|main)[-_]?(?:header|footer|nav|menu)")
QUOTE = frozenset("quote quotes pullquote pullquotes blockquote".split())

#: Outside of an article, an element of just this class or id is the head of the page.
PAGE_HEADER = re.compile(r"""\b(?:class|id)\s*=\s*["']?(?:header|top|head|heading-bar)(?=["'\s]|$)""", re.I)

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/a-zA-Z][^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPLIT_WORD = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "parent", "children", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, noise: int):
        self.name, self.parent, self.noise = name, parent, noise
        self.children: list[Node | str] = []


#: An element can't be part of an article by its name, or most likely is none by its role or class. The others are judged
#: once all is read: a form by what it holds, ASIDE and DOUBT (a doubtful class) by that and by whether an article is around.
HARD, SOFT, FORM, ASIDE, DOUBT = 1, 2, 3, 4, 5
#: Characters of prose that a form has at least, in all and for each of its visible controls, if it is no noise.
FORM_PROSE, CONTROL_PROSE = 200, 100
CONTROLS = frozenset("button select input textarea".split())
FOR = re.compile(r"""(?:^|\s)for\s*=""", re.I)
UNSEEN = re.compile(r"""\btype\s*=\s*["']?hidden\b""", re.I)


def is_noise(name: str, attributes: str, inside: bool) -> int:
    """HARD, SOFT, FORM, ASIDE, DOUBT or 0. ``inside``: within article or main, where a header has the title."""
    if name in DROPPED or name == "header" and not inside:
        return HARD
    mark = mark_of(attributes) if attributes and name not in ("html", "body", "main") else 0
    if name == "form":
        return SOFT if mark else FORM
    if name == "aside":
        return SOFT if mark == SOFT else ASIDE
    if not attributes or name in ("html", "body", "main"):
        return 0
    return mark or (SOFT if not inside and PAGE_HEADER.search(attributes) else 0)


def mark_of(attributes: str) -> int:
    """SOFT, DOUBT or 0 by role, style, class and id."""
    doubt = 0
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SOFT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SOFT
        if key == "role" and value.strip().lower() in NOISE_ROLES:
            return SOFT
        if key in ("class", "id"):
            for one in html.unescape(value).split():
                words = {w.lower() for w in SPLIT_WORD.split(one) if w and not w[0].isdigit()}
                if words - NOISE - DOUBTFUL - PLACES:
                    doubt = doubt or DOUBT * bool(PAGE_PARTS.fullmatch(one.lower()))
                elif words & NOISE:
                    return SOFT
                elif words & DOUBTFUL or PAGE_PARTS.fullmatch(one.lower()):
                    doubt = DOUBT
    return doubt


def is_quote(attributes: str) -> bool:
    """Whether class or id name a quotation."""
    names = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    return any(w.lower() in QUOTE for n in names for w in SPLIT_WORD.split(n))


def parse(page: str) -> Node:
    """The tree of elements; its root stands for the body."""
    root = node = Node("body", None, 0)
    at, end, inside, form, unseen, quotes = 0, len(page), 0, False, set(), set()
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            node.children.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            node, inside = close(node, name, inside)
            form = form and name != "form"
            continue
        while (ends := CLOSED_BY.get(node.name)) and name in ends:
            inside -= node.name in ("article", "main")
            node = node.parent
        if name in CLOSED_BY["p"]:
            up = node  # an open paragraph also ends if inline elements in it were left open
            while up.name in INLINE and up.parent is not None:
                up = up.parent
            if up.name == "p":
                node = up.parent
        if name in ("html", "body") or name == "form" and form:  # forms don't nest
            continue
        attributes = m[3] or m[6] or ""
        child = Node(name, node, is_noise(name, attributes, inside > 0))
        node.children.append(child)
        form = form or name == "form"
        if name == "label" and (form or FOR.search(attributes)):
            child.noise = HARD
        if name in CONTROLS:
            label_of(child)
        if name == "aside" and is_quote(attributes):
            quotes.add(child)
        if name == "input" and UNSEEN.search(attributes):
            unseen.add(child)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            child.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        inside += name in ("article", "main")
        node = child
    judge_forms(root, unseen)
    judge_doubts(root, quotes)
    return root


def label_of(control: Node) -> None:
    """A label around a control is part of the form."""
    up = control.parent
    while up is not None and up.name in INLINE:
        if up.name == "label":
            up.noise = HARD
        up = up.parent


#: An element in an article that a doubtful class marks is noise if links have this share of its characters.
LINKED = 1 / 3


def judge_doubts(root: Node, quotes: set[Node]) -> None:
    """Outside of an article, doubtful classes and asides are noise. Inside, the former are if they hold controls or little
    but links, and the latter unless they are quotations."""
    todo, order = [(root, False)], []
    while todo:
        node, within = todo.pop()
        order.append((node, within))
        within = within or node.name == "article"
        todo += [(c, within) for c in node.children if isinstance(c, Node)]
    held: dict[int, tuple[int, int, bool]] = {}
    for node, within in reversed(order):  # children first: characters, those of links, and whether there are controls
        chars = links = 0
        controls = node.name in CONTROLS
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            else:
                n, l, k = held.pop(id(c))
                chars, links, controls = chars + n, links + l, controls or k
        held[id(node)] = (chars, chars if node.name == "a" else links, controls)
        linked = controls or links > LINKED * chars
        if node.noise == DOUBT:
            node.noise = SOFT if linked or not within else 0
        elif node.noise == ASIDE:
            quoted = node in quotes or any(isinstance(c, Node) and c.name in ("blockquote", "q") for c in node.children)
            node.noise = 0 if within and quoted and not linked else HARD


def judge_forms(root: Node, unseen: set[Node]) -> None:
    """Forms that hold little but controls are noise, unless too little is left without them; those that hold prose are not."""
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    forms: dict[Node, list[int]] = {}
    while todo:
        node, form = todo.pop()
        if node.noise == FORM:
            form = node
            forms[form] = [0, 0]
        for c in node.children:
            if isinstance(c, str):
                if form is not None:
                    forms[form][0] += len(c.strip())
            elif c.name in CONTROLS and c not in unseen:
                if form is not None:
                    forms[form][1] += 1
            elif form is None and c.noise != HARD or not c.noise and c.name != "a":
                todo.append((c, form))
    for form, (chars, controls) in forms.items():
        form.noise = 0 if chars >= max(FORM_PROSE, CONTROL_PROSE * controls) else SOFT


def close(node: Node, name: str, inside: int) -> tuple[Node, int]:
    up = node
    while up.parent is not None and up.name != name:
        if up.name in WALLS and name in (INLINE | {"p", "li"}):
            return node, inside
        up = up.parent
    if up.parent is None:
        return node, inside
    while node is not up:
        inside -= node.name in ("article", "main")
        node = node.parent
    return up.parent, inside - (up.name in ("article", "main"))


def in_order(root: Node) -> list[Node]:
    """Every element that is no noise, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
    return out


#: Links have this share of a page's characters at least, as adjustment is void without any.
LEAST_LINK_SHARE = 0.05


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share``: of links in all characters of the body."""
    if not chars:
        return 0.0
    tags, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * max(1e-3, math.log(max(1.0, chars / lc * tags / lt)) / math.log(max(base, 1.01)))


def measure(nodes: list[Node]) -> None:
    """Characters, tags and those of links of each element, its density and density sum."""
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            elif not c.noise:
                chars, tags = chars + c.chars, tags + c.tags + 1
                link_chars, link_tags = link_chars + c.link_chars, link_tags + c.link_tags
        if node.name == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    share = max(LEAST_LINK_SHARE, nodes[0].link_chars / max(1, nodes[0].chars))
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        bare = 1 if node.name == "a" else 0
        node.total = sum(density(len(c.strip()), 1, bare * len(c.strip()), bare, share) if isinstance(c, str) else 0 if c.noise else c.density for c in node.children)


def spare_wrappers(root: Node) -> None:
    """If hardly any text is left beside what roles and classes mark, the marks of the largest parts don't count."""
    soft, todo, left, marked = [], [(root, None)], 0, {}
    while todo:
        node, under = todo.pop()
        if node.noise == SOFT and under is None:
            under = node
            soft.append(node)
            marked[id(node)] = 0
        for c in node.children:
            if isinstance(c, Node):
                if c.noise != HARD:
                    todo.append((c, under))
            elif under is None:
                left += len(c.strip())
            else:
                marked[id(under)] += len(c.strip())
    most = max(marked.values(), default=0)
    if left < 0.1 * most:
        for node in soft:
            if 2 * marked[id(node)] > most:
                node.noise = 0
        spare_wrappers(root)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Elements that hold running text; short ones among longer ones are text as well.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure figcaption table".split())


def widened(node: Node) -> Node:
    """The article element around ``node``, if there is one; else what adds no more than headings to it."""
    up = node
    while up is not None:
        if up.name == "article":
            return up
        up = up.parent
    while node.parent is not None and node.parent.parent is not None:
        others = [c for c in node.parent.children if c is not node and (c.strip() if isinstance(c, str) else not c.noise and c.chars)]
        if not all(isinstance(c, Node) and c.name in HEADINGS for c in others):
            break
        node = node.parent
    return node


def is_prose(node: Node) -> bool:
    return node.name in PROSE and 0 < node.chars and node.link_chars <= LINKED * node.chars


def has_title(node: Node) -> bool:
    return any(n.name == "h1" and n.chars for n in in_order(node))


def article(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    spare_wrappers(root)
    nodes = in_order(root)
    measure(nodes)
    best = max(nodes, key=lambda n: n.total)
    least, up = best.density, best
    while up.parent is not None:
        up = up.parent
        least = min(least, up.density)
    best = widened(best)
    if best is root:
        return [root]
    # beside the way from the body to it, branches as dense as the sparsest element of that way belong to it, and so does
    # running text in an element on this way, however short; beside an article element, only further ones do, and the block
    # before it that has the title which it lacks
    titled = best.name != "article" or has_title(best)
    path, up = {id(best)}, best
    while up.parent is not None:
        up = up.parent
        path.add(id(up))
    out: list[Node] = []
    todo = [c for c in reversed(root.children) if isinstance(c, Node) and not c.noise]
    while todo:
        node = todo.pop()
        if node is best:
            titled = True
            out.append(node)
        elif id(node) in path:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
        elif node.chars and node.density >= least and (best.name != "article" or node.name == "article"):
            out.append(node)
        elif best.name != "article" and is_prose(node) and node.parent is not root:
            out.append(node)
        elif not titled and node.name != "article" and has_title(node) and node.link_chars <= LINKED * node.chars:
            out.append(node)
        elif best.name == "article" and node.name != "article":  # further articles may have elements of their own around them
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
    return out


def text_of(nodes: list[Node]) -> str:
    """Character references decoded, blocks joined by a space, white space inside them turned into one."""
    out: list[str] = []
    for top in nodes:
        todo: list[Node | str] = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(html.unescape(x) if "&" in x else x)
            elif x.name not in INLINE:
                out.append(" ")
                if not x.noise:
                    todo.append(" ")
                    todo += reversed(x.children)
            elif not x.noise:
                todo += reversed(x.children)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    return text_of(article(parse(page))) if page and page.strip() else ""


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, keep: list[str] | None = None, page: str = "html") -> DataFrame:
    """``keep`` (page_id, url), text, n_chars."""
    keep = ["page_id", "url"] if keep is None else keep
    texts = pages.select(*keep, _main_texts(F.col(page)).alias("text"))
    return texts.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))

"""Main-text extraction from HTML by a minimum cut.

A page becomes its text blocks in page order, each with its chain of open elements.
A small additive classifier gives every block evidence for content and for
boilerplate (element names, class, id and role words, links, length); these are its
capacities to the two terminals.  Names in class, id and role (whole names, their last
part, or their first part before a word like "list") count for all below their element,
but length and paragraphs can outweigh them, and they count nothing on html, body,
article, main and on a wrapper that holds most of the page's text; nor does a form that
does.  Neighbouring blocks, and consecutive blocks of one
parent, are joined by smoothness capacities that shrink with their distance in the
DOM.  The maximum flow's cut labels all blocks of the page at once; the source side
is the article.

Blocks are divided by block elements; inline elements and `br` are white space or
nothing.  Scripts, styles, forms' controls and comments have no text; character
references are decoded; white space inside a block becomes one space.

A page without an article or main part keeps every block that nothing speaks against,
however short; what menus and notices say speaks against a short one.

The flow is found in two steps: nodes whose own evidence outweighs all their links are
settled first, which turns their links into evidence of their neighbours; Dinic's
algorithm cuts what is left.

Defined results: null, empty or wholly boilerplate html gives an empty text; unclosed
and stray tags, and tags cut off at the end, are tolerated; text outside any body is
text; repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role, and words of class, id and role
# attributes that mark parts of a page other than the article.
RAW = "script style noscript template textarea title svg math iframe object select option button".split()
BLOCK = ("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
         "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot "
         "thead tr ul").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
OUTSIDE = "nav footer aside menu dialog".split()
INSIDE = "article main".split()
NOISE = set("""ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices
overlay pager pagination popup promo promotion related replies reply respond search share sharing sidebar signup
social sponsor sponsored subscribe toolbar widget complementary contentinfo""".split())
HEAD_WORDS = {"header", "masthead", "top"}  # noise only outside the article
#: Last parts that leave the meaning of a name to its first part, as in "comments-area" or "related-posts".
SHAPES = set("""area articles bar block body bottom box button buttons card col column container content first form
grid group header icons inner item items last layer left link links list main outer panel post posts right row section
slot small stories text title unit wide wrap wrapper""".split())
#: What menus say, whole; and words that make a short block a notice.
MENU_TEXTS = set("""home|menu|contact|contact us|about|about us|login|log in|sign in|sign up|register|search|next|previous|
back|back to top|read more|more|share|imprint|sitemap|faq|help|privacy|privacy policy|terms|terms of use|startseite|kontakt|
impressum|datenschutz|anmelden|suche|accueil|connexion|recherche|inicio|contacto|buscar""".replace("\n", "").split("|"))
NOTICE_WORDS = set("""cookie cookies newsletter newsletters subscribe unsubscribe advertisement copyright cookie-richtlinie
abonnieren abonnez suscríbete""".split())
NOTICE_LENGTH = 15

WHOLE = "html body article main".split()  # never noise by their own words
#: Evidence and smoothness, in units of one link of a chain of paragraphs.
SURE, LIKELY, SMOOTH = 1000, 80, 30
#: Noise by the names in class, id and role: a paragraph of 36 words outweighs it.
WORDED = 90
#: Noise by what a short block says, on pages without an article.
SAID = 500

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_MARK = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAME = re.compile(r"[a-z0-9]+(?:[-_]+[a-z0-9]+)*")
_PART = re.compile(r"[-_]+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_BLOCK, _VOID, _OUTSIDE, _INSIDE, _WHOLE = set(BLOCK), set(VOID), set(OUTSIDE), set(INSIDE), set(WHOLE)
_CLOSES_P = _BLOCK - {"body", "html"}


def _says(name: str, noise: set) -> bool:
    """Whether a name is a noise word, ends with one, or begins with one and ends with a shape."""
    if name in noise:
        return True
    first, *rest = _PART.split(name)
    return bool(rest) and (rest[-1] in noise or ((rest[-1] in SHAPES or rest[-1].isdigit()) and first in noise))


def _names(attrs: str) -> tuple[list, bool]:
    """Names in class, id and role, and whether the element is hidden."""
    found, hidden = [], False
    for m in _MARK.finditer(attrs):
        kind, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id", "role"):
            found += _NAME.findall(value)
        elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            hidden = True
        elif kind == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return found, hidden


class _Element:
    """An open element; noise is 0, WORDED (names) or SURE; `inside` has bits for main (1) and article (2)."""

    __slots__ = ("name", "own", "noise", "inside", "depth", "parent", "size")

    def __init__(self, name, parent, attrs):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.inside = parent.inside if parent else 0
        self.own = self.size = 0
        names, hidden = _names(attrs) if attrs else ((), False)
        if name in _OUTSIDE or name == "form" or hidden or (name == "header" and not self.inside):
            self.own = SURE
        elif name not in _WHOLE and any(
                _says(n, NOISE) or (not self.inside and _says(n, HEAD_WORDS)) for n in names):
            self.own = WORDED
        if name in _INSIDE:
            self.inside |= 2 if name == "article" else 1
        self.noise = max(self.own, parent.noise if parent else 0)


def _judge(elements: list, found: list) -> None:
    """Spare forms and elements with noise words that hold most of the page's text.

    The page's text is that of its articles outside all noise, or else that of `main`, or else all text;
    what lies in an element that is noise by its name or hidden doesn't count.
    """
    lasting = {}
    for e in elements:  # parents come first
        lasting[e] = (e.own == SURE and e.name != "form") or (e.parent is not None and lasting[e.parent])
    some = [b for b in found if not lasting[b[1]]]
    page = ([b for b in some if not b[1].noise and b[1].inside & 2]
            or [b for b in some if b[1].inside & 1] or some)
    for text, e, _ in page:
        e.size += len(text)
    for e in reversed(elements):
        if e.parent:
            e.parent.size += e.size
    total = elements[0].size
    for e in elements:
        spared = (e.own == WORDED or e.name == "form") and 2 * e.size > total
        e.noise = max(0 if spared else e.own, e.parent.noise if e.parent else 0)
        begins = e.name in _INSIDE and not e.noise  # an article in noise is a comment or a teaser
        e.inside = begins or (e.parent is not None and bool(e.parent.inside))


def blocks(page: str) -> list:
    """[(text, innermost element, link characters)] in page order."""
    root = _Element("#root", None, "")
    stack, elements, out = [root], [root], []
    parts, linked, in_link, in_head = [], 0, 0, False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = next(e for e in reversed(stack) if e.name in _BLOCK or e is root)
                out.append((text, block, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            token = m[0]
            if m["raw"]:
                parts.append(" ")
            elif token[0] != "<" or len(token) == 1:
                if not in_head:
                    text = _html.unescape(token)
                    parts.append(text)
                    if in_link:
                        linked += len(text)
            continue
        name = name.lower()
        if name == "head":
            in_head = not m["close"]
            continue
        if in_head and name in _BLOCK:
            in_head = False
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if m["close"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("article", "main", "body", "html", "footer", "nav") and name not in _BLOCK:
                    break  # a stray inline end tag never closes a part of the page
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P:  # a block element ends an open paragraph, with what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in _BLOCK:
                    break
        if name == "li":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "li":
                    del stack[k:]
                    break
                if stack[k].name in ("ul", "ol", "menu"):
                    break
        if name == "a":
            in_link += 1
        if name in _BLOCK or not m["attrs"].endswith("/"):
            stack.append(_Element(name, stack[-1], m["attrs"]))
            elements.append(stack[-1])
    flush()
    if any(e.own for e in elements):
        _judge(elements, out)
    return out


def evidence(text: str, element: _Element, linked: int, marked: bool = True) -> tuple[int, int]:
    """Capacities of a block to the content and to the boilerplate terminal; `marked`: the page has an article."""
    content, other = 0, 0
    if element.noise:
        other += element.noise
    elif element.inside:
        content += LIKELY
    words = text.count(" ") + 1
    content += 2 * min(words, 40)
    if element.name == "p":
        content += 20
    if not element.inside:
        if marked:
            other += 80 if element.name == "li" else 60
        if "©" in text:
            other += 40
    if 2 * linked > len(text):
        other += 60 if not element.inside else 10
    if not marked:  # a page without an article: only evidence removes text, no neighbours
        if _notice(text, words):
            other += SAID
        elif not other:
            content += SURE
    return content, other


def _notice(text: str, words: int) -> bool:
    """Whether a block says what menus and notices say."""
    if words > NOTICE_LENGTH:
        return False
    low = text.lower()
    return low.strip(" .:!»›>|") in MENU_TEXTS or not NOTICE_WORDS.isdisjoint(_SPOKEN.findall(low))


def _kinship(a: _Element, b: _Element) -> int:
    """Smoothness between two blocks: full for one parent, less with every element between them."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return SMOOTH // max(1, steps - 1) if steps > 1 else SMOOTH


def _settled(left: list, near: list) -> list:
    """Labels that a node's own evidence decides against all its links together, None elsewhere.

    A settled node's links become evidence of its neighbours, which may settle them in turn; `left` and `near` keep
    what is still open.  Such labels hold in the minimum cut with the smallest content side.
    """
    label = [None] * len(left)
    todo = list(range(len(left)))
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        pull = sum(near[i].values())
        if left[i] > pull or -left[i] >= pull:
            label[i] = left[i] > pull
            for j, w in near[i].items():
                del near[j][i]
                left[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    return label


def cut(content: list, other: list, links: list) -> list:
    """For every node, whether it is on the content side of the minimum cut with the smallest content side."""
    n = len(content)
    left = [c - o for c, o in zip(content, other, strict=True)]  # flow through one node alone cancels
    near: list = [{} for _ in range(n)]
    for a, b, w in links:
        if w and a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0) + w
    label = _settled(left, near)
    open_ = [i for i in range(n) if label[i] is None]
    # Dinic: levels from all nodes with evidence left to give, then paths that go up one level at a time
    while True:
        level = {i: 0 for i in open_ if left[i] > 0}
        queue, goal = list(level), None
        for i in queue:
            if left[i] < 0 and goal is None:
                goal = level[i]
            if goal is not None and level[i] >= goal:
                continue
            for j, w in near[i].items():
                if w > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if goal is None:
            for i in open_:
                label[i] = i in level
            return label
        ahead: dict = {}
        for start in [i for i in queue if level[i] == 0]:
            path = [start]
            while left[start] > 0:
                i = path[-1]
                if left[i] < 0:
                    flow = min(left[start], -left[i], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
                    left[start] -= flow
                    left[i] += flow
                    for a, b in zip(path, path[1:], strict=False):
                        near[a][b] -= flow
                        near[b][a] += flow
                    path = [start]
                    continue
                if i not in ahead:
                    ahead[i] = [j for j in near[i] if level.get(j) == level[i] + 1]
                while ahead[i] and near[i][ahead[i][-1]] <= 0:
                    ahead[i].pop()
                if ahead[i]:
                    path.append(ahead[i][-1])
                elif len(path) == 1:
                    break
                else:
                    path.pop()
                    ahead[path[-1]].pop()


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    marked = any(e.inside and not e.noise for _, e, _ in found)
    costs = [evidence(*b, marked) for b in found]
    links, last_child = [], {}
    for k, (_, element, _) in enumerate(found):
        if k:
            links.append((k - 1, k, _kinship(found[k - 1][1], element)))
        family = id(element.parent)
        if family in last_child and last_child[family] < k - 1:
            links.append((last_child[family], k, SMOOTH // 2))
        last_child[family] = k
    keep = cut([c for c, _ in costs], [o for _, o in costs], links)
    return "\n".join(b[0] for b, good in zip(found, keep, strict=True) if good)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of (page_id, url, html)."""
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_extract, ", ".join([*kinds, "text string"]))


def extract_pages(pages: DataFrame) -> DataFrame:
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))

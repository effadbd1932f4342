"""Main text of web pages by scoring the element tree.

1. A page is read in one pass over its tags. What an element is (menu, footer,
   script) leaves it out; a header stays inside an article.
2. Each block of running text passes points, for its length and its commas, to
   its container and half of them to the one above; a container's points are
   discounted by the share of its text that is link text. Forms, and elements whose
   class or id words name noise, alone or as the first or last part of a longer name,
   count little, unless most of the page's text is in them: then the name is not
   about noise. An article counts more.
3. The container with most points, or the article around it, is the main text, with
   those of its siblings that score well or read like paragraphs. Outside an article
   what stands beside its ancestors and holds as much text as a sibling that is kept
   is kept as well, so a text that is dealt over several wrappers stays whole.
4. Noise is left out then, but never what holds the best container, and so are link
   lists before the first and behind the last paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by role, and words of class and id that name noise.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
_SKIP = frozenset("nav footer aside menu dialog head search".split())
_ASKING = frozenset("form fieldset".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SELF_CLOSING = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
_INLINE_CLOSED = frozenset("b i u em strong a span small font code sub sup mark q cite".split())
_NOISE = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|comment-list|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notice|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget")
_NOISE_ROLE = frozenset("banner navigation complementary contentinfo search dialog alert menu form".split())
#: Text that passes its points on to what is around it.
_PARAGRAPH = frozenset("p pre td h1 h2 h3 h4 h5 h6 li blockquote figcaption dd dt".split())
#: What cannot be the main text by itself, and siblings that read like paragraphs.
_PART = frozenset("p li td th tr tbody thead h1 h2 h3 h4 h5 h6 blockquote ul ol dl dd dt table figure figcaption pre".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure header hgroup".split())
#: A name that only mentions noise, as a part joined by - or _; and one that it begins or ends with.
_MENTION = re.compile(rf"(?:^|[_-])(?:{_NOISE.pattern})(?:$|[_-])")
_COMPOUND = re.compile(rf"(?:{_NOISE.pattern})[_-].*|.*[_-](?:{_NOISE.pattern})|(?:comments?|cookies?|ads?|news)(?:list|box|form|bar|slot|unit|banner|section|area|thread|letter)")
#: Words that an article's own parts are named by as well: alone they are noise, in longer names only where there is no text to read.
_WEAK = frozenset("banner header masthead menu notice related share sharing social toolbar widget".split())
#: Names that speak of noise elsewhere, and words for what readers write, which may be more than the article.
_STATE = re.compile(r"(?:no|has|with|without|is|show|hide)[_-].*|.*[_-](?:with|without|no)[_-].*|.*[_-](?:open|closed|enabled|disabled|off|on)")
_READERS = re.compile(r"(?:.*[_-])?(?:comments?|comment(?:list|s?area|section|thread|box)|disqus|replies)(?:[_-].*)?")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Elements that hold a page or its article: no class or id makes them noise.
_HOLDERS = frozenset("html body main article".split())
_PLAIN, _MENTIONED, _WEAKLY, _NAMED, _READERS_OWN = range(5)
#: Shares of the points that are left by a mention, and within a named element; what an article's are multiplied by.
MENTIONED, NAMED, ARTICLE = 0.5, 0.2, 1.5
#: The share of a page's text beyond which nothing is noise (but readers' comments, if any article is left), and of links from which a weak name is; lists of links.
MOST, LINKED = 0.5, 0.2
_LISTS = frozenset("td th tr table tbody ul ol dl div section".split())
#: Points of a block that is long enough, at most for its length, and the share of the best one's that keeps a sibling.
LEAST_TEXT, MOST_LENGTH, SIBLING = 25, 3, 0.2
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+))?+")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "noisy", "noise", "points", "gain", "length", "links")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, noisy: int = _PLAIN) -> None:
        self.tag, self.parent, self.skip, self.noisy = tag, parent, skip, noisy
        self.children: list[Node | str] = []
        self.noise, self.points, self.gain = False, 0.0, 0.0
        self.length = self.links = 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.skip]


@lru_cache(maxsize=4096)
def _noise(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is left out for what it is, and whether a word of its class or id names or mentions noise."""
    if tag in _SKIP:
        return True, _PLAIN
    noisy = _NAMED if tag in _ASKING else _PLAIN
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "role" and value.lower() in _NOISE_ROLE and value.lower() != "form" and tag not in _HOLDERS):
            return True, _PLAIN
        if name in ("class", "id") and tag not in _HOLDERS:
            for t in _HUMP.sub("-", value).lower().split():
                noisy = max(noisy, _named(t))
    return False, noisy


def _named(word: str) -> int:
    """What a word of a class or id says of noise."""
    if not _STATE.fullmatch(word) and (_NOISE.fullmatch(word) or _COMPOUND.fullmatch(word)):
        weak = word not in _WEAK and all(part in _WEAK for part in re.split("[_-]", word) if _NOISE.fullmatch(part)) and "_" in word.replace("-", "_")
        return _READERS_OWN if _READERS.fullmatch(word) else _WEAKLY if weak else _NAMED
    return _MENTIONED if _MENTION.search(word) else _PLAIN


def _tags(html: str) -> Iterator[tuple[str, str, str, int, int]]:
    """Tags as (slash, name, attributes, begin, end), comments and declarations without a name.

    A ``<`` that begins no tag is text. Where a quotation mark is never closed,
    quotes count for nothing from there on, so every character is passed at most twice.
    """
    pattern, at = _TAG, 0
    while (begin := html.find("<", at)) >= 0:
        follows = html[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            close = html.find("-->", begin + 4) + 2 if html.startswith("<!--", begin) else html.find(">", begin)
            at = close + 1 if close > begin else len(html)
            yield "", "", "", begin, at
            continue
        if not (follows.isascii() and follows.isalpha()) and not (follows == "/" and html[begin + 2 : begin + 3].isalpha()):
            at = begin + 1
            continue
        tag = pattern.match(html, begin)
        if tag is None and pattern is _TAG:
            pattern = _UNQUOTED
            tag = pattern.match(html, begin)
        if tag is None:
            if html.find(">", begin) < 0:
                return
            at = begin + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if name == "svg" and tag[3].endswith("/"):
            yield "", "", "", begin, at
        elif name in _RAW and not tag[1]:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = close.end() if close else len(html)
            yield "", "", "", begin, at
        else:
            yield tag[1], name, tag[3], begin, at


def parse(html: str) -> Node:
    """The element tree; raw-text elements are left out, open ones are closed as browsers do."""
    root = node = Node("html", None)
    open_: dict[str, int] = {}
    articles = at = 0

    def leave(to: Node) -> Node:
        nonlocal articles
        up = node
        while up is not to:
            open_[up.tag] -= 1
            articles -= up.tag in ("article", "main")
            up = up.parent
        return to

    for slash, name, attributes, begin, end in _tags(html):
        if begin > at:
            node.children.append(html[at:begin])
        at = end
        if not name:
            continue
        if slash:
            found = node if open_.get(name) else root
            while found is not root and found.tag != name:
                # A formatting element's end tag reaches no further than the block around it.
                found = root if name in _INLINE_CLOSED and found.tag in _BLOCK else found.parent
            if found is not root:
                node = leave(found.parent)
            continue
        if name in _BLOCK:
            # A block ends formatting that was left open in a paragraph, and the paragraph.
            up = node
            while up is not root and up.tag in _INLINE_CLOSED:
                up = up.parent
            if name in _SELF_CLOSING.get(up.tag, ()):
                node = leave(up.parent)
        if name in _VOID:
            node.children.append(" " if name in ("br", "wbr", "hr", "img") else "")
            continue
        child = Node(name, node, *_noise(name, attributes.strip()))
        child.skip |= name == "header" and not articles
        node.children.append(child)
        if not (attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\t", "\n", '"', "'")):
            node = child
            open_[name] = open_.get(name, 0) + 1
            articles += name in ("article", "main")
    if at < len(html):
        node.children.append(html[at:])
    return root


def _in_order(root: Node) -> list[Node]:
    order = [root]
    for node in order:
        order.extend(node.elements())
    return order


def score(root: Node) -> list[Node]:
    """Set text and link lengths of all nodes, and the points of containers; returns those that have points."""
    order = _in_order(root)
    paragraphs: list[tuple[Node, float]] = []
    for node in reversed(order):
        own = "".join(c for c in node.children if isinstance(c, str)).strip()
        inner = node.elements()
        node.length = len(own) + sum(c.length for c in inner)
        node.links = node.length if node.tag == "a" else sum(c.links for c in inner)
        direct = len(own) + sum(c.length for c in inner if c.tag not in _BLOCK)
        if direct >= LEAST_TEXT and node.tag in _BLOCK and node.parent:
            paragraphs.append((node, 1 + own.count(",") + min(direct // 100, MOST_LENGTH)))
            node.gain = paragraphs[-1][1] * (1 - node.links / node.length)
        node.gain += sum(c.gain for c in inner)
    scored: dict[Node, None] = {}
    for node, gain in paragraphs:
        target = node.parent if node.tag in _PARAGRAPH else node
        for container, share in ((target, 1.0), (target.parent, 0.5)):
            if container is not None:
                container.points += gain * share
                scored[container] = None
    within: dict[Node, bool] = {}
    for node in order:
        density = node.links / node.length if node.length else 0.0
        held = node.gain / root.gain if root.gain else node.length / root.length if root.length else 0.0
        reads = density < LINKED and node.gain >= 2
        node.noise = (held <= MOST and (node.noisy >= _NAMED or (node.noisy == _WEAKLY and not reads))) or (node.noisy == _READERS_OWN and root.gain - node.gain >= 2)
        within[node] = node.noise or bool(node.parent and within[node.parent])
        if node.points:
            node.points *= 1 - density
            node.points *= NAMED if within[node] else MENTIONED if node.noisy and held <= MOST else ARTICLE if node.tag in ("article", "main") else 1.0
    return list(scored)


def _without_lists(kept: list[Node]) -> None:
    """Mark lists of links before the first paragraph and behind the last one."""
    order: list[Node] = []
    stack = kept[::-1]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.elements()))
    own = [k for k, x in enumerate(order) if x.gain and not any(c.gain for c in x.elements())]
    if not own:
        return
    for k, x in enumerate(order):
        if x.tag in _LISTS and not x.gain and x.length and x.links / x.length >= 0.8 and not own[0] < k < own[-1]:
            x.skip = True


def chosen(root: Node) -> list[Node]:
    """The best container and what beside it is kept, in page order; noise around and in them is marked."""
    best = max(score(root), key=lambda n: n.points, default=root)
    points = best.points
    while best.parent is not None and best.tag in _PART:
        best = best.parent
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    best = up or best
    holders, up = {}, best
    while up is not None:
        holders[up] = None
        up = up.parent
    for node in _in_order(root):
        node.skip |= node.noise and node not in holders
    kept = {best: None}
    least = SIBLING * max(points, best.points)
    for holder in holders:
        if holder.parent is None or holder.tag in ("main", "body") or (best.tag == "article" and holder is not best):
            break
        beside = {}
        for x in holder.parent.elements():
            density = x.links / x.length if x.length else 0.0
            near = holder is best and (bool(x.points and x.points >= least) or (x.tag in _PROSE and density < 0.25) or (x.tag == best.tag == "article" and density < 0.5))
            level = best.tag != "article" and x.gain >= SIBLING * best.gain > 0 and density < 0.25
            if x is holder:
                beside |= kept
            elif near or level:
                beside[x] = None
        kept = beside
    _without_lists(list(kept))
    return list(kept)


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below a node in page order: entities decoded, white space as one space."""
    pending: list[str] = []

    def flush() -> None:
        text = _WHITE.sub(" ", "".join(pending)).strip()
        pending.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            pending.append(unescape(x) if "&" in x else x)
        elif not x.skip:
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def main_text(html: str) -> str:
    """The article's text, blocks joined by an empty line; empty if the page has none."""
    out: list[str] = []
    for node in chosen(parse(html)):
        _blocks(node, out)
    return "\n\n".join(out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns page_id, url, text, n_chars (code points), a row per page.

    Null or empty html, and pages without running text outside menus, headers,
    footers and the like: empty text. A page without tags is one block. Tags that
    are never closed or never opened are handled as browsers do; a page is taken
    whole, however long. Null ids and urls are carried through, repeated pages are
    separate rows. An empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")

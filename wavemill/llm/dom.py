"""Small tolerant reader of HTML pages: blocks of text with the label path of their element."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the HTML standard: elements without content, with raw text, that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends without a closing tag: a tag and the elements that bound the search for it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Elements and roles that never hold the article.
ASIDE_TAGS = frozenset("nav footer aside form head button select menu dialog fieldset search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark menus, adverts, notices, comments and the like.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments respond reply replies disqus cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget widgets toolbar copyright skip tagcloud aside".split()
)

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")


class Open:
    """An element on the stack."""

    __slots__ = ("tag", "path", "aside", "article", "header", "main", "marks", "is_article", "has_article", "chars")

    def __init__(self, tag, path, aside, article, header, main=False, marks=()):
        self.tag, self.path, self.aside, self.article, self.header = tag, path, aside, article, header
        #: Inside <main>; this and outer elements with a word of ASIDE_WORDS; what such an element is and holds.
        self.main, self.marks = main, marks
        self.is_article, self.has_article, self.chars = False, False, 0


def describe(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """Label of an element for matching, whether it is beside the article, whether a class word says so, whether it is the article."""
    label, aside, marked, article = tag, tag in ASIDE_TAGS, False, tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            marked = marked or not ASIDE_WORDS.isdisjoint(w.lower() for w in WORD.findall(value))
            label += ("." if name == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split()))
        elif name == "role":
            aside = aside or value.strip().lower() in ASIDE_ROLES
            article = article or value.strip().lower() in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            aside = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            aside = True
    page = tag in ("html", "body")
    return label.replace("/", "|"), aside and not page, marked and not page, article and not aside


#: Share of a page's text outside fixed asides from which an element isn't beside the article, whatever its class.
MOST = 0.9


def unmarked(found: list[tuple[str, str, bool, bool, Open]]) -> list[tuple[str, str, bool, bool]]:
    """Blocks with class words applied, but for words on an element that is or holds the article or nearly all text."""
    good = [(text, article, top) for _, text, ok, article, top in found if ok]
    marks = {}
    for text, _, top in good:
        for e in top.marks:
            marks[id(e)] = e
            e.chars += len(text)
    all_chars = sum(len(text) for text, *_ in good)
    plain = [top for _, article, top in good if article and not top.marks]
    articles = any(not top.main for top in plain)  # an article of its own, not just a place in <main>
    void = {
        k
        for k, e in marks.items()
        if e.chars >= MOST * all_chars or e.is_article and not articles or e.has_article and not plain
    }
    return [(path, text, ok and all(id(e) in void for e in top.marks), article) for path, text, ok, article, top in found]


def blocks(html: str | None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, candidate, in article) of all blocks of text in page order.

    The path has the labels of the open block elements; a block is a candidate unless an element
    around it is beside the article; a class word does not make an element so that is or holds the
    article or nearly all text (``unmarked``).  A header inside an article lends only its headings.  White
    space is one space, character references are decoded, a <br> is white space.
    """
    stack = [Open("", "", False, False, False)]
    out, text = [], []

    def close():
        if text:
            line = SPACES.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if line:
                top = stack[-1]
                good = not top.aside and (not top.header or top.tag in HEADING)
                out.append((top.path, line, good, top.article, top))

    def pop_to(tags, bounds=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close()
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    html, at = html or "", 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                pop_to({tag}, {"table", "article", "body"} - {tag})
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at) if not m[3].endswith("/") else None
            at = end.end() if end else at if m[3].endswith("/") else len(html)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK:
            continue
        if tag in ENDS:
            pop_to(*ENDS[tag])
        else:
            pop_to({"p"}, BLOCK - {"p"})
        close()
        if tag in VOID:
            continue
        top = stack[-1]
        label, aside, marked, article = describe(tag, m[3])
        inside = top.article or article and not top.aside
        header = top.header or tag == "header" and inside
        aside = top.aside or aside or tag == "header" and not inside
        if article and not aside:
            for e in top.marks:
                e.has_article = True
        # The nearest of <article> and <main> counts: text of <main> alone is no article of its own.
        main = (tag != "article") if article else top.main
        stack.append(own := Open(tag, f"{top.path}/{label}", aside, inside and not aside, header, main, top.marks))
        if marked:
            own.marks, own.is_article = (*top.marks, own), article
    if at < len(html):
        text.append(html[at:])
    close()
    return unmarked(out)


def tree(paths: list[str]) -> dict:
    """Nested labels of a list of paths, in order of first sight: same-label siblings are one node."""
    root: dict = {}
    for path in paths:
        node = root
        for label in path.split("/")[1:]:
            node = node.setdefault(label, {})
    return root


def match(a: dict, b: dict) -> tuple[int, list[tuple[tuple[str, ...], tuple[str, ...]]]]:
    """Simple tree matching of the children of two nodes: matched nodes, and the matched paths.

    Nodes match if their tags are equal, in order; equal whole labels count a little more.
    """
    x, y = list(a.items()), list(b.items())
    best = [[(0, ())] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, (la, ca) in enumerate(x, 1):
        for j, (lb, cb) in enumerate(y, 1):
            top = max(best[i - 1][j], best[i][j - 1], key=lambda s: s[0])
            if re.split(r"[.#]", la, maxsplit=1)[0] == re.split(r"[.#]", lb, maxsplit=1)[0]:
                under, pairs = match(ca, cb)
                score = best[i - 1][j - 1][0] + 2 + (la == lb) + under
                if score > top[0]:
                    top = (score, (best[i - 1][j - 1], la, lb, pairs))
            best[i][j] = top
    pairs, state = [], best[-1][-1]
    score = state[0]
    while state[1]:
        state, la, lb, under = state[1]
        pairs.append(((la,), (lb,)))
        pairs += [((la, *p), (lb, *q)) for p, q in under]
    return score, pairs

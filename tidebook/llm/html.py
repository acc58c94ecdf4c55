"""Main text of web pages by tree scoring.

Every block of text (a paragraph, a heading, a list item, loose text) passes
points to its containers: one, one for each comma, one for each hundred characters up to three;
its parent gets all of them, the parent above half, the one above that a third.
Points are discounted by the share of the block's characters that are links.
The container with most points and its siblings that score enough are kept, without
the parts that are furniture by element, role or name. Names are judged once the page is
read: one that would take the article away counts for nothing. Readers' comments are also told
by their heading and place, and notices by a button in a short part beside the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from .common import no_clash, small_batches

#: Elements that never hold article text.
FURNITURE = set(
    "head footer aside script style noscript iframe object embed template button select textarea option "
    "svg canvas audio video map dialog menu datalist applet frameset noframes title fieldset label input".split())
#: Elements that hold none either, unless the page stands in them; judged like names.
WRAPPERS = {"form": "<form>", "nav": "<nav>"}
#: Points of all text in a form or a menu from which on it can be what the page stands in.
ARTICLE = 8
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in a class or an id that mark furniture.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion promoted banner "
    "banners cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "signup signin login paywall menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidebars "
    "aside widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "disqus respond replies reply footer foot header masthead topbar toolbar copyright skip rail hidden "
    "trending outbrain taboola".split())
#: Of these, words for text of another kind, which no layout is named after.
OTHERS = NAMES & set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion promoted cookie "
    "cookies consent gdpr newsletter subscribe subscription signup signin login paywall related recommended recommendations comment "
    "comments commentlist disqus respond replies reply copyright trending outbrain taboola".split())
#: Words that make what follows (has-sidebar) or what comes before (ad-free) a remark on the element, not its name.
BEFORE, AFTER = set("has with without no non not overflow show hide".split()), set("free open closed enabled disabled".split())
#: Words in a class or an id that mark the article.
GOOD = set("article content main post entry body story text page".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption head title option select button textarea template noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
#: What a start tag closes first if it is open, up to the given borders.
CLOSES = {"p": ({"p"}, {"div", "article", "section", "td", "th", "li", "body", "main", "blockquote", "aside", "footer", "nav", "header", "form"}),
          "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select", "datalist"})}
ENDS_P = BLOCKS - {"html", "body", "head", "title", "option", "button", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S)
#: Headings that readers' comments stand under, in the languages of the pages; the second kind only with a number or over alike parts.
_READERS = re.compile(r"(?:(?:\d+|no|add|post|leave|write) (?:a |your |new )*)?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?:?|(?:\d+|no) comments? on .*|leave a (?:reply|comment)", re.I)
_TALK = re.compile(r"((?:\d+|no) )?(?:reader |user )?(?:discussion|conversation|responses?|repl(?:y|ies)|reactions?|thoughts|antworten|réponses?|respuestas?)( ?\(?\d+\)?)?(?: (?:to|on) .*)?:?", re.I)
#: Characters up to which something with a button that stands beside the article is a notice.
NOTICE = 400

_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Node:
    __slots__ = ("tag", "parent", "out", "named", "score", "leaf", "size", "links", "points", "told", "head", "inside", "flag", "branch", "knobs")

    def __init__(self, tag: str, parent: _Node | None, out: bool, named: set[str], leaf: bool, score: float):
        self.tag, self.parent, self.out, self.named, self.leaf, self.score = tag, parent, out, named, leaf, score
        self.knobs = False
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)


#: A block of text: its container, its text, and how many of its characters are links.
Block = tuple[_Node, str, int]


def _points(text: str, links: int) -> float:
    return (1 + text.count(",") + min(3, len(text) // 100)) * (1 - links / len(text))


def _add_up(nodes: list[_Node], blocks: list[Block]) -> None:
    """Sizes, links, points, headlines, and whether they tell something, of all containers, from the innermost outwards."""
    for n in nodes:
        n.size = n.links = 0
        n.points, n.told, n.head = 0.0, False, False
    for node, text, links in blocks:
        node.size += len(text)
        node.links += links
        node.points += _points(text, links)
        node.told |= node.leaf or text.rstrip("\"')]»”’").endswith((".", "!", "?", "…", "。"))
        node.head |= node.tag in ("h1", "h2")
    for n in reversed(nodes):  # children come after their parents
        if (up := n.parent) is not None:
            up.size += n.size
            up.links += n.links
            up.points += n.points
            up.told |= n.told
            up.head |= n.head
            up.knobs |= n.knobs


def _talked(nodes: list[_Node], blocks: list[Block]) -> list[Block]:
    """The blocks without readers' comments, told by where they stand: under a heading of that kind, after other text.

    The heading and what follows it in its container go, up to the next heading there. Where the heading may as well be an article's own (Discussion), it must have
    a number, or parts alike must follow, each a container of its own. What would take half of the page's text stays.
    """
    _add_up(nodes, blocks)
    total, seen, gone = sum(len(text) - links for _, text, links in blocks), False, set()
    children: dict[_Node, list[_Node]] = {}
    first: dict[_Node, str] = {}
    for node, text, _ in blocks:
        first.setdefault(node, text)
    heads = [n for n in nodes if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and n in first and len(first[n]) <= 80 and (_READERS.fullmatch(first[n]) or _TALK.fullmatch(first[n]))]
    if not heads:
        return blocks
    for n in nodes:
        if n.parent is not None and n.size:
            children.setdefault(n.parent, []).append(n)
    looked: set[_Node] = set()
    for h in heads:
        top = h
        while top.parent is not None and top.parent.size == top.size and top.parent.parent is not None:  # a heading that is wrapped up alone
            top = top.parent
        if top.parent in looked:  # the first of a container's headings of that kind is enough
            continue
        looked.add(top.parent)
        beside = children.get(top.parent, [])
        after = beside[beside.index(top) + 1 :]
        stop = next((k for k, n in enumerate(after) if n.tag in ("h1", "h2", "h3") and n.tag <= h.tag), len(after))
        part = after[:stop]
        parts = [n for n in part if not n.leaf]
        lists = [c for n in parts for c in children.get(n, []) if n.tag in ("ul", "ol", "dl")]
        alike = max([sum(1 for n in found if n.tag == tag) for found in (parts, lists) for tag in {n.tag for n in found}], default=0)
        sure = _READERS.fullmatch(first[h]) or (m := _TALK.fullmatch(first[h])) and (m[1] or m[2])
        if part and (sure or alike >= 2) and 2 * sum(n.size - n.links for n in [top, *part]) < total:
            gone |= {top, *part}
    for n in nodes:
        n.flag = n in gone or (n.parent is not None and n.parent.flag)
    for node, _, _ in blocks:  # an article comes before what its readers say
        if node.flag and not seen:
            return blocks
        seen = True
    return [b for b in blocks if not b[0].flag]


def _names(tag: str, tokens: list[str]) -> tuple[set[str], bool]:
    """The words of a class and an id that may mark furniture, and whether others mark the article."""
    bad, good = set(), False
    for token in tokens:
        words = [w.lower() for w in _WORD.findall(token)]
        here = {w for k, w in enumerate(words) if w in NAMES and BEFORE.isdisjoint(words[:k]) and AFTER.isdisjoint(words[k + 1 :])}
        marks = not GOOD.isdisjoint(words)
        if marks:
            here -= {"header", "masthead"}
        good |= marks and not here
        bad |= here
    if tag == "article":
        bad &= {"comment", "ad", "ads", "sponsored", "promo", "related", "reply"}
    return (bad & OTHERS if good else bad), good


def _judge(tag: str, attrs: str, parent: _Node) -> tuple[bool, set[str], float]:
    """Whether an element is furniture for sure, words of its names that say so, and the points it starts with."""
    if tag in FURNITURE or (tag == "header" and not parent.inside):
        return True, set(), 0.0
    wrapper = {WRAPPERS[tag]} if tag in WRAPPERS else set()
    score, tokens = 25.0 if tag == "article" else 15.0 if tag == "main" else 0.0, []
    if attrs.strip("/> \t\r\n") and "=" in attrs or "hidden" in attrs.lower():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True, set(), 0.0
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, set(), 0.0
            if name == "role" and value.lower() in ROLES:
                return True, set(), 0.0
            if name in ("class", "id"):
                tokens += value.split()
    if not tokens or tag in ("html", "body", "main"):
        return False, wrapper, score
    bad, good = _names(tag, tokens)
    if parent.inside and tag in ("header", "h1", "h2", "h3", "p"):
        bad -= {"header"}
    return False, bad | wrapper, score + 10.0 * (good and not bad)


def _ring(marked: list[_Node]) -> set[_Node]:
    """All containers around the marked ones."""
    out: set[_Node] = set()
    for n in marked:
        up = n.parent
        while up is not None and up not in out:
            out.add(up)
            up = up.parent
    return out


def _unnamed(nodes: list[_Node], blocks: list[Block]) -> list[Block]:
    """The blocks that no container's name marks as furniture; all outside forms and menus if there are no others.

    A word for a place in the layout counts for nothing where one container or all together would take
    most of the page's text that is no link, and around the only article; no word counts around an article
    with most of that text. Inside an article, a header with a headline stays. A form or a menu counts as none
    where it holds most of that text and enough points for an article.
    """
    _add_up(nodes, blocks)
    full = [n for n in nodes if n.size]
    if not any(n.named for n in full):
        return blocks
    total = sum(len(text) - links for _, text, links in blocks)
    alike: dict[tuple, int] = {}  # children of one container with the same words stand together
    for n in full:
        key = n.parent, frozenset(n.named)
        alike[key] = alike.get(key, 0) + n.size - n.links
    says = {n: n.named & OTHERS if 2 * alike[n.parent, frozenset(n.named)] > total else n.named for n in full}
    wraps = set(WRAPPERS.values())
    for n in full:
        if n.tag in WRAPPERS and not (2 * (n.size - n.links) > total and n.points >= ARTICLE):
            says[n] = says[n] | {WRAPPERS[n.tag]}
        elif n.tag in WRAPPERS:
            says[n] = says[n] - wraps
    said: dict[_Node | None, frozenset[str]] = {None: frozenset()}  # by a container or one around it
    taken: dict[str, int] = {}
    for n in full:
        new = says[n] - said[n.parent]
        said[n] = said[n.parent] | new if new else said[n.parent]
        for w in new:
            taken[w] = taken.get(w, 0) + n.size - n.links
    void = {w for w, size in taken.items() if w not in OTHERS | wraps and 2 * size > total}
    marked = [n for n in full if n.tag in ("article", "main") and n.size > n.links and not n.named]
    held = _ring(marked) if all(said[n] - void for n in marked) else set()
    around = _ring([n for n in marked if 2 * (n.size - n.links) > total])
    for n in full:
        if n in held:
            but = NAMES - OTHERS | wraps
        else:
            but = {"header", "masthead"} if n.inside and n.head else set()
        bad = says[n] - void - but if n not in around else set()
        n.flag = (n.parent is not None and n.parent.flag) or bool(bad)
        n.branch = (n.parent is not None and n.parent.branch) or not wraps.isdisjoint(bad)
    return [b for b in blocks if not b[0].flag] or [b for b in blocks if not b[0].branch]


def main_text(html: str | None) -> str:
    """The article of one page, its blocks joined by newlines; empty if there is none."""
    root = _Node("#root", None, False, set(), False, 0.0)
    stack, nodes, blocks, buf = [root], [root], [], []
    there: dict[str, int] = {}  # open elements by tag
    link_depth = link_chars = 0
    html = html or ""

    def flush() -> None:
        nonlocal buf, link_chars
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if text and not stack[-1].out:
                blocks.append((stack[-1], text, min(link_chars, len(text))))
            buf, link_chars = [], 0

    def pop(tags: set[str], borders: set[str]) -> None:
        if not any(there.get(x) for x in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                for n in stack[k:]:
                    there[n.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in borders:
                return

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at and not stack[-1].out:
            buf.append(html[at : m.start()])
            if link_depth:
                link_chars += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCKS or tag in FURNITURE:
                if tag in ("article", "main", "section", "div", "body", "html", "p", "li"):
                    pop({tag}, {"td", "th"} if tag in ("p", "li") else set())
                else:
                    pop({tag}, {"article", "body", "html"} - {tag})
                flush()
            elif tag == "br":
                buf.append(" ")
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = len(html) if end is None else html.find(">", end.end()) + 1 or len(html)
            continue
        if tag == "a":
            link_depth += 1
        elif tag in VOID:
            if tag == "input":
                stack[-1].knobs = True
            if tag == "hr":
                flush()
            elif tag == "br":
                buf.append(" ")
        elif tag in BLOCKS or tag in FURNITURE:
            flush()
            link_depth = 0
            if tag in ENDS_P:
                pop({"p"}, CLOSES["p"][1])
            if tag in CLOSES:
                pop(*CLOSES[tag])
            if tag == "body":
                pop({"head"}, set())
            parent = stack[-1]
            out, named, score = (True, set(), 0.0) if parent.out else _judge(tag, m[3], parent)
            stack.append(_Node(tag, parent, out, named, tag in LEAVES, score))
            there[tag] = there.get(tag, 0) + 1
            if not out:
                nodes.append(stack[-1])
            elif tag in ("button", "input", "select", "textarea"):
                parent.knobs = True
    if at < len(html) and not stack[-1].out:
        buf.append(html[at:])
    flush()
    if not blocks:
        return ""
    blocks = _unnamed(nodes, blocks)
    if blocks:
        blocks = _talked(nodes, blocks)
    if not blocks:
        return ""
    _add_up(nodes, blocks)
    touched: dict[_Node, None] = {}
    for node, text, links in blocks:
        points, top = _points(text, links), node.parent if node.leaf and node.parent else node
        for share in (1.0, 0.5, 1 / 3):
            if top is None:
                break
            top.score += points * share
            touched[top] = None
            top = top.parent
    for node in touched:
        node.score *= 1 - node.links / max(1, node.size)
    best = max(touched, key=lambda n: n.score)
    up = best.parent
    while up is not None:  # a part of a marked article stands for the article
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.tag in ("article", "main"):
        return _beside_marked(best, nodes, blocks)
    return _beside(best, nodes, blocks)


def _few(node: _Node) -> bool:
    return node.links < 0.25 * node.size


def _beside_marked(best: _Node, nodes: list[_Node], blocks: list[Block]) -> str:
    """The text of a page with a marked article: it, siblings that score enough, longer ones that are one block, and a headline."""
    enough, at = max(10.0, 0.2 * best.score), best.parent
    for n in nodes:  # the child of the article's parent in which a container is, if it stays
        if n.parent is not at or n is best or at is None:
            n.branch = n.parent.branch if n.parent is not None and n is not best else n is best
        else:
            n.branch = at.parent is not None and (
                n.score >= enough and not (n.knobs and n.size <= NOTICE and not n.head) or (n.leaf and (n.size > 80 or n.tag in ("h1", "h2")) and _few(n)))
    return "\n".join(text for node, text, _ in blocks if node.branch)


def _beside(best: _Node, nodes: list[_Node], blocks: list[Block]) -> str:
    """The text of a page without one: the best container, and what stands beside it with few links.

    These are siblings with a fifth of its points, by all text in them, short ones that are or hold a heading, a
    paragraph or the like, or a sentence, and loose text between them. If any sibling has so many points, the parent
    stands for the article, as does one with no other child; then what is beside that is judged in the same way.
    """
    below: dict[_Node, list[_Node]] = {}
    for n in nodes:
        if n.size and n.parent is not None:
            below.setdefault(n.parent, []).append(n)
    own = {node for node, _, _ in blocks}
    kept, above, at, total = {best}, set(), best, best.points
    while at.parent is not None:
        several, others = False, [n for n in below[at.parent] if n is not at]
        worth = 0.2 * total
        for n in others:
            share = n.points * (1 - n.links / max(1, n.size))
            if share >= worth:
                several = True
                total += share
            if share >= worth or (n.told and _few(n) and not (n.knobs and n.size <= NOTICE and not n.head)):
                kept.add(n)
        at = at.parent
        if at in own:  # with loose text
            above.add(at)
        if (others or at in own) and not several:
            break
    for n in nodes:
        n.flag = n in kept or (n.parent is not None and n.parent.flag)
    return "\n".join(text for node, text, links in blocks if node.flag or (node in above and links < 0.25 * len(text)))


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Adds the main text of every whole page, one output row an input row.

    Null and empty pages, and pages with nothing but furniture, have empty text.
    Pages may be cut off anywhere, repeat, and be very long; keep may hold nulls.
    """
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, max(1, len(pdf)), 512):
                part = pdf.iloc[at : at + 512].reset_index(drop=True)
                out = part[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
                out[text] = [main_text(h) for h in part["h"]]
                yield out

    no_clash(keep, text.lower())
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[html].alias("h"))
    return src.mapInPandas(batches, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{text}` string"]))

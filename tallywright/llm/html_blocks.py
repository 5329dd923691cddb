"""HTML pages as sequences of leaf blocks with their features, and labelled pages to learn from."""

from __future__ import annotations

import html
import random
import re
from collections import Counter

#: Elements of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: without an end tag they run to the end of the page.
RAW_TEXT = {"script", "style", "textarea", "title", "iframe"}
DROPPED = frozenset("audio canvas iframe noscript object script style svg template textarea title video".split())
#: A start tag of these ends an open element of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table td th tr ul".split())

ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "ol", "button", "figure", "blockquote", "dialog", "select", "label", "menu")
#: Words of class and id names by the part they name.
NAMED = {
    "ad": "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager tabs toc skip",
    "head": "header masthead topbar logo branding brand site",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget widgets rail related recommended popular trending more",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay toast privacy warning",
    "comment": "comment comments commentlist reply replies respond disqus discussion reviews",
    "share": "share sharing social follow tags tag author byline meta",
    "form": "form subscribe subscription newsletter signup login search contact",
    "main": "content article post entry story body main text prose blog",
}
_NAMED = {word: part for part, words in NAMED.items() for word in words.split()}
OWN = ("p", "h1", "h2", "h3", "h4", "li", "td", "th", "blockquote", "pre", "div", "dd", "dt", "figcaption", "button", "label", "option", "article", "section", "body", "span")
FEATURES = (
    "bias", *(f"in {a}" for a in ANCESTORS), *(f"named {n}" for n in NAMED), *(f"own {o}" for o in OWN), "own other", "hidden", "header in article",
    "chars < 25", "chars < 80", "chars < 250", "chars >= 250", "links > half", "some link", "sentence end", "copyright", "first", "heading",
)
INDEX = {name: number for number, name in enumerate(FEATURES)}

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_SPECIAL = re.compile("""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attributes: str) -> frozenset[int]:
    """Features that an element hands to all blocks in it, from its attributes."""
    found = set()
    if "=" in attributes:
        for groups in _NAMES.findall(attributes):
            for word in _WORDS.findall("".join(groups)):
                if part := _NAMED.get(word.lower()):
                    found.add(INDEX[f"named {part}"])
    if _HIDDEN.search(attributes):
        found.add(INDEX["hidden"])
    return frozenset(found)


_ANCESTOR_INDEX = {name: INDEX[f"in {name}"] for name in ANCESTORS}


class _Tags:
    """Tags of a page in order, each found in time that adds up to the length of the page.

    A tag ends at the first > outside quotes; without one at the first >. What a
    search that failed has seen is remembered, so that no later one reads it again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.last_special = max(self.last.values())
        self.dead: set[int] = set()  # quotes after which no > stands outside quotes
        self.endless: set[str] = set()  # elements without a further end tag

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes start here, or -1."""
        page, passed, start = self.page, [], at
        while at <= self.last_special:
            k = _SPECIAL.search(page, at).start()
            if page[k] == ">":
                return k
            passed.append(k)
            if k in self.dead or self.last[page[k]] <= k:
                break
            at = page.index(page[k], k + 1) + 1
        self.dead.update(passed)
        return page.find(">", start) if self.last[">"] >= start else -1

    def after(self, at: int):
        """(start, end, is end tag, name, attributes) of the next tag or comment; comments have no name. None at the end."""
        page = self.page
        while match := _START.search(page, at):
            if match[1]:
                end = page.find("-->", match.end())
                return match.start(), len(page) if end < 0 else end + 3, False, "", ""
            end = self._end(match.end()) if match[4] else page.find(">", match.end()) if self.last[">"] >= match.end() else -1
            if end >= 0:
                return match.start(), end + 1, bool(match[3]), (match[4] or "").lower(), page[match.end() : end]
            at = match.end()
        return None

    def past(self, name: str, at: int) -> int:
        """The place after the end tag of a dropped element; its own place, or the page's end for raw text, if there is none."""
        if name not in self.endless:
            if end := re.compile(rf"</{name}\b[^>]*>", re.I).search(self.page, at):
                return end.end()
            self.endless.add(name)
        return len(self.page) if name in RAW_TEXT else at


class _Open:
    """Open elements. Features of all of them are counted, so that a block reads them without a walk."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...], dict[str, list[tuple[int, ...]]]]] = [("", (), {})]
        self.names: Counter[str] = Counter()
        self.features: Counter[int] = Counter()
        self.within: list[Counter[str]] = [Counter()]  # names inside the innermost scope, by scope
        self.scopes: list[str] = [""]
        self.anchors = 0

    @property
    def own(self) -> str:
        return self.stack[-1][0] or "body"

    def push(self, name: str, marks: frozenset[int]) -> None:
        found = set(marks)
        if name in _ANCESTOR_INDEX:
            found.add(_ANCESTOR_INDEX[name])
        if name == "header" and self.names["article"]:
            found.add(INDEX["header in article"])
        self.stack.append((name, tuple(found), {}))
        self.features.update(found)
        self.names[name] += 1
        if name in SCOPES:
            self.within.append(Counter())
            self.scopes.append(name)
        else:
            self.within[-1][name] += 1

    def pop(self) -> str:
        name, found, inline = self.stack.pop()
        self.features.subtract(found)
        for held in inline.values():
            for marks in held:
                self.features.subtract(marks)
        self.anchors -= len(inline.get("a", ()))
        self.names[name] -= 1
        if name in SCOPES:
            self.within.pop()
            self.scopes.pop()
        else:
            self.within[-1][name] -= 1
        return name

    def close_for(self, shut: set[str]) -> None:
        """End the nearest element named in ``shut`` that no scope hides."""
        if any(self.within[-1][name] for name in shut) or self.scopes[-1] in shut:
            while self.pop() not in shut:
                pass

    def end(self, name: str) -> None:
        """An end tag: ends the nearest element of the name, and what is open in it."""
        if self.names[name] if name in SCOPES else self.within[-1][name]:
            while self.pop() != name:
                pass

    def push_inline(self, name: str, marks: frozenset[int]) -> None:
        self.stack[-1][2].setdefault(name, []).append(tuple(marks))
        self.features.update(marks)
        self.anchors += name == "a"

    def end_inline(self, name: str) -> None:
        if held := self.stack[-1][2].get(name):
            self.features.subtract(held.pop())
            self.anchors -= name == "a"


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, features) of each leaf block in page order; blocks without text are left out.

    Character references are decoded and white space becomes one space. Open
    elements end where HTML ends them: a paragraph at the next block, list items
    and cells at the next of their kind, anything at the end of what holds it. The
    time is linear in the page, whatever its nesting and quotes.
    """
    opened, tags = _Open(), _Tags(page)
    out: list[tuple[str, list[int]]] = []
    pieces: list[str] = []
    linked = total = links = 0

    def close() -> None:
        nonlocal linked, total, links
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            own = opened.own
            found = {INDEX["bias"], INDEX.get(f"own {own}", INDEX["own other"]), *(f for f, n in opened.features.items() if n)}
            n = len(text)
            found.add(INDEX["chars < 25" if n < 25 else "chars < 80" if n < 80 else "chars < 250" if n < 250 else "chars >= 250"])
            if links:
                found.add(INDEX["some link"])
                if 2 * linked > total:
                    found.add(INDEX["links > half"])
            if text[-1] in ".!?:;…":
                found.add(INDEX["sentence end"])
            if "©" in text or "opyright" in text:
                found.add(INDEX["copyright"])
            if not out:
                found.add(INDEX["first"])
            if own in ("h1", "h2", "h3", "h4", "h5", "h6"):
                found.add(INDEX["heading"])
            out.append((text, sorted(found)))
        linked = total = links = 0

    def add(text: str) -> None:
        nonlocal linked, total
        if text:
            pieces.append(text)
            total += len(text)
            linked += len(text) if opened.anchors else 0

    at = 0
    while tag := tags.after(at):
        start, end, ends, name, attributes = tag
        add(page[at:start])
        at = end
        if not name:
            continue
        if name in DROPPED:
            if not ends and not (name == "svg" and attributes.endswith("/")):
                at = tags.past(name, at)
        elif name in ("br", "img", "wbr"):
            pieces.append(" " if name == "br" else "")
        elif name in INLINE:
            if ends:
                opened.end_inline(name)
            else:
                links += name == "a"
                opened.push_inline(name, _marks(attributes))
        else:
            close()
            if ends:
                opened.end(name)
            elif name not in VOID:
                opened.close_for(CLOSES.get(name, set()) | {"p"})
                opened.push(name, _marks(attributes))
    add(page[at:])
    close()
    return out


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """(page, label of each block) of n pages made from layouts by rule; 1 marks main text."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwygpbvk"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + "."

    def wrap(kinds: tuple[str, ...], inner: list[tuple[str, int]]) -> list[tuple[str, int]]:
        kind = rng.choice(kinds)
        tag = kind.split()[0]
        return [(f"<{kind}>", -1), *inner, (f"</{tag}>", -1)]

    def leaf(tag: str, text: str, label: int) -> tuple[str, int]:
        shut = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag.split()[0]}>"
        return (f"<{tag}>{text}{shut}", label)

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def boilerplate(part: str) -> list[tuple[str, int]]:
        few = range(rng.randint(2, 7))
        if part == "menu":
            inner = [("<ul>", -1), *(leaf("li", link(words(1, 2)), 0) for _ in few), ("</ul>", -1)]
            return wrap(("nav", "div class='menu'", "div id='navbar'", "nav class='breadcrumb'", "div class='pagination'"), inner)
        if part == "head":
            return wrap(("header", "div class='masthead'", "div id='site-header'"), [leaf(rng.choice(("div", "p", "h1", "h2")), link(words(1, 3)), 0), leaf("p", words(2, 7), 0)])
        if part == "foot":
            return wrap(("footer", "div class='footer'", "div id='colophon'"), [leaf(rng.choice(("p", "div")), f"&copy; {words(1, 2)} &middot; {sentence(2, 12)}", 0) for _ in range(rng.randint(1, 3))])
        if part == "ad":
            return [leaf(rng.choice(("div class='ad'", "div class='advert'", "div class='sponsored'", "aside class='promo'", "div id='banner'")), sentence(4, 25), 0)]
        if part == "side":
            inner = [leaf("h3", words(1, 3), 0), *(leaf("li", link(words(2, 8)), 0) for _ in few)] if rng.random() < 0.6 else [leaf("h3", words(1, 3), 0), leaf("p", sentence(8, 40), 0)]
            return wrap(("aside", "div class='sidebar'", "div class='related'", "section class='widget'", "div id='side'"), inner)
        if part == "notice":
            return wrap(("div class='cookie-notice'", "div id='consent'", "div class='notice'", "dialog", "div role='alert'", "div class='popup'"), [leaf("p", sentence(8, 40), 0), leaf("button", words(1, 2), 0)])
        if part == "form":
            inner = [leaf("label", words(1, 3), 0), leaf("p", sentence(3, 20), 0), ("<input name='x'>", -1), leaf("button", words(1, 2), 0)]
            return wrap(("form", "form class='subscribe'", "div class='newsletter'", "form id='search'"), inner)
        if part == "share":
            return wrap(("div class='share'", "div class='social'", "ul class='tags'"), [leaf("li", link(words(1, 2)), 0) for _ in few])
        inner = [x for _ in few for x in (leaf(rng.choice(("h4", "div")), words(1, 2), 0), leaf("p", " ".join(sentence(4, 18) for _ in range(rng.randint(1, 4))), 0))]
        return wrap(("section class='comments'", "div id='comments'", "ol class='commentlist'", "div class='comment-thread'", "section id='discussion'"), inner)

    def paragraph() -> str:
        text = " ".join(sentence(3, 22) for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))
        if rng.random() < 0.2:
            text = f"{sentence(2, 9)} {link(words(1, 3))} {text}"
        return f"<b>{text}</b>" if rng.random() < 0.05 else text

    def story() -> list[tuple[str, int]]:
        title = [leaf("h1", words(3, 11).capitalize(), 1)]
        if rng.random() < 0.2:
            title = [("<header>", -1), *title, ("</header>", -1)]
        body = title if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                body.append(leaf("p", paragraph() if rng.random() < 0.9 else words(1, 4), 1))
            elif kind < 0.83:
                body.append(leaf(rng.choice(("h2", "h3")), words(1, 6), 1))
            elif kind < 0.91:
                body += [("<ul>", -1), *(leaf("li", words(2, 14), 1) for _ in range(rng.randint(2, 5))), ("</ul>", -1)]
            elif kind < 0.95:
                body.append(leaf("blockquote", sentence(5, 30), 1))
            elif kind < 0.97:
                body += [("<table><tr>", -1), *(leaf("td", words(1, 5), 1) for _ in range(rng.randint(2, 6))), ("</tr></table>", -1)]
            else:
                body.append(leaf("pre", words(3, 30), 1))
        for part in ("ad", "share", "side", "form"):
            if rng.random() < 0.12:
                cut = rng.randint(0, len(body))
                while cut < len(body) and any(label < 0 for _, label in body[:cut][-1:]):
                    cut += 1
                if not any(x in "".join(h for h, _ in body[:cut]) and f"</{x[1:]}" not in "".join(h for h, _ in body[:cut]) for x in ("<ul>", "<table>", "<header>")):
                    body[cut:cut] = boilerplate(part)
        if rng.random() < 0.15:
            body += boilerplate("comment")
        return wrap(("article", "article", "main", "div id='content'", "div class='post-body'", "div class='entry-content'", "section class='story'", "div"), body)

    pages = []
    for _ in range(n):
        parts = [*(boilerplate(p) for p in ("head", "menu", "notice", "ad", "side", "form") if rng.random() < 0.45), story()]
        parts += [boilerplate(p) for p in ("share", "comment", "form", "ad", "side", "notice", "foot") if rng.random() < 0.45]
        flat = [x for part in parts for x in part]
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(h for h, _ in flat) + "</body></html>"
        labels = [label for _, label in flat if label >= 0]
        if len(blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages

"""Reading html elements by selectors: tags, classes, ids, attributes and their operators, ``:first-child``, ``:last-child``,
``:only-child``, ``:nth-child()``, ``:nth-last-child()``, ``:not()``, descent, children, siblings and alternatives. Anything else is an error."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Elements without an end tag. Fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose start ends others that are open, up to an element that holds them. Fixed values.
_CELLS, _ROWS = ("td", "th"), ("tbody", "thead", "tfoot")
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tr": ((*_CELLS, "tr"), (*_ROWS, "table")), **dict.fromkeys(_ROWS, ((*_CELLS, "tr", *_ROWS), ("table",))),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (("p",), ("button", "table", "td", "th", "caption", "object", "div", "section", "article", "li", "dd"))),
}
_NAME = r"(?:[A-Za-z_]|[^\x00-\x7f]|-(?=[A-Za-z_-]))(?:[\w-]|[^\x00-\x7f])*"
_PIECE = re.compile(rf"""\s*(?P<comma>,)\s*|\s*(?P<way>[>+~])\s*|(?P<space>\s+)|(?P<tag>{_NAME}|\*)|[.](?P<class>{_NAME})|\#(?P<id>[\w-]+)|:(?P<pseudo>[\w-]+)(?P<open>\()?
|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<sign>[~|^$*]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\s"'\]]+))\s*(?P<fold>[iIsS])?\s*)?\]""", re.X)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<step>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<add>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)


class Element:
    """A tag with its attributes, contents and parent."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.contents: list[Element | str] = []
        self.elements: list[Element] = []
        self.place = 0  # among its parent's elements

    def below(self) -> Iterator[Element]:
        """All elements inside, in order."""
        waiting = [x for x in reversed(self.contents) if isinstance(x, Element)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [x for x in reversed(node.contents) if isinstance(x, Element)]

    def text(self) -> str:
        """Stripped texts inside, joined by single spaces."""
        out, waiting = [], [self]
        while waiting:
            node = waiting.pop()
            if isinstance(node, str):
                out += [node.strip()] if node.strip() else []
            elif node.tag not in ("script", "style"):
                waiting += reversed(node.contents)
        return " ".join(out)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, within = IMPLIED.get(tag, ((), ()))
        above = self.at
        while above.parent is not None and above.tag not in within:
            if above.tag in ends:
                self.at = above.parent
            above = above.parent
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        node.place = len(self.at.elements)
        self.at.elements.append(node)
        self.at.contents.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.contents.append(data)


def parse(html: str) -> Element:
    """The document of a page; unclosed elements end with their parent or where the start of another one implies their end."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


Test = Callable[[Element], bool]


def _nth(text: str, from_end: bool) -> Test:
    found = _NTH.fullmatch(text)
    if not found:
        raise ValueError(f"not a place among children: {text!r}")
    word, step, sign, add, only = found.group("word", "step", "sign", "add", "only")
    if word:
        a, b = 2, int(word.lower() == "odd")
    elif only:
        a, b = 0, int(only)
    else:
        a, b = int(step + "1" if step in ("", "+", "-") else step), int((sign or "") + (add or "0"))

    def test(node: Element) -> bool:
        siblings = node.parent.elements
        behind = (len(siblings) - node.place if from_end else node.place + 1) - b
        return behind == 0 if a == 0 else behind % a == 0 and behind // a >= 0

    return test


def _attribute(name: str, sign: str | None, value: str, fold: bool) -> Test:
    value, same = (value.lower(), str.lower) if fold else (value, str)
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda x: True, "=": lambda x: x == value, "~=": lambda x: value in x.split() and bool(value), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }
    test = tests[sign]
    return lambda node: name in node.attributes and test(same(node.attributes[name]))


def _closing(selector: str, start: int) -> int:
    """Where the bracket that opened before ``start`` closes."""
    depth, quote = 1, ""
    for at in range(start, len(selector)):
        sign = selector[at]
        if quote or sign in "\"'":
            quote = "" if sign == quote else quote or sign
        else:
            depth += (sign == "(") - (sign == ")")
        if not depth:
            return at
    raise ValueError(f"a bracket stays open in {selector!r}")


@lru_cache(maxsize=1000)
def compiled(selector: str) -> tuple[tuple[tuple[str, tuple[Test, ...]], ...], ...]:
    """Alternatives of a selector, each its compounds from the last to the first, with the way (space, >, + or ~) that leads
    to each from the one in front of it; the first has none."""
    chains, chain, tests, way, at = [], [], [], "", 0
    selector = selector.strip()

    def ended(following: str) -> None:
        nonlocal tests, way
        if not tests:
            raise ValueError(f"nothing stands before {following!r} in {selector!r}")
        chain.append((way, tuple(tests)))
        tests, way = [], following

    while at < len(selector):
        found = _PIECE.match(selector, at)
        if not found:
            raise ValueError(f"unknown syntax at {selector[at:]!r} in {selector!r}")
        at, x = found.end(), found.groupdict()
        if x["comma"]:
            ended("")
            chains, chain = [*chains, tuple(reversed(chain))], []
        elif x["way"] or x["space"]:
            ended(x["way"] or " ")
        elif x["tag"]:
            if tests:
                raise ValueError(f"a tag stands behind other conditions in {selector!r}")
            tests.append((lambda node: True) if x["tag"] == "*" else lambda node, tag=x["tag"].lower(): node.tag == tag)
        elif x["class"]:
            tests.append(_attribute("class", "~=", x["class"], False))
        elif x["id"]:
            tests.append(_attribute("id", "=", x["id"], False))
        elif x["name"]:
            value = next((x[k] for k in ("double", "single", "bare") if x[k] is not None), "")
            tests.append(_attribute(x["name"].lower(), x["sign"], value, (x["fold"] or "").lower() == "i"))
        else:
            end = _closing(selector, at) if x["open"] else at
            inner, name = selector[at:end], x["pseudo"].lower()
            at = end + bool(x["open"])
            if name == "not" and x["open"]:
                tests.append(lambda node, inner=compiled(inner): not fits(node, inner))
            elif name in ("nth-child", "nth-last-child") and x["open"]:
                tests.append(_nth(inner, "last" in name))
            elif name in ("first-child", "last-child", "only-child") and not x["open"]:
                tests += [_nth("1", last) for last in (False, True) if name == "only-child" or last == (name == "last-child")]
            else:
                raise ValueError(f"unknown condition :{name} in {selector!r}")
    ended("")
    return (*chains, tuple(reversed(chain)))


def _leads(node: Element, chain: tuple, k: int) -> bool:
    """Whether compounds k, k + 1, ... of a chain fit ``node`` and what stands around it."""
    way, tests = chain[k]
    if not all(test(node) for test in tests):
        return False
    if k + 1 == len(chain):
        return True
    siblings = node.parent.elements
    if way == "+":
        return node.place > 0 and _leads(siblings[node.place - 1], chain, k + 1)
    if way == "~":
        return any(_leads(x, chain, k + 1) for x in siblings[: node.place])
    above = node.parent
    while above.parent is not None:
        if _leads(above, chain, k + 1):
            return True
        if way == ">":
            return False
        above = above.parent
    return False


def fits(node: Element, chains: tuple) -> bool:
    """Whether one of compiled() alternatives fits an element."""
    return any(_leads(node, chain, 0) for chain in chains)


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements inside ``root`` that the selector fits, in order; what it asks of ancestors may stand outside."""
    chains = compiled(selector)
    return (node for node in root.below() if fits(node, chains))


def select_rows(html: str, selectors: dict[str, str]) -> Iterator[dict[str, str | None]]:
    """Fields of each element that ``container`` selects, if it has a title."""
    for node in select(parse(html), selectors["container"]):
        first = {k: next(select(node, s), None) for k, s in selectors.items() if s and k != "container"}
        text = lambda k, first=first: first[k].text() if first.get(k) is not None else None
        attribute = lambda k, *names, first=first: next((first[k].attributes[n] for n in names if first[k].attributes.get(n)), None) if first.get(k) is not None else None
        if text("title"):
            yield {"title": text("title"), "url": attribute("url", "href"), "date": attribute("date", "datetime") or text("date"), "venue": text("venue"), "price": text("price"), "image": attribute("image", "src", "data-src"), "distance": text("distance")}

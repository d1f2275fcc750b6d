"""HTML as a flat tree of blocks and runs of text, and what a node looks like in numbers.

Nodes stand in page order, so a subtree is a range of them and its sums are differences of running sums. Block elements are
nodes; what stands between two block borders is one leaf, whose inline markup is gone. Nothing here recurses, and each
pattern is linear, so pages may be long, deep or broken.
"""

from __future__ import annotations

import html
import re

import numpy as np

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"?|=\s*+'[^']*+'?|["'=])*+)>?|<[!?/][^>]*+>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style)\s*+=\s*+("[^"]*+|'[^']*+|[^\s>]++)""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.IGNORECASE)

# Element names by their part in a page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTROLS = frozenset("button label select option optgroup fieldset legend".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt figcaption figure footer form head header hgroup hr html li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
).union(HEADINGS, CONTROLS)
#: A start tag of the key ends an open element of the set, unless an element of the second set stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"})}
ENDS |= {"dd": ENDS["dt"], "th": ENDS["td"]}

#: What an element may be by its name, and what the words of its class, id and role may say; a node has a bit for each.
ROLES = {
    "article": (("article", "main"), "content article post entry story body text main blog"),
    "advert": ((), "ad ads advert advertisement sponsor sponsored promo promotion dfp"),
    "menu": (("nav", "menu"), "nav navigation navbar menu breadcrumb breadcrumbs pagination pager topnav"),
    "head": (("header", "head"), "header masthead topbar branding logo"),
    "foot": (("footer",), "footer foot copyright colophon legal contentinfo"),
    "side": (("aside",), "sidebar side widget aside rail complementary"),
    "notice": (("dialog",), "cookie consent notice alert gdpr popup modal overlay banner alertdialog"),
    "comment": ((), "comment comments reply replies respond response discussion disqus thread"),
    "form": (("form", *sorted(CONTROLS)), "form subscribe newsletter signup login search"),
    "other": ((), "share sharing social related recommended recommendations tags trending popular"),
}
BY_NAME = {n: 1 << k for k, (names, _) in enumerate(ROLES.values()) for n in names}
BY_WORD = {w: 1 << len(ROLES) + k for k, (_, words) in enumerate(ROLES.values()) for w in words.split()}
UNSEEN = 1 << 2 * len(ROLES)
N_BITS = 2 * len(ROLES) + 1
SHAPES = {n: k + 1 for k, names in enumerate((("p",), HEADINGS, ("li", "dd", "dt"), ("ul", "ol", "dl"), ("td", "th"), ("table", "tr", "tbody"), ("div", "section"), ("figure", "figcaption", "blockquote", "pre"))) for n in names}
LEAF = 9


class Pages:
    """Nodes of one page after another, in lists by property; a page begins with a node of its own, whose parent is itself."""

    def __init__(self):
        self.parent, self.end, self.shape, self.name, self.own, self.above, self.depth, self.place, self.before = ([] for _ in range(9))
        self.text, self.links, self.roots = [], [], []
        self._said: dict[str, int] = {}

    def _bits(self, attributes: str) -> int:
        if attributes not in self._said:
            bits = UNSEEN if HIDDEN.search(attributes) else 0
            for name, value in ATTRIBUTE.findall(attributes):
                if name.lower() != "style":
                    for word in NAME.findall(value):
                        bits |= BY_WORD.get(word.lower(), 0)
            if len(self._said) > 100_000:
                self._said.clear()
            self._said[attributes] = bits
        return self._said[attributes]

    def _node(self, parent: int, shape: int, name: int, own: int) -> int:
        n = len(self.parent)
        root = parent < 0
        parent = n if root else parent
        before = self._last.get(parent, -1)
        self.parent.append(parent)
        self.end.append(n)
        self.shape.append(shape)
        self.name.append(name)
        self.own.append(own)
        self.above.append(0 if root else self.above[parent] | self.own[parent])
        self.depth.append(0 if root else self.depth[parent] + 1)
        self.place.append(0 if before < 0 else self.place[before] + 1)
        self.before.append(before)
        self.text.append("")
        self.links.append(0)
        if not root:
            self._last[parent] = n
        return n

    def add(self, page: str) -> None:
        """The nodes of a page. End tags without a start are skipped; open elements end with the page."""
        self._last: dict[int, int] = {}
        root = self._node(-1, 0, 0, 0)
        self.roots.append(root)
        stack, names, open_, run, linked, in_link = [root], [""], {}, [], 0, False

        def leaf() -> None:
            nonlocal linked
            if run:
                whole = "".join(run)
                text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
                if text:
                    n = self._node(stack[-1], LEAF, 0, 0)
                    self.text[n], self.links[n] = text, min(linked, len(text))
                run.clear()
                linked = 0

        def close(to: int) -> None:
            """Ends the elements from depth `to` of the stack on."""
            last = len(self.parent) - 1
            while len(stack) > to:
                self.end[stack.pop()] = last
                open_[names.pop()] -= 1

        at, size = 0, len(page)
        while at < size:
            m = TAG.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                run.append(text)
                if in_link:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "a":
                    in_link = False
                elif name in BLOCKS and open_.get(name):
                    leaf()
                    k = len(stack) - 1
                    while names[k] != name:
                        k -= 1
                    close(k)
            elif name in RAW:
                end = re.compile(f"</{name}(?![a-z0-9])[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            elif name in BLOCKS:
                leaf()
                if names[-1] == "p" and name not in CONTROLS:
                    close(len(stack) - 1)
                same, walls = ENDS.get(name, ((), ()))
                if any(open_.get(x) for x in same):
                    k = len(stack) - 1
                    while k > 0 and names[k] not in same and names[k] not in walls:
                        k -= 1
                    if names[k] in same:
                        close(k)
                if name != "hr":
                    own = BY_NAME.get(name, 0) | (self._bits(m[3]) if m[3].strip(" /") else 0)
                    stack.append(self._node(stack[-1], SHAPES.get(name, 0), hash_of(name), own))
                    names.append(name)
                    open_[name] = open_.get(name, 0) + 1
            elif name == "a":
                in_link = True
            elif name == "br":
                run.append(" ")
        leaf()
        last = len(self.parent) - 1
        for n in stack:
            self.end[n] = last


def hash_of(name: str) -> int:
    """A number of an element's name, to tell whether siblings are alike."""
    return int.from_bytes(name.encode()[:6], "little")


def _bin(x: np.ndarray, step: float) -> np.ndarray:
    return np.minimum(np.log2(1 + np.maximum(x, 0)) * step, BINS - 1)


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum((BINS - 1) * x / np.maximum(of, 1), BINS - 1)


BINS = 32
MARKS = ".,;:!?"


def features(pages: Pages) -> np.ndarray:
    """A row of small whole numbers for each node."""
    n = len(pages.parent)
    lists = (pages.parent, pages.end, pages.shape, pages.name, pages.own, pages.above, pages.depth, pages.place, pages.before)
    parent, end, shape, name, own, above, depth, place, before = (np.array(x, np.int64) for x in lists)
    of_leaf = lambda f: np.fromiter(map(f, pages.text), np.int64, n)
    ids = np.arange(n)
    below = lambda x: np.append(0, np.cumsum(x))[end + 1] - np.append(0, np.cumsum(x))[ids]
    size = of_leaf(len)
    leaves, chars, links = below(size > 0), below(size), below(np.array(pages.links, np.int64))
    marks, words = below(of_leaf(lambda t: sum(map(t.count, MARKS)))), below(of_leaf(lambda t: t.count(" ")) + (size > 0))
    blocks = below((shape != LEAF).astype(np.int64))
    root = np.array(pages.roots, np.int64)[np.searchsorted(pages.roots, ids, side="right") - 1]
    start = np.append(0, np.cumsum(size))[ids] - np.append(0, np.cumsum(size))[root]
    n_siblings = np.bincount(parent, minlength=n)[parent]
    _, kind, alike = np.unique(parent * (1 << 20) + (name + 31 * shape) % (1 << 20), return_inverse=True, return_counts=True)
    following = np.full(n, -1)
    following[before[before >= 0]] = ids[before >= 0]
    near = lambda x: np.where(x >= 0, chars[x], 0)
    columns = [
        shape,
        np.minimum(depth, BINS - 1),
        _bin(chars, 1.8),
        _bin(words, 2),
        _share(links, chars),
        _bin(chars / np.maximum(leaves, 1), 2.5),
        _bin(chars / np.maximum(blocks, 1), 2.5),
        _bin(leaves, 3),
        np.minimum(400 * marks / np.maximum(chars, 1), BINS - 1),
        _share(chars, chars[root]),
        _share(start, chars[root]),
        _share(chars[root] - start - chars, chars[root]),
        np.minimum(place, BINS - 1),
        np.minimum(n_siblings - 1 - place, BINS - 1),
        _share(alike[kind], n_siblings),
        _share(chars, chars[parent]),
        _bin(near(before), 1.8),
        _bin(near(following), 1.8),
        _share(links[parent], chars[parent]),
        _bin(chars[parent] / np.maximum(leaves[parent], 1), 2.5),
    ]
    columns += [own >> k & 1 for k in range(N_BITS)] + [above >> k & 1 for k in range(N_BITS)]
    return np.stack([c.astype(np.uint8) for c in columns], axis=1)

"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded from the root down.

Each node gets log-odds of holding main text. Decoding picks the set of nodes of the highest total that contradicts itself
nowhere: a node is kept only if its parent is. That is one pass up, in which a node's worth is its own log-odds and those
of its children that are worth keeping, and one pass down. So a doubtful container around clear text is kept, and nothing
inside a rejected one comes back.

The trees are fitted on TRAIN_PAGES pages at most of TRAIN_CHARS characters at most, the first by a hash. No table says
what the main text is, so labels come from pages that say it themselves, by an article or main element. The same blocks of
text are laid out anew as pages of many other forms, with menus, adverts, side columns, notices, forms and comments in and
around the article, and named or not named as such; there the labels are known. A table without such pages gives the
blocks alone: long ones stand for text, short ones for the rest.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table
from pricelens.llm.dom import BINS, BY_NAME, LEAF, Pages, features

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS, SEED = 200, 1 << 16, 3, 12
TREES, DEPTH, RATE, RIDGE, LEAST_HESSIAN = 50, 4, 0.3, 1.0, 2.0
#: Marks main text in a page that is laid out for training.
MAIN = "\ue000"


class Trees:
    """Boosted regression trees of logistic loss over small whole numbers, complete to DEPTH."""

    def __init__(self):
        self.prior, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        margin, cells = np.full(n, self.prior), x.astype(np.int64) + np.arange(width) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, limit, at = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS), np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, leaves = (1 << level) - 1, 1 << level
                place = ((at - first)[:, None] * (width * BINS) + cells).ravel()
                sums = [np.bincount(place, np.repeat(v, width), leaves * width * BINS).reshape(leaves, width, BINS).cumsum(axis=2) for v in (g, h)]
                all_g, all_h = (s[:, :1, -1:] for s in sums)
                worth = lambda a, b: a * a / (b + RIDGE)
                gain = worth(*sums) + worth(all_g - sums[0], all_h - sums[1]) - worth(all_g, all_h)
                gain[(sums[1] < LEAST_HESSIAN) | (all_h - sums[1] < LEAST_HESSIAN)] = 0
                best = np.round(gain.reshape(leaves, -1), 9).argmax(axis=1)
                good = gain.reshape(leaves, -1)[np.arange(leaves), best] > 1e-6
                own = slice(first, first + leaves)
                feature[own], limit[own] = np.where(good, best // BINS, 0), np.where(good, best % BINS, BINS)
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
            leaf = at - ((1 << DEPTH) - 1)
            value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + RIDGE)
            self.trees.append((feature, limit, value))
            margin += value[leaf]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, limit, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - ((1 << DEPTH) - 1)]
        return out


def kept_nodes(parent: list[int], log_odds: list[float]) -> list[bool]:
    """The nodes of the highest total of which each one's parent is among them too; roots always are."""
    worth = list(log_odds)
    for n in range(len(parent) - 1, -1, -1):
        if worth[n] > 0 and parent[n] != n:
            worth[parent[n]] += worth[n]
    kept: list[bool] = []
    for n, p in enumerate(parent):
        kept.append(p == n or kept[p] and worth[n] > 0)
    return kept


def labelled(pages: Pages, main: list[bool]) -> np.ndarray:
    """1 for nodes that hold main text; main: the same of the leaves."""
    sums = np.append(0, np.cumsum(main))
    return (sums[np.array(pages.end) + 1] > sums[np.arange(len(main))]).astype(float)


_OUT = sum(BY_NAME[n] for n in ("nav", "header", "footer", "aside", "form", "dialog"))


def _said_main(pages: Pages) -> tuple[list[bool], set[int]]:
    """Leaves inside an article or main element, but for menus and the like in it; the pages that have such an element."""
    main, known, root = [], set(), 0
    for n, p in enumerate(pages.parent):
        root = n if p == n else root
        if pages.own[n] & BY_NAME["article"]:
            known.add(root)
        main.append(pages.shape[n] == LEAF and bool(pages.above[n] & BY_NAME["article"]) and not pages.above[n] & _OUT)
    return main, known


class Layouts:
    """Pages in many forms of given texts; main text begins with MAIN."""

    def __init__(self, texts: list[str], others: list[str], seed: int):
        self.rng, self.texts, self.others = random.Random(seed), texts, others

    def _named(self, names: str, words: str, plain: float = 0.2) -> tuple[str, str]:
        """Start and end tag of a container: by name, by class or id, or with neither."""
        rng = self.rng
        tag = rng.choice(names.split())
        if tag in BY_NAME or rng.random() < plain:
            return f"<{tag}{rng.choice(['', ' class=' + chr(34) + self._neutral() + chr(34)])}>", f"</{tag}>"
        word = rng.choice(words.split())
        word = rng.choice([word, f"{word}-{self._neutral()}", f"{self._neutral()}_{word}", f"{word} {self._neutral()}"])
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{word}">', f"</{tag}>"

    def _neutral(self) -> str:
        return self.rng.choice(("box", "row", "col8", "wrap", "inner", "x1", "block", "grid", "module", "left", "group"))

    def _short(self, most: int = 5) -> str:
        words = self.rng.choice(self.others).split()
        a = self.rng.randrange(max(1, len(words) - most))
        return html.escape(" ".join(words[a : a + self.rng.randint(1, most)]))

    def _prose(self) -> str:
        return html.escape(self.rng.choice(self.texts))[: self.rng.choice((60, 150, 400, 2000))]

    def _links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self._short()}</a>' for k in range(n)]
        return self.rng.choice((f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def _within(self, names: str, words: str, inner: str, plain: float = 0.2) -> str:
        a, b = self._named(names, words, plain)
        return f"{a}{inner}{b}"

    def _other(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            return self._within("nav div ul", "menu nav navbar breadcrumbs pagination", self._links(rng.randint(3, 9)), 0.4)
        if kind == "head":
            return self._within("header div", "header masthead topbar branding", f'<a href="/">{self._short()}</a>' + rng.choice(("", f"<p>{self._short(9)}</p>", f"<h1>{self._short()}</h1>", self._links(5))), 0.1)
        if kind == "foot":
            return self._within("footer div", "footer copyright colophon legal", f"&copy; {self._short()} &middot; {self._prose() if rng.random() < 0.5 else self._short(9)}" + rng.choice(("", self._links(4))), 0.1)
        if kind == "side":
            return self._within("aside div", "sidebar widget rail side", f"<h3>{self._short()}</h3>" + rng.choice((f"<p>{self._prose()}</p>", self._links(6), self._links(3))), 0.0)
        if kind == "advert":
            return self._within("div section", "ad ads advert advertisement sponsored promo", rng.choice((self._prose(), f"<p>{self._prose()}</p>", f'<a href="/x">{self._short(9)}</a>', f"<h4>{self._short()}</h4><p>{self._short(9)}</p>")), 0.0)
        if kind == "notice":
            return self._within("div dialog section", "cookie-notice consent alert popup modal overlay banner gdpr", f"<p>{self._prose()}</p>{rng.choice(('', '<button>OK</button>', f'<a href=/p>{self._short()}</a>'))}", 0.0)
        if kind == "form":
            return self._within("form div", "newsletter subscribe signup login search", f"<label>{self._short()}</label><input name=q><p>{self._prose()}</p><button>{self._short(2)}</button>", 0.0)
        if kind == "other":
            return self._within("div section", "related share social tags recommended trending", f"<h3>{self._short()}</h3>{self._links(rng.randint(2, 6))}", 0.2)
        posts = "".join(rng.choice((f'<div class="comment"><b>{self._short(2)}</b><p>{self._prose()}</p></div>', f"<li><p>{self._short(2)}</p><p>{self._prose()}</p></li>", f"<p>{self._prose()}</p>")) for _ in range(rng.randint(1, 5)))
        return self._within("section div ol", "comments replies discussion responses comment-list thread", f"{rng.choice(('', f'<h3>{self._short()}</h3>'))}{posts}", 0.0)

    def page(self, title: str, blocks: list[str]) -> str:
        rng, out = self.rng, []
        lists, line = rng.random() < 0.3, rng.random() < 0.15
        for b in blocks:
            text = MAIN + html.escape(b)
            if lists and rng.random() < 0.3:
                out.append(f"<ul>{''.join(f'<li>{MAIN}{html.escape(x)}</li>' for x in b.split('. '))}</ul>")
            elif line:
                out.append(f"{text}<br><br>")
            else:
                form = rng.choice(("<p>{}</p>",) * 8 + ("<div>{}</div>", "<blockquote>{}</blockquote>", "<p><b>{}<br>", "<h2>{}</h2>", "<figure><img><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>"))
                out.append(form.format(text))
            if rng.random() < 0.12:
                out.append(self._other(rng.choice(("advert", "other", "form", "advert"))))
        head = f"<h1>{MAIN}{html.escape(title)}</h1>" if title else ""
        head = f"<header>{head}</header>" if head and rng.random() < 0.1 else head
        inner = head + "".join(out)
        core = self._within("article article main div div section td", "content article post entry story body text main", inner, 0.3)
        if rng.random() < 0.3:  # comments may stand in the same container as the article
            core = self._within("div main section", "content page main wrap", core + self._other("comment"), 0.5)
        around = [self._other(k) for k in ("menu", "head", "notice", "advert", "side") if rng.random() < 0.45]
        after = [self._other(k) for k in ("comment", "other", "side", "form", "foot", "advert", "menu") if rng.random() < 0.4]
        rng.shuffle(around)
        rng.shuffle(after)
        body = "".join(around) + core + "".join(after)
        for _ in range(rng.randint(0, 3)):
            body = f'<div class="{self._neutral()}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self._short()}</title></head><body>{body}</body></html>"


def fitted(sample: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees | None:
    """Trees from a sample of pages; None if they have no text at all."""
    given = Pages()
    for x in sample:
        given.add(x)
    main, known = _said_main(given)
    long = lambda n: len(given.text[n]) >= 80 and given.links[n] == 0
    leaves = [n for n, t in enumerate(given.text) if t]
    articles: dict[int, list[str]] = {}
    root = 0
    for n, p in enumerate(given.parent):
        root = n if p == n else root
        if given.text[n] and (main[n] if known else long(n)):
            articles.setdefault(root, []).append(given.text[n])
    others = [given.text[n] for n in leaves if not main[n] and (known or not long(n))] or [given.text[n] for n in leaves]
    if not articles:
        return None
    texts = [t for own in articles.values() for t in own]
    maker, made, is_main = Layouts(texts, others, seed), Pages(), []
    for own in articles.values():
        for _ in range(layouts):
            k = maker.rng.randint(1, 8)
            blocks = [maker.rng.choice(texts) for _ in range(k)] if len(own) < 3 else own[1 : 1 + k]
            made.add(maker.page(own[0][:120] if maker.rng.random() < 0.9 else "", blocks))
    for n, t in enumerate(made.text):
        is_main.append(t.startswith(MAIN))
        made.text[n] = t.replace(MAIN, "")
    x, y = features(made), labelled(made, is_main)
    if known:
        own = features(given)
        said = np.isin(np.array(given.roots)[np.searchsorted(given.roots, np.arange(len(main)), side="right") - 1], sorted(known))
        x, y = np.concatenate((x, own[said])), np.concatenate((y, labelled(given, main)[said]))
    return Trees().fit(x, y)


def texts_of(pages: list[str], trees: Trees | None) -> list[str]:
    """The main text of each page; without trees all text."""
    made = Pages()
    for x in pages:
        made.add(x)
    if not pages:
        return []
    log_odds = trees.margins(features(made)).tolist() if trees else [1.0] * len(made.parent)
    out: list[list[str]] = []
    for n, kept in enumerate(kept_nodes(made.parent, log_odds)):
        if made.parent[n] == n:
            out.append([])
        elif kept and made.text[n]:
            out[-1].append(made.text[n])
    return [" ".join(x) for x in out]


def training_pages(source: DataFrame, most: int, chars: int) -> list[str]:
    """The first `most` pages of `chars` characters at most by a hash.

    How many there are gives a bound that a few times as many hashes as wanted lie under, so that tasks send no more to the
    one that picks the first ones.
    """
    short = source.where((F.char_length("html") <= chars) & (F.col("html") != "")).select("html", F.xxhash64(F.lit(SEED), *source.columns).alias("at"))
    share = min(1.0, 4 * most / max(1, short.count()))
    under = short.where(F.col("at") <= int((share - 0.5) * (1 << 64)) if share < 1 else F.lit(True))
    return [r["html"] for r in materialize(under.orderBy("at", "html").limit(most), "training-pages").collect()]


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block is one blank, blocks are joined by one blank. Null and empty
    pages, and pages without main text, have empty text; pages may have any length and depth, and repeated rows give repeated
    results. A table of which no sampled page has text keeps all text there is. An empty table gives no rows. Other columns
    are not read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(markup).cast("string"), F.lit("")).alias("html"))
    trees = spark.sparkContext.broadcast(fitted(training_pages(source, train_pages, train_chars)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts_of(batch.column("html").to_pylist(), trees.value)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in source.drop("html").dtypes)
    return source.mapInArrow(extract, f"{kinds}, text string, n_chars long")


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

"""Collocations, main text and ranked search against brute force."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from pricelens.llm import collocations as C
from pricelens.llm import lexical_search as L
from pricelens.llm.dom import LEAF, Pages, features
from pricelens.llm.main_text import MAIN, Layouts, Trees, _said_main, fitted, kept_nodes, labelled, main_text, texts_of


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_collocations(rows, least, contained, kept):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), p, count[p[:k]], count[p[k:]]))
        for rank, (score, a, _, p, l, r) in enumerate(sorted(found)[:kept], 1):
            out.append((lang, rank, " ".join(p), -a, l, r, n[lang], -score))
    return sorted(out)


def in_order(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("bits", [1 << 27, 64])  # even full bitmaps give the same rows
def test_collocations(spark, docs, bits):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    rows += [(None, "one Two three four, one two three four five. a\tb  a b! é a b"), ("und", "one two three four\none two"), ("", "x y"), ("de", None)] * 3
    own = spark.createDataFrame([(*r, 1, "c", "c") for r in rows], "lang string, text string, gram int, slot string, n string").repartition(3)
    for least, contained, kept in ((3, 80, 2000), (6, 50, 5)):
        got = in_order(C.collocations(own, least=least, contained=contained, kept=kept, bits=bits))
        assert got == brute_collocations(rows, least, contained, kept) and got


def test_collocations_in_small_pieces(spark, monkeypatch):
    """Counts are the same when tasks cut texts, flush and number their words anew all the time."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "d.", "e", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(400)))) for _ in range(40)]
    texts = [t.encode() for _, t in rows]

    def counts(flushes):
        total = defaultdict(Counter)
        for k in range(1, 5):
            own, before = C.Pass(k, 4, 64, C.Filters(*[C.np.full(4096, 255, C.np.uint8)] * 2)), C.np.zeros(0, C.np.int64)
            for ids in C.numbered(texts, own.words):
                both = C.np.concatenate((before, ids))
                own.add("en", both, len(before))
                before = both[-3:]
                for b in own.flush() if flushes else ():
                    total[k].update({g: n for g, n in zip(b["gram"].to_pylist(), b["n"].to_pylist()) if g} if b["gram"][0].is_valid else {})
            for b in own.flush():
                for g, n in zip(b["gram"].to_pylist(), b["n"].to_pylist()):
                    if g:
                        total[k][g] += n
        return total

    whole = counts(False)
    monkeypatch.setattr(C, "SLICE", 50)
    assert counts(False) == whole and counts(True) == whole
    want = brute_collocations(rows, 1, 1000, 10**6)
    assert {p.encode(): a for _, _, p, a, *_ in want} == {g: n for k in (2, 3, 4) for g, n in whole[k].items()}


def test_collocations_of_more_words_than_numbers(monkeypatch):
    """A task whose word numbers run out amid a text numbers anew from the next slice on, and counts the same."""
    rng = random.Random(5)
    rows = [(lang, " ".join(rng.choice(["a", "b", "c.", f"{lang}{rng.randrange(300)}"]) for _ in range(rng.randrange(400)))) for lang in ("en", "de") * 20]
    batches = [C.pa.RecordBatch.from_pylist([{"lang": lang, "text": text} for lang, text in rows[i : i + 10]]) for i in (0, 10, 20, 30)]
    monkeypatch.setattr(C, "SLICE", 50)
    monkeypatch.setattr(C, "WORD_BITS", 7)  # 64 words

    class Task:
        def mapInArrow(self, count, schema):
            return count(iter(batches))

    class Full:
        value = C.Filters(*[C.np.full(4096, 255, C.np.uint8)] * 2)

    want = {(lang, p.encode()): a for lang, _, p, a, *_ in brute_collocations(rows, 1, 1000, 10**6)}
    for k in range(1, 5):
        got, words = Counter(), Counter()
        for b in C.counted(Task(), k, 4, 64, Full()):
            for r in b.to_pylist():
                if r["gram"] is not None:
                    got[r["lang"], r["gram"]] += r["n"]
                elif r["slot"] is None:
                    words[r["lang"]] += r["n"]
        if k == 1:
            assert got == Counter((lang, w.encode()) for lang, t in rows for w in t.replace(".", "").split()) and words.total() == got.total()
        else:
            assert got == {p: a for p, a in want.items() if len(p[1].split()) == k}


def test_collocations_of_nothing(docs, nothing):
    assert C.collocations(nothing).count() == 0
    assert C.collocations(docs.where("text IS NULL OR text = ''")).count() == 0


def brute_search(items, docs, most):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    N, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 25 + 75 * n * N // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:most], 1)]
    return Counter(out)


def test_search(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "alpha Beta beta gamma"), (2, None), (3, ""), (None, "two words x1"), (1, "alpha Beta beta gamma"), (4, "no such thing"), (5, "日本 don't changed1 changed1"), (6, "." * 99)]
    own = spark.createDataFrame([(*x, "c", 1, "c") for x in items], "item_id long, text string, row string, term int, block string")
    want = brute_search(items, rows, 10)
    for options in ({}, {"block_terms": 3, "block_docs": 4}):
        got = L.search(own, docs.withColumns({"n": docs["h1"], "times": docs["h1"], "term": docs["h1"]}), **options)
        assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want


def test_search_of_nothing(spark, docs, nothing):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert L.search(items, nothing).count() == 0
    assert L.search(items, docs.where("text = ''")).count() == 0
    none = L.search(items.where("false"), docs)
    assert none.count() == 0 and none.dtypes == L.search(items, docs).dtypes


def test_terms_of_long_texts(monkeypatch):
    text = "Ab1 é_x--" * 1000 + "y" * 500
    whole = L.counted(text.encode())
    monkeypatch.setattr(L, "SLICE", 7)
    assert L.counted(text.encode()) == whole == Counter({b"ab1": 1000, "é".encode(): 1000, b"x": 1000, b"y" * 500: 1})


SF = "/root/testdata/sf0.01"
BREAKS = re.compile("</?(?:p|h1|br)>")


def inside_article(page):
    own = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub("</?b>", "", BREAKS.sub(" ", own))).split())


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    given = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    got = main_text(pages).collect()
    assert len(got) == len(given)
    assert all((r["url"], r["text"], r["n_chars"]) == (given[r["page_id"]][0], t := inside_article(given[r["page_id"]][1]), len(t)) for r in got)


@pytest.fixture(scope="module")
def trained(spark):
    rows = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    return fitted(rows[:100]), rows


def test_main_text_of_other_layouts(trained):
    """Pages laid out from texts that training hasn't seen, with and without telling names."""
    trees, rows = trained
    given = Pages()
    for x in rows[150:]:
        given.add(x)
    main, _ = _said_main(given)
    texts, others = ([t for t, m in zip(given.text, main) if t and m is want] for want in (True, False))
    maker, made = Layouts(texts, others, 5), Pages()
    for k in range(150):
        made.add(maker.page(texts[k], texts[k : k + 6]))
    is_main = [t.startswith(MAIN) for t in made.text]
    made.text = [t.replace(MAIN, "") for t in made.text]
    kept = kept_nodes(made.parent, trees.margins(features(made)).tolist())
    hit = sum(a and b for a, b, t in zip(is_main, kept, made.text) if t)
    assert hit >= 0.93 * sum(is_main) and hit >= 0.93 * sum(k for k, t in zip(kept, made.text) if t)


PROSE = "The history of the river valley is long, and many people have written about it. In the early years, traders came by boat; later the railway arrived and changed everything."
PAGE = f"""<html><head><title>T</title></head><body class="home"><header class="site-header"><a href="/">My Site</a><nav><a href=/a>Home</a> <a href=/b>About</a></nav></header>
<div id="cookie-banner">We use cookies to improve your experience. <button>Accept</button></div>
<div class="container"><div class="post-content"><h1>River Valley</h1><p>{PROSE}</p><p>{PROSE} More&nbsp;text &amp;
 <a href=x>a link</a> in it.</p><div class="advertisement">Buy the best boats now, cheap and fast, only today!</div></div>
<aside class="sidebar"><h3>Recent posts</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></aside><form action=/s><label>Subscribe</label><input><button>Go</button></form>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Great article, thanks for writing it. I visited the valley in 1999 and it was lovely.</p></div></section></div>
<footer><p>Copyright 2024 My Site. All rights reserved.</p></footer><script>var a="<p>no</p>";</script></body></html>"""


def test_main_text_among_everything_else(trained):
    assert texts_of([PAGE, "", "plain text only, no tags at all here", f"<article><p>{PROSE}</p><section class=comments><p>{PROSE}</p></section>"], trained[0]) == [
        f"River Valley {PROSE} {PROSE} More text & a link in it.", "", "plain text only, no tags at all here", PROSE,
    ]


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<div>" * 20000 + PROSE), (4, "u", f"<p>{PROSE}</p>" * 3000), (5, "u", "<a href='" * 5000), (6, "u", "<!-- open")]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, text int, n_chars string").repartition(2)
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["url"]): r for r in got.collect()}
    assert got.count() == len(rows) and found[None, None]["text"] == "" and found[2, "u"]["n_chars"] == 0
    assert main_text(pages.where("false")).count() == 0
    assert main_text(pages.where("page_id IS NULL OR page_id = 2")).select("text").distinct().collect() == [("",)]


def test_nodes():
    """Broken nesting, implied ends, raw text; leaves in page order without markup."""
    made = Pages()
    made.add("<ul><li>a<li>b <b>c</b></ul></div><p>d<p>e<script><p>x</p></script>f<table><tr><td>g<td>h<tr><td>i</table><TITLE>n</TITLE>&lt;j&gt; k<br>l<div hidden class='adBanner x'>m")
    assert [t for t in made.text if t] == ["a", "b c", "d", "ef", "g", "h", "i", "<j> k l", "m"]
    assert all(p <= n <= e for n, (p, e) in enumerate(zip(made.parent, made.end)))
    x = features(made)
    assert len(x) == len(made.text) and made.shape[made.text.index("m")] == LEAF and made.above[made.text.index("m")]
    assert labelled(made, [t == "m" for t in made.text])[0] == 1


def test_decoding_is_the_best_set_without_contradiction():
    rng = random.Random(1)
    for _ in range(50):
        n = 9
        parent = [0] + [rng.randrange(k) for k in range(1, n)]
        odds = [0.0] + [rng.uniform(-2, 2) for _ in range(n - 1)]
        sets = [s for s in range(1 << n) if s & 1 and all(not s >> k & 1 or s >> parent[k] & 1 for k in range(n))]
        best = max(sum(odds[k] for k in range(n) if s >> k & 1) for s in sets)
        kept = kept_nodes(parent, odds)
        assert all(not kept[k] or kept[parent[k]] for k in range(n))
        assert abs(sum(o for o, k in zip(odds, kept) if k) - best) < 1e-9


def test_trees_learn_an_interaction():
    rng = C.np.random.default_rng(0)
    x = rng.integers(0, 32, (3000, 5)).astype("uint8")
    y = ((x[:, 1] > 15) ^ (x[:, 3] > 9)).astype(float)
    assert ((Trees().fit(x[:2000], y[:2000]).margins(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95

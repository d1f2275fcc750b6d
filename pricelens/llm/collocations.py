"""Phrase collocations by hashed counting (PCY/DHP) with Apriori pruning.

A pass per phrase length, each one scan of the texts. The pass of length k counts exactly the k-grams that may be frequent,
and counts in hash buckets the (k+1)-grams made of two of those. A k-gram may be frequent if the bucket that the pass
before counted it in is, and if its first and its last k-1 words are frequent phrases. Both facts reach the tasks as
bitmaps of BITS bits: of the buckets with at least `least` occurrences, and of the buckets of frequent (k-1)-grams. A bit
too many lets a k-gram be counted that turns out rare; no bit is ever missing, so the counts are exact at any size. BITS is
fixed, and so is the memory of a task. Beyond some 20 rare phrases a bucket the first bitmap fills up and only the frequent
parts prune; more BITS help then.

A task counts by numbers of its own for words, then sends each phrase once with its count, so a frequent phrase is as many
rows as there are tasks. What is left after the last pass are frequent phrases only. Their parts are frequent too, so scores
come from joins of that table with itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table
from pricelens.llm.exact_bloom import set_slots

LONGEST, LEAST, CONTAINED, KEPT, BITS = 4, 30, 80, 2000, 1 << 27
SLICE, HELD, ROWS, WORD_BITS, RANK_GROUPS = 1 << 20, 1 << 21, 1 << 16, 21, 64
#: A-Z lower-cased, marks and line ends that cut pieces as a full stop, the tab as a blank.
CUT = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: The number of the piece's end among words.
END = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Filters:
    """The two bitmaps of a pass; sent to tasks in packed form, for most bits of a small input are zero."""

    def __init__(self, parts: np.ndarray, buckets: np.ndarray):
        self.parts, self.buckets = parts, buckets

    def __getstate__(self) -> list[bytes]:
        return [zlib.compress(x.tobytes(), 1) for x in (self.parts, self.buckets)]

    def __setstate__(self, packed: list[bytes]) -> None:
        self.parts, self.buckets = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)


class Words(dict):
    """Numbers of words as they come, 0 for the end of a piece."""

    def __init__(self):
        super().__init__()
        self.restart()

    def restart(self) -> None:
        """Number anew from 1, in place: whoever numbers a text with these goes on with the new numbers. `texts` is another list then."""
        self.clear()
        self[b"."] = END
        self.texts, self.digests, self.new = [b"."], np.zeros(1, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.texts)
        self.texts.append(word)
        self.new.append(xxhash.xxh64_intdigest(word))
        return n

    def hashes(self) -> np.ndarray:
        if self.new:
            self.digests = np.concatenate((self.digests, np.array(self.new, np.uint64)))
            self.new = []
        return self.digests


def numbered(texts: list[bytes], words: Words) -> Iterator[np.ndarray]:
    """The word numbers of texts in order, a piece's end after each text, in arrays of about SLICE bytes of text."""
    plain, at = b".".join(texts).translate(CUT) + b".", 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= SLICE else plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        own = plain[at:end].replace(b".", b" . ").split()
        yield np.fromiter(map(words.__getitem__, own), np.int64, len(own))
        at = end


def _all_of(x: np.ndarray, k: int) -> np.ndarray:
    """Where k values in a row are true."""
    out = x[: max(0, len(x) - k + 1)].copy()
    for j in range(1, k):
        out &= x[j : j + len(out)]
    return out


class Pass:
    """Counts of k-grams and buckets of (k+1)-grams in one task."""

    def __init__(self, k: int, longest: int, bits: int, filters: Filters | None):
        self.k, self.longest, self.bits, self.filters = k, longest, bits, filters
        self.words, self.totals, self.held = Words(), defaultdict(int), 0
        self.grams: dict[str, list] = defaultdict(list)
        self.slots: list[np.ndarray] = []

    def _marked(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.bits - 1)
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def _hashed(self, columns: list[np.ndarray], lang: str) -> np.ndarray:
        """The hash of phrases given by columns of word hashes."""
        h = _mixed(columns[0] + np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1)))
        for c in columns[1:]:
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + c)
        return h

    def add(self, lang: str, ids: np.ndarray, fresh: int) -> None:
        """ids: words in a row, of which those from `fresh` on are new; only phrases that end there count."""
        k, word = self.k, self.words.hashes()[ids]
        columns = lambda n: [word[j : len(ids) - n + 1 + j] for j in range(n)]
        good = _all_of(ids != END, k)
        if k > 1 and len(good):
            within = self._marked(self.filters.parts, self._hashed(columns(k - 1), lang))
            good &= within[: len(good)] & within[1 : len(good) + 1] & self._marked(self.filters.buckets, self._hashed(columns(k), lang))
        at = np.flatnonzero(good[max(0, fresh - k + 1) :]) + max(0, fresh - k + 1)
        first = ids[at]
        for j in range(1, min(k, 3)):
            first = (first << WORD_BITS) | ids[at + j]
        self.grams[lang].append((first, ids[at + 3] if k == 4 else None))
        if k == 1:
            self.totals[lang] += len(at)
        if k < self.longest:
            longer = np.flatnonzero(_all_of(good, 2)[max(0, fresh - k) :]) + max(0, fresh - k)
            self.slots.append((self._hashed([word[longer + j] for j in range(k + 1)], lang) & np.uint64(self.bits - 1)).astype(np.int64))
            self.held += len(longer)
        self.held += len(at)

    def full(self) -> bool:
        return self.held > HELD or len(self.words) > 1 << (WORD_BITS - 3)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What was counted since the last time: (lang, gram, slot, n), of buckets without lang and gram."""
        word = self.words.hashes()
        for lang, own in self.grams.items():
            first = np.concatenate([x for x, _ in own])
            if self.k == 4:
                heads, first = np.unique(first, return_inverse=True)
                first = (first << WORD_BITS) | np.concatenate([x for _, x in own])
            codes, n = np.unique(first, return_counts=True)
            low = (1 << WORD_BITS) - 1
            if self.k == 4:
                columns = [heads[codes >> WORD_BITS] >> (WORD_BITS * j) & low for j in (2, 1, 0)] + [codes & low]
            else:
                columns = [codes >> (WORD_BITS * j) & low for j in reversed(range(self.k))]
            slots = (self._hashed([word[c] for c in columns], lang) & np.uint64(self.bits - 1)).astype(np.int64)
            texts = self.words.texts
            for a in range(0, len(codes), ROWS):
                grams = [b" ".join([texts[i] for i in x]) for x in zip(*[c[a : a + ROWS].tolist() for c in columns])]
                yield self._rows(lang, grams, slots[a : a + ROWS] + 1, n[a : a + ROWS])
        if self.slots:
            slots, n = np.unique(np.concatenate(self.slots), return_counts=True)
            for a in range(0, len(slots), ROWS):
                yield self._rows(None, None, slots[a : a + ROWS] + 1, n[a : a + ROWS])
        self.grams.clear()
        self.slots, self.held = [], 0
        if len(self.words) > 1 << (WORD_BITS - 3):
            self.words.restart()

    def end(self) -> Iterator[pa.RecordBatch]:
        for lang, n in self.totals.items():
            yield self._rows(lang, None, None, np.array([n]))

    def _rows(self, lang, grams, slots, n) -> pa.RecordBatch:
        size = len(n)
        columns = [
            pa.array([lang] * size, pa.string()) if lang is not None else pa.nulls(size, pa.string()),
            pa.array(grams, pa.binary()) if grams is not None else pa.nulls(size, pa.binary()),
            pa.array(slots, pa.int64()) if slots is not None else pa.nulls(size, pa.int64()),
            pa.array(n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "slot", "n"])


def counted(texts: DataFrame, k: int, longest: int, bits: int, filters) -> DataFrame:
    """texts (lang, text): what tasks count in the pass of length k; filters: broadcast bitmaps of parts and of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pass(k, longest, bits, filters and filters.value)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                by_lang[lang].append(text)
            for lang, found in by_lang.items():
                before = np.zeros(0, np.int64)
                for ids in numbered(found, own.words):
                    both = np.concatenate((before, ids))
                    own.add(lang, both, len(before))
                    before = both[-(longest - 1) :] if longest > 1 else both[:0]
                    if own.full():
                        known = own.words.texts
                        yield from own.flush()
                        if own.words.texts is not known:  # the words that the next phrases begin with get new numbers
                            before = np.array([own.words[known[i]] for i in before.tolist()], np.int64)
        yield from own.flush()
        yield from own.end()

    return texts.mapInArrow(count, "lang string, gram binary, slot long, n long")


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The slots (from 1) as bits on the driver: bits / 8 bytes, in rows of 4 kB."""
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in set_slots(slots, F.col("slot")).collect():
        own = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        out[(r["bucket"] - 1) * 4096 :][: len(own)] = own[: max(bits // 8, 4096)]
    return out


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """texts (lang, text): phrases of up to `longest` words found `least` times or more, (lang, phrase, words, f), and (lang, n)."""
    spark, filters, found, totals = texts.sparkSession, None, None, None
    for k in range(1, longest + 1):
        sums = counted(texts, k, longest, bits, filters).groupBy("lang", "gram", "slot").agg(F.sum("n").alias("n"))
        own = materialize(sums.where((F.col("n") >= least) | F.col("slot").isNull()), f"grams-{k}")
        grams, buckets = own.where("gram IS NOT NULL"), own.where("gram IS NULL AND slot IS NOT NULL")
        if k == 1:
            totals = own.where("slot IS NULL").select("lang", "n")
        if filters:
            filters.destroy()  # the pass is written
        if k < longest:
            filters = spark.sparkContext.broadcast(Filters(bitmap(grams, bits), bitmap(buckets, bits)))
        rows = grams.select("lang", F.col("gram").cast("string").alias("phrase"), F.lit(k).alias("words"), F.col("n").alias("f"))
        found = rows if found is None else found.unionByName(rows)
    return found, totals


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, kept: int = KEPT, bits: int = BITS, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Each lang's first `kept` phrases of 2 to `longest` (4 at most) words by score: lang, rank, phrase, a, l, r, n, score.

    A null lang is `und`; null and empty texts have no words, and repeated rows count each time. a, l and r are the counts of
    the phrase and of its parts at its lowest-scoring cut, n the lang's words. A phrase goes if a longer candidate that holds
    it has `contained` percent of its count or more. An empty table gives no rows. Other columns are not read.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest must be 2 to 4")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("text <> ''")
    found, totals = frequent_phrases(texts, least, longest, bits)
    found = found.withColumn("w", F.split("phrase", " "))
    longer = found.where("words > 1")
    size, at = F.col("words"), F.col("at")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", _joined(F.col("w"), F.lit(1), at).alias("left"), _joined(F.col("w"), at + 1, size - at).alias("right"))
    part = lambda c, f: found.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = both.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("c"))
    inner = longer.where("words > 2").select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("n"))
    inner = inner.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at")).select("lang", _joined(F.col("w"), at, F.col("n")).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = cut.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < contained * F.col("a"), F.lit(True)))
    # two steps: a lang's phrases are ranked in groups first, so that no task holds all of them
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = own.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).withColumn("rank", place("lang", "group")).where(F.col("rank") <= kept)
    best = near.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= kept)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, {k} AS words FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM pieces)" for k in range(1, 5))
ORACLE = rf"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM cut),
f AS (SELECT lang, phrase, words, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""

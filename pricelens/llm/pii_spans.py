"""Personal data by weak supervision.

Besides the four base kinds, secrets and names are looked for. Labelers vote on candidate spans: strict patterns, checks
(Luhn, octets, digit counts, entropy), gazetteers (domain endings, card prefixes, dialling codes, token formats, given
names), cue words around the span, for or against, and shapes. Spark counts how often each combination of votes and
features (all but the strict pattern's own vote) occurs; there are at most 6 * 3^5 * 2^7 of them at any input size.
Expectation-maximisation over these counts estimates each labeler's reliability per kind and each combination's
probability, from prior reliabilities that weigh PRIOR_WEIGHT of the data. A logistic model per kind on the spans' features
is trained on those probabilities and decides on the candidates: spans that strict patterns found always stay, the model
adds others that overlap none of them. A run of digits may hold several numbers, so its parts are candidates beside the
whole; of accepted candidates that overlap, the one that the model scores highest stays, then the longer, then the earlier.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")
LABELERS = ("strict", "check", "gazetteer", "context", "shape")
N_FLAGS = 7
#: P(vote -1, 0, 1 | not personal, personal) by labeler, before any data.
PRIOR_RATES = (
    ((0.00, 0.999, 0.001), (0.00, 0.60, 0.40)),
    ((0.60, 0.30, 0.10), (0.001, 0.199, 0.80)),
    ((0.05, 0.80, 0.15), (0.01, 0.49, 0.50)),
    ((0.35, 0.63, 0.02), (0.001, 0.399, 0.60)),
    ((0.50, 0.30, 0.20), (0.10, 0.20, 0.70)),
)
PRIOR_WEIGHT = 0.5
#: Rates of no more than this are anchors, which the data don't move: else EM takes any two clusters for the classes.
ANCHOR = 0.002

# The strict patterns. Each starts where no match could start earlier in the same run of characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and cues, as plain words.
ENDINGS = {"com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us"}
CARD_PREFIXES = ("4", "34", "36", "37", "51", "52", "53", "54", "55", "6011", "65", "2221", "2720")
DIAL_CODES = ("1", "33", "34", "44", "49")
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Andrew Emily Peter Anna Hans Ursula Klaus Petra "
    "Jürgen Sabine Wolfgang Monika Pierre Marie Jean Françoise Michel Nathalie Luc Claire José María Carlos Carmen Juan Ana Luis Lucía".split()
)
NOT_NAMES = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday "
    "Saturday Sunday Street Avenue Road Lane Square Park River Lake Mount Bridge Station Airport Hotel University College Hospital "
    "Church Island County City Company Customer Sir Madam Team The And Of".split()
)
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|correo|courriel",
    "ip": r"ip|host|server|address|addr|login",
    "card": r"card|visa|credit|account|konto|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|telefon|appel|dial|whatsapp",
    "secret": r"token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth|passwort|contraseña",
    "name": r"mrs?|ms|dr|prof|herr|frau|monsieur|madame|señora?|name|named|patient|employee|signed|attn|dear|heiße|appelle|llamo",
}
AGAINST = {
    "email": r"(?!)",
    "ip": r"version|release|firmware|section|chapter",
    "card": r"order|invoice|isbn|serial|tracking|barcode|part|parcel|ticket",
    "phone": r"order|invoice|isbn|serial|tracking|barcode|part|parcel|ticket|version|score",
    "secret": r"commit|sha-?1|sha-?256|md5|digest|checksum|hash|uuid|revision|rev|etag|integrity|build",
    "name": r"saint|san|lake|mount|hotel|near|visit|from|to|at",
}
CUE = {k: re.compile(rf"(?i)(?<![^\W_])(?:(?P<for>{CUES[k]})|(?:{AGAINST[k]}))(?![^\W_])") for k in KINDS}
AFTER_PLACE = re.compile(r" (?:Street|Avenue|Road|Lane|Square|Park|River|Lake|Bridge|Station|Airport|Hotel|University|College|Hospital|Church|Island|County|City)\b")
NATIONAL = re.compile(r"\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}")
TOKEN_FORMAT = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{10,}")

# Candidates beyond the strict patterns.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(rf"(?i)(?<![^\W_])(?:{CUES['secret']})[\"']?\s?(?:[:=]|is)\s?[\"']?([^\s\"',;<>]{{6,}})")
NAME_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
NAME = re.compile(rf"(?<!\w){NAME_WORD}(?: {NAME_WORD}){{1,2}}(?!\w)")
WRITTEN_DOT = r"(?: ?(?:\[dot\]|\(dot\)) ?| dot )"
WRITTEN_AT = re.compile(
    rf" ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:(?:{WRITTEN_DOT}|\.)[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?:{WRITTEN_DOT}[A-Za-z0-9-]+)+"
)
DIGIT_RUN = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().-]*(?![0-9A-Za-z])")
GROUP = re.compile(r"[+(]?[0-9]+")
#: What may stand between two groups of one number; repeated separators end a number.
INSIDE = re.compile(r"\)?[ .-]?")
MOST_DIGITS = 19


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _octet(x: str) -> bool:
    """At most 255, whatever zeros lead."""
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, by the @ signs: a local part reaches back to the run's start or the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the strict patterns that pass their checks, by start, then kind."""
    found = [("email", *x) for x in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates beyond the strict patterns: written-out addresses, dotted quads of any size, runs of digits, mixed
    letters and digits, values of secrets, and capitalised words that begin with a given name or follow a cue."""
    for m in TOKEN.finditer(text):
        if not m[0].isalpha() and any(c.isalpha() for c in m[0]) and any(c.isdigit() for c in m[0]):
            yield "secret", *m.span()
    for m in ASSIGNED.finditer(text):
        value = m[1].rstrip(".:!?)]}")
        if value:
            yield "secret", m.start(1), m.start(1) + len(value)
    for m in NAME.finditer(text):
        if m[0].split(" ", 1)[0] in GIVEN_NAMES or context(text, "name", m.start()) > 0:
            yield "name", *m.span()
    for m in WRITTEN_AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
    for m in IP.finditer(text):
        yield "ip", *m.span()
    for m in DIGIT_RUN.finditer(text):
        run = m[0].rstrip(" ().-")
        kind = number_kind(run, len(_digits(run)))
        if kind:
            yield kind, m.start(), m.start() + len(run)
        for kind, start, end in run_parts(run):
            yield kind, m.start() + start, m.start() + end


def number_kind(run: str, n: int) -> str | None:
    """What a run of n digits may be."""
    if 13 <= n <= MOST_DIGITS and "(" not in run and "." not in run:
        return "card"
    return "phone" if 7 <= n <= 15 and (not run.isdigit() or n >= 10) else None


def run_parts(run: str) -> Iterator[tuple[str, int, int]]:
    """Parts of a run that may be numbers: joins of neighbouring groups of digits. A group begins at most 19, as each join holds 19 digits at most."""
    groups = [(m.start(), m.end()) for m in GROUP.finditer(run)]
    for k, (start, end) in enumerate(groups):
        n, before = 0, end
        for first, end in groups[k : k + MOST_DIGITS]:
            n += end - first - (run[first] in "+(")
            if n > MOST_DIGITS or before < first and not INSIDE.fullmatch(run, before, first):
                break
            before, part = end, run[start:end]
            kind = number_kind(part, n) if part.count("(") == part.count(")") else None
            if kind:
                yield kind, start, end


def context(text: str, kind: str, start: int) -> int:
    """1 or -1 by the last cue in the 24 characters before a span, 0 without one."""
    last = None
    for last in CUE[kind].finditer(text, max(0, start - 24), start):
        pass
    return 0 if last is None else 1 if last["for"] else -1


def bits(span: str) -> float:
    """Entropy in bits per character."""
    n = len(span)
    return -sum(k / n * log2(k / n) for k in Counter(span).values())


def judged(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[list[int], list[int]]:
    """The labelers' votes (1, -1, or 0 for none) and the features of a span."""
    span, digits = text[start:end], _digits(text[start:end])
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    tidy, cue, known = not any(c.isalnum() for c in around), context(text, kind, start), 0
    if kind == "email":
        known = int(re.split(r"[. ]", span)[-1].lower().strip("[]()") in ENDINGS)
        check, shape = (-1 if ".." in span else int("@" in span)), int("@" in span or "[" in span or "(" in span)
    elif kind == "ip":
        octets = span.split(".")
        check = 1 if all(map(_octet, octets)) else -1
        known, shape = int(not any(len(x) > 1 and x[0] == "0" for x in octets)), 1 if 7 <= len(span) <= 15 else -1
    elif kind == "card":
        check, known, shape = (1 if luhn(digits) else -1), int(digits.startswith(CARD_PREFIXES)), 1 if len(digits) in (15, 16) else -1
    elif kind == "phone":
        check = 1 if 10 <= len(digits) <= 15 else -1
        known = int(span[0] == "+" and digits.startswith(DIAL_CODES) or NATIONAL.fullmatch(span) is not None)
        shape = 1 if span[0] in "+(" or known else -1
    elif kind == "secret":
        mixed = any(map(str.isdigit, span)) and any(map(str.isalpha, span))
        check = 1 if len(span) >= 16 and bits(span) >= 3 else 0 if mixed else -1
        known, shape = int(TOKEN_FORMAT.fullmatch(span) is not None), 1 if mixed and len(span) <= 512 and span.count("/") + span.count("-") <= 4 else -1
    else:
        words = span.split(" ")
        check = -1 if NOT_NAMES.intersection(words) or AFTER_PLACE.match(text, end) else 1
        known, shape = int(words[0] in GIVEN_NAMES), 1 if all(len(x) < 16 for x in words) else -1
    votes = [1 if strict else 0, check, known, cue, 1 if shape > 0 and tidy else min(shape, 0) if tidy else -1]
    flags = [check > 0, known, cue > 0, cue < 0, shape > 0, tidy, len(set(digits)) > 3 or kind not in ("card", "phone")]
    return votes, [int(x) for x in flags]


def _code(kind: str, votes: list[int], flags: list[int]) -> int:
    code = KINDS.index(kind)
    for v in votes:
        code = 3 * code + v + 1
    for f in flags:
        code = 2 * code + f
    return code


def _decoded(code: int) -> tuple[int, list[int], list[int]]:
    flags, votes = [], []
    for _ in range(N_FLAGS):
        code, f = divmod(code, 2)
        flags.append(f)
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], flags[::-1]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its spans as flat lists: kind, start, end, code, strict."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            own = base_spans(text)
            flat = [(KINDS.index(k), a, b, _code(k, *judged(text, k, a, b, True)), 1) for k, a, b in own]
            taken = sorted((a, b) for _, a, b in own)
            for k, a, b in _apart(sorted(set(loose_spans(text)), key=lambda s: (s[1], KINDS.index(s[0]))), taken):
                flat.append((KINDS.index(k), a, b, _code(k, *judged(text, k, a, b, False)), 0))
            rows.append([x for s in flat for x in s])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "spans"])


def _apart(spans: list[tuple], taken: list[tuple[int, int]]) -> Iterator[tuple]:
    """Those of spans that overlap none of taken, sorted by start."""
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for s in spans:
        k = bisect_left(starts, s[2])
        if k == 0 or reach[k - 1] <= s[1]:
            yield s


def reliabilities(votes: np.ndarray, counts: np.ndarray, rates=PRIOR_RATES, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote combinations (rows of -1, 0, 1) with their counts: probability of each, and P(vote | class), 2 x labelers x 3.

    The prior rates count as PRIOR_WEIGHT of the spans in each class and give the first probabilities, so the classes keep their meaning
    and no labeler becomes certain.
    """
    believed = np.clip(np.array(rates).transpose(1, 0, 2), 1e-3, None)
    believed /= believed.sum(axis=2, keepdims=True)
    rate, prior = believed, 0.5
    for _ in range(rounds):
        log = [np.log(x) + sum(np.log(rate[c, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for c, x in ((0, 1 - prior), (1, prior))]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        rate = believed * (1 + PRIOR_WEIGHT * counts.sum())
        for c, q in ((0, 1 - p), (1, p)):
            for v in (-1, 0, 1):
                rate[c, :, v + 1] += ((votes == v) * (counts * q)[:, None]).sum(axis=0)
        rate = np.where(believed <= ANCHOR, believed, rate / rate.sum(axis=2, keepdims=True))
        prior = (1 + counts @ p) / (2 + counts.sum())
    return p, rate


def train(combinations: list[tuple[int, int]]) -> dict[int, float]:
    """(code, count): the codes whose spans the classifier accepts, with its scores. Each kind has its own weights."""
    scores: dict[int, float] = {}
    parts = [(c, n, *_decoded(c)) for c, n in combinations]
    for kind in sorted({p[2] for p in parts}):
        own = [p for p in parts if p[2] == kind]
        counts, votes, flags = (np.array(x) for x in ([float(p[1]) for p in own], [p[3] for p in own], [p[4] for p in own]))
        target = reliabilities(votes, counts)[0]
        x = np.hstack([np.ones((len(own), 1)), flags])
        w, weight = np.zeros(x.shape[1]), counts / counts.sum()
        for _ in range(25):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - target)) + 1e-3 * w
            w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(len(w)), gradient)
        scores |= {c[0]: score for c, score in zip(own, (x @ w).tolist()) if score > 0}
    return scores


def chosen(spans: list[tuple], scores: dict[int, float]) -> list[tuple]:
    """The accepted spans of one text, the best of those that overlap: by score, then length, then start."""
    kept: list[tuple[int, int, tuple]] = []
    for s in sorted((s for s in spans if s[3] in scores), key=lambda s: (-scores[s[3]], s[1] - s[2], s[1], s[0])):
        k = bisect_left(kept, (s[1],))
        if (k == 0 or kept[k - 1][1] <= s[1]) and (k == len(kept) or kept[k][0] >= s[2]):
            kept.insert(k, (s[1], s[2], s))
    return [s for _, _, s in kept]


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans, both arrays of (kind, start, end) by start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows give repeated results; an
    empty table gives no rows. Only id and text are read.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = materialize(own.mapInArrow(_candidates, "doc_id long, spans array<long>"), "pii-candidates")
    codes = F.explode(F.expr("filter(spans, (x, i) -> i % 5 = 3)")).alias("code")
    counted = found.select(codes).groupBy("code").agg(F.count("*").alias("n"))
    accepted = train([(r["code"], r["n"]) for r in counted.orderBy("code").collect()])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            base, both = [], []
            for flat in batch.column("spans").to_pylist():
                spans = [tuple(flat[k : k + 5]) for k in range(0, len(flat), 5)]
                strict = [s for s in spans if s[4]]
                added = chosen([s for s in spans if not s[4]], accepted)
                base.append([_struct(s) for s in strict])
                both.append([_struct(s) for s in sorted(strict + added, key=lambda s: (s[1], s[0]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(both, kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return found.mapInArrow(decide, f"doc_id long, base {spans}, spans {spans}")


def _struct(s: tuple) -> dict:
    return {"kind": KINDS[s[0]], "start": s[1], "end": s[2]}


def op8_pii_spans(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

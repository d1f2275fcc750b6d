"""Token counts by the whole-token shortcut.

Offline, before any text is read, every vocabulary string is encoded alone; those that come back as their one own token
form the whole-token set. A text is then cut before each single blank between two non-spaces, where a byte-level pre-token
always begins. A piece that is in the whole-token set counts one. The rest are cut into pre-tokens by the tokenizer's
pattern: those in the set count one, and only the others go through merges, each distinct one once a batch.

The pattern is matched by another library than the tokenizer's, so it is trusted only on code points whose classes are
long settled (SETTLED). Texts with others, and texts with the special string, are counted whole by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm.common import bounded_batches, byte_letters, table

# The pre-token pattern of the byte-level vocabulary, and its special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Marks that are one byte and so one token each.
MARKS = ".,;:!?"
#: Latin, Greek, Cyrillic, general punctuation, currency, CJK punctuation, kana and unified ideographs, less what is
#: unassigned or read as space by one library only.
UNSETTLED = re.compile("[^\t-\r -\x84\x86-\x9f\xa0-ͷЀ-҂Ҋ-ԯḀ-ỿ -⁤₠-₿　-〿ぁ-ゖァ-ヾ一-龥]")
#: The Latin-1 characters that need no closer look: printable ones and the line feed.
PLAIN = bytes([10, *range(32, 127), *range(161, 256)])
CACHED = 400_000


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The vocabulary strings that encode alone as their one own token."""
    letters, texts, ids = byte_letters(), [], []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            texts.append(bytes(letters[c] for c in token).decode())
            ids.append(number)
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character, or no token of bytes
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(x for x, number, e in zip(texts, ids, found) if e.ids == [number])


def merger(path: str) -> tiktoken.Encoding:
    """The vocabulary's merges as ranks. Ids must follow the order of merges, as is proved here: then rank equals id."""
    model, letters = json.loads(Path(path).read_text())["model"], byte_letters()
    if any(model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] != 256 + k for k, x in enumerate(model["merges"])):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    ranks = {bytes(letters[c] for c in x): k for x, k in model["vocab"].items() if k < 256 + len(model["merges"])}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(text: str) -> bool:
    """Nothing but settled Latin-1 characters, and no spaces other than blank and line feed."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


class Counter:
    """Counts of whole texts under one vocabulary; each Python worker builds its own from the vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer, self.merges = Tokenizer.from_file(path), merger(path)
        self.whole = whole_tokens(self.tokenizer)
        self.pattern = regex.compile(PATTERN)
        self.gap = re.compile(r"(?<=\S) (?=\S)")
        #: Counts of the pieces after a blank, without it.
        self.shortcut = {x[1:]: 1 for x in self.whole if x[:1] == " " and not x[1:2].isspace()}
        self.pieces = dict(self.shortcut)

    def _after_blank(self, x: str) -> int:
        """Count of a blank and x. A word, alone or with a mark at its end, is a pre-token, and needs no pattern."""
        if x.isalpha():
            return len(self.merges.encode_ordinary(" " + x))
        if x[:-1].isalpha() and x[-1] in MARKS:
            word = x[:-1]
            if word not in self.pieces:
                self.pieces[word] = self._after_blank(word)
            return 1 + self.pieces[word]
        return self._count(" " + x)

    def _count(self, piece: str) -> int:
        """Pre-tokens in the set count one; the others are merged."""
        return sum(1 if x in self.whole else len(self.merges.encode_ordinary(x)) for x in self.pattern.findall(piece))

    def _cut(self, text: str) -> list[str]:
        """Pieces; a blank goes before each but the first."""
        simple = plain(text) and not ("  " in text or " \n" in text or "\n " in text or " " in (text[0], text[-1]))
        return text.split(" ") if simple else self.gap.split(text)

    def counts(self, texts: list[str]) -> list[int]:
        found, cut = [0] * len(texts), {}
        for k, text in enumerate(texts):
            if text and (SPECIAL in text or not plain(text) and UNSETTLED.search(text)):
                found[k] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif text:
                cut[k] = self._cut(text)
        if len(self.pieces) > len(self.shortcut) + CACHED:
            self.pieces = dict(self.shortcut)
        pieces, count, after_blank = self.pieces, self._count, self._after_blank
        for x in {x for own in cut.values() for x in own[1:]}.difference(pieces):
            pieces[x] = after_blank(x)
        for k, own in cut.items():
            found[k] = count(own[0]) + sum(map(pieces.__getitem__, own[1:]))
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level tokenizer file, which every executor has. Null and empty texts have no bytes and no
    tokens. Texts are never cut off; repeated rows give repeated results; an empty table gives no rows; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            n = counter(vocabulary).counts([x or "" for x in column.to_pylist()])
            sizes = [len(x.as_py() or b"") for x in column.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

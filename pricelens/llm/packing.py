"""Packing by the sum-of-squares rule, online.

A task packs the documents of its own input partition as they come, so nothing shuffles. Whole windows are cut off long
documents first. The rest of length s goes to the fill level h that makes the sum of squared counts of partly filled
windows, kept in an array by level, smallest: leaving h lowers N(h), reaching h + s raises N(h + s) unless the window is
then full; a new window has h = 0. This keeps few windows open, and levels that complete each other.

When more than MAX_OPEN windows are open, and at the end of the partition, open windows are completed: gaps of the fullest
are filled from the emptiest, cutting documents. What the partition has left at the end, less than one window, goes into
windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm.common import bounded_batches, byte_letters, table

WINDOW, END_OF_TEXT = 4096, 2
MAX_OPEN = 1024
#: Lower-case letters that every Unicode version knows as such, in their only form; and how special strings begin.
PLAIN_WORD, SPECIAL_START = "^[a-zà-öø-ÿ]+$", "<|"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def merger(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Merges of lower-case words as ranks, a NUL for the end of a word; and for each id whether it ends one.

    Ids must be bytes, then bytes at a word's end, then tokens in the order of merges, as is proved here: then rank equals id.
    """
    model, letters = json.loads(Path(path).read_text())["model"], byte_letters()
    suffix = model["end_of_word_suffix"]
    merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    order = [x for x, k in sorted(model["vocab"].items(), key=lambda kv: kv[1]) if k < 512 + len(merges)]
    if sorted(order[:256]) != sorted(letters) or order[256:512] != [x + suffix for x in order[:256]] or order[512:] != merges:
        raise ValueError(f"{path}: ids don't follow the order of merges")
    ends = [len(x) > len(suffix) and x.endswith(suffix) for x in order]
    cut = lambda x, end: bytes(letters[c] for c in (x[: -len(suffix)] if end else x)) + b"\0" * end
    ranks = {cut(x, end): k for k, (x, end) in enumerate(zip(order, ends))}
    return tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={}), np.array(ends)


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The vocabulary's pre-tokens hold no space and don't tell A-Z from a-z, so a text's ids are those of its lower-cased
    parts between blanks and line feeds, and marks after a letter and before a blank are a part of their own. Arrow gives
    each batch's distinct parts. Those of plain letters are one pre-token each and are merged by rank in one call; all
    others go to the tokenizer. Their ids are then dealt out to all the places where a part occurs.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.ends = merger(path)

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct parts in one array, and where each part's begin, and how many they are."""
        plain = pc.match_substring_regex(parts, PLAIN_WORD).to_numpy(zero_copy_only=False)
        joined = "\0".join([*parts.filter(pa.array(plain)).to_pylist(), ""])
        own = np.array(self.words.encode_ordinary(joined), np.uint32)
        others = self.tokenizer.encode_batch_fast(parts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        rest = [e.ids for e in others]
        n, starts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        n[plain], n[~plain] = np.diff(np.flatnonzero(self.ends[own]), prepend=-1), np.fromiter(map(len, rest), np.int64, len(rest))
        starts[plain], starts[~plain] = np.cumsum(n[plain]) - n[plain], len(own) + np.cumsum(n[~plain]) - n[~plain]
        return np.concatenate((own, np.fromiter(chain.from_iterable(rest), np.uint32))), starts, n

    def __call__(self, texts: pa.Array) -> list[bytes]:
        whole = pc.replace_substring(texts.fill_null(""), "\n", " ")
        lower = pc.if_else(pc.match_substring(whole, SPECIAL_START), whole, pc.ascii_lower(whole))
        parts = pc.split_pattern(pc.replace_substring_regex(lower, "([a-z])([.,;:!?]+) ", "\\1 \\2 "), " ")
        coded = parts.flatten().dictionary_encode()
        ids, starts, n = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = n[at]
        ends = np.cumsum(sizes)
        dealt = ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(sizes.sum())].astype("<u4").tobytes()
        cuts = (4 * np.append(0, ends)[parts.offsets.to_numpy()]).tolist()
        return [dealt[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class SumOfSquares:
    """The open windows of one task. A piece is (doc_id, start, doc_tokens, ids as bytes); pack() and close() return windows."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level to put a piece of that size on; of equal ones the fullest."""
        room = self.levels[: self.window - size + 1]
        at = np.append(0, np.flatnonzero(room[1:]) + 1)
        left = np.where(at > 0, 1 - 2 * self.levels[at], 0)
        reached = np.where(at + size < self.window, 1 + 2 * self.levels[at + size], 0)
        return int(at[::-1][np.argmin((left + reached)[::-1])])

    def pack(self, doc_id: int | None, ids: bytes) -> Iterator[list]:
        n, start = len(ids) // 4, 0
        while n - start >= self.window:
            yield [(doc_id, start, n, ids[4 * start : 4 * (start + self.window)])]
            start += self.window
        if size := n - start:
            at = self.level(size)
            window = self.open[at].pop() if at else []
            self.levels[at] -= at > 0
            self.n_open -= at > 0
            window.append((doc_id, start, n, ids[4 * start :]))
            if at + size == self.window:
                yield window
            else:
                self._keep(window, at + size)
                if self.n_open > self.max_open:
                    yield from self._complete()

    def _keep(self, window: list, fill: int) -> None:
        self.open[fill].append(window)
        self.levels[fill] += 1
        self.n_open += 1

    def _complete(self) -> Iterator[list]:
        """Fill the gaps of the fullest windows from the emptiest; one window at most stays open."""
        fills = sorted(fill for fill, own in self.open.items() for _ in own)
        windows = [x for fill in sorted(self.open) for x in self.open[fill]]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.window - fills[high]
            while gap and low < high:
                doc_id, start, n, ids = windows[low].pop()
                take = min(gap, len(ids) // 4)
                windows[high].append((doc_id, start, n, ids[: 4 * take]))
                if len(ids) > 4 * take:
                    windows[low].append((doc_id, start + take, n, ids[4 * take :]))
                fills[low] -= take
                gap -= take
                fills[high] += take
                low += not windows[low]
            if not gap:
                yield windows[high]
                high -= 1
        if low == high and windows[low]:
            if fills[low] == self.window:
                yield windows[low]
            else:
                self._keep(windows[low], fills[low])

    def close(self) -> Iterator[list]:
        """All that is open: whole windows, then windows of lengths that are powers of two."""
        yield from self._complete()
        rest = [x for own in self.open.values() for window in own for x in window]
        left = sum(len(x[3]) // 4 for x in rest)
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, n, ids = rest.pop(0)
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, n, ids[: 4 * take]))
                if len(ids) > 4 * take:
                    rest.insert(0, (doc_id, start + take, n, ids[4 * take :]))
                room -= take
            yield window


def pack_documents(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_of_text: int = END_OF_TEXT, max_open: int = MAX_OPEN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are just the end-of-text id. A repeated row is packed once more, under the same doc_id. A null
    doc_id stays null. An empty table gives no rows. Other columns are not read. sequence_id is the input partition's
    number times 2^32 plus a count, so a retried task repeats its own.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_of_text], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = SumOfSquares(window, max_open), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def take(windows: Iterator[list]) -> None:
            nonlocal number
            for own in windows:
                offset = 0
                for key, start, n, ids in own:
                    rows.append((key, start, len(ids) // 4, zlib.crc32(ids), n, number, offset))
                    offset += len(ids) // 4
                number += 1

        def batch_of() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            done = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)
            rows.clear()
            return done

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary)(batch.column("text"))):
                take(packer.pack(key, ids + end))
            if rows:
                yield batch_of()
        take(packer.close())
        if rows:
            yield batch_of()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

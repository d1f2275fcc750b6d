"""Media columns as interleaved document sequences.

A document is HTML whose text and media references alternate. Parsing gives an ordered array of structs (position, kind,
text, digest, caption). Media live apart, content-addressed: a reference names the SHA-256 of the stored form, and a join
on that digest resolves it, after which the array is put back in order, so positions and captions stay aligned. Only the
columns asked for join; features of payloads are computed where the store is read, so payloads need not shuffle.

The stored form is a PGM image: a header with the height, then 64 samples of 8 bits a row. A document stands for its text
as one such image and, block by block of 64 rows, a thumbnail of one row, the mean of the block's rows; between them run
texts that name the bytes of the block. A long text is so a long sequence of texts and media.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table

ROW = 64
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
ITEM_TYPE = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
SCHEME = "sha256:"
SHOWN = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature")


def to_media(payload: bytes) -> bytes:
    """payload, a positive multiple of 64 bytes, as an 8-bit grey image."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_media(media: bytes) -> bytes:
    """The samples of an image by to_media; ValueError for anything else."""
    magic, size, most, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(payload) != width * height:
        raise ValueError("not an 8-bit grey image")
    return payload


def padded(text: bytes) -> bytes:
    """text with bytes 0 appended up to a positive multiple of 64."""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def thumbnails(payload: bytes) -> list[bytes]:
    """Per block of 64 rows an image of its mean row; the last block may be lower."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return [to_media(rows[k : k + ROW].mean(axis=0).astype(np.uint8).tobytes()) for k in range(0, len(rows), ROW)]


def page_of(text: bytes, digest: str, thumbs: list[str]) -> str:
    """The HTML that shows a text's image, then its blocks in order with their thumbnails."""
    figure = lambda d, caption: f'<figure><img src="{SCHEME}{d}"><figcaption>{caption}</figcaption></figure>'
    block = ROW * ROW
    shown = [f"<p>bytes {k * block} to {min((k + 1) * block, len(text))}</p>{figure(d, f'block {k}')}" for k, d in enumerate(thumbs)]
    return f"<article><h1>{text.count(b'\n') + 1} lines</h1>{figure(digest, f'{len(text)} bytes')}{''.join(shown)}</article>"


class _Sequence(HTMLParser):
    """Text runs and media references in document order; a figure's caption goes to its media, scripts and styles go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = self.in_caption = 0
        self.figure: int | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if not text:
            return
        if self.in_caption:
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media":
                    item["caption"] = text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            self._flush()
            own = dict(attrs)
            source = own.get("src") or ""
            digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else None
            self.items.append({"kind": "media", "text": None, "digest": digest, "caption": own.get("alt")})
        elif tag in ("p", "div", "li", "br", "h1", "h2", "h3", "figure", "figcaption", "article", "section", "td"):
            self._flush()
            self.figure = len(self.items) if tag == "figure" else self.figure
            self.in_caption += tag == "figcaption" and self.figure is not None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "figure", "figcaption", "article", "section", "td"):
            self._flush()
            self.in_caption -= tag == "figcaption" and self.in_caption > 0
            self.figure = None if tag == "figure" else self.figure

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.run.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [{"position": k, **x} for k, x in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, items) of every row; null and empty HTML gives an empty sequence. Media without a digest keep their place."""
    bounded_batches(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [parse_sequence(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.list_(ITEM_TYPE))], ["key", "items"])

    own = pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(parse, f"key long, items array<{ITEM}>").withColumnRenamed("key", key)


def resolve(parsed: DataFrame, media: DataFrame, key: str, *columns: str) -> DataFrame:
    """parsed (key, items), media (digest as 32 bytes, ...), a row per digest: (key, items) with columns of media added to each item.

    References that media lacks, and text, get nulls; order, positions and captions stay. Sequences are told apart by row,
    so equal keys don't mix. One sequence's items meet in one task, as they did before. A digest that very many documents
    refer to joins by an inner join, which adaptive execution splits.
    """
    numbered = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "sequences")
    refs = numbered.select("row", F.explode("items").alias("item")).where("item.digest IS NOT NULL").select("row", "item.position", F.try_to_binary("item.digest", F.lit("hex")).alias("digest"))
    found = refs.join(media.select("digest", F.struct(*columns).alias("media")), "digest")
    by_row = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("resolved"))
    fields = [x.split(":")[0].strip() for x in ITEM.removeprefix("struct<").removesuffix(">").split(",")]

    def with_media(item: Column) -> Column:
        got = F.try_element_at("resolved", item["position"])
        return F.struct(*[item[x].alias(x) for x in fields], *[got[c].alias(c) for c in columns])

    return numbered.join(by_row, "row", "left").select(key, F.transform("items", with_media).alias("items"))


def feature(payload: bytes) -> str:
    """Height, mean sample, share of zeros and entropy in bits."""
    at = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = at[at > 0] / len(payload)
    return f"{len(payload) // ROW}x{ROW};mean={(at @ np.arange(256)) / len(payload):.4f};zero={at[0] / len(payload):.4f};bits={-(p * np.log2(p)).sum() + 0.0:.4f}"


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each text as media and as an HTML document that refers to them; returns the stored table (doc_id, html, media:
    an array of digest and data, that of the whole text first)."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("digest", pa.string()), ("data", pa.binary())]))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, stored = [], []
            for x in batch.column("text").cast(pa.binary()):
                own = x.as_py() or b""
                payload = padded(own)
                media = [{"digest": hashlib.sha256(m).hexdigest(), "data": m} for m in (to_media(payload), *thumbnails(payload))]
                html.append(page_of(own, media[0]["digest"], [m["digest"] for m in media[1:]]))
                stored.append(media)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(html, pa.string()), pa.array(stored, kind)], ["doc_id", "html", "media"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(own.mapInArrow(store, "doc_id long, html string, media array<struct<digest: string, data: binary>>"), "media", "zstd")


def payload_features(media: DataFrame) -> DataFrame:
    """media (digest, media) read back: a row per digest with what its payload shows.

    Hashes are 32 bytes here, half of what they are as text, for they are most of what shuffles. The digest is that of the
    stored form as read; a medium that doesn't have the digest it is stored under is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for named, x in zip(batch.column("digest").to_pylist(), batch.column("media")):
                stored = x.as_py()
                payload, digest = from_media(stored), hashlib.sha256(stored)
                if digest.hexdigest() != named:
                    raise ValueError(f"medium {named} has changed")
                rows.append((digest.digest(), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-ROW:]), len(stored), feature(payload)))
            types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", *SHOWN])

    found = media.mapInArrow(read, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string")
    return found.groupBy("digest").agg(F.max(F.struct(*SHOWN)).alias("own")).select("digest", "own.*")


def media_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its text as stored media, referred to by an HTML sequence, parsed, resolved, read back.

    Returns doc_id and items, each with what its medium's payload shows. Null and empty texts are 64 bytes 0. Equal texts
    have equal values and share a digest. Repeated rows give repeated results; an empty table gives no rows. Only id and
    text are read.
    """
    stored = store_texts(docs, doc_id, text)
    parsed = sequences(stored.select("doc_id", "html"), "doc_id", "html")
    # a table of its own, so that the join has shuffles on both sides and a digest of many copies can be split
    shown = materialize(payload_features(stored.select(F.inline("media").alias("digest", "media"))), "media-features")
    return resolve(parsed, shown, "doc_id", *SHOWN)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """The whole text's medium, which comes first; the feature also tells the number of blocks and, as a checksum, every
    item of the sequence in order: position, text or caption, and what the medium was read back as."""
    whole = media_documents(table(spark, sf_dir, "documents"))
    media = F.filter("items", lambda x: x["kind"] == "media")
    shown = F.transform("items", lambda x: F.concat_ws(":", x["position"], x["kind"], F.coalesce(x["text"], x["caption"]), F.hex(x["payload_sha256"])))
    own = whole.select("doc_id", media[0].alias("m"), (F.size(media) - 1).alias("blocks"), F.crc32(F.array_join(shown, ",").cast("binary")).alias("order"))
    n_bytes = F.regexp_extract("m.caption", "^([0-9]+) bytes$", 1).cast("long").alias("n_bytes")
    feature_of = F.concat_ws(";", F.concat(F.lit("at="), "m.position"), "m.feature", F.concat(F.lit("blocks="), "blocks"), F.concat(F.lit("order="), "order")).alias("feature")
    sha = F.lower(F.hex("m.payload_sha256")).alias("payload_sha256")
    return own.select("doc_id", n_bytes, "m.payload_bytes", sha, "m.tail_crc32", "m.media_bytes", F.col("m.digest").alias("media_sha256"), feature_of)

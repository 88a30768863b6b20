"""Interleaved document sequences with media columns.

HTML is parsed into the ordered sequence of its text blocks and media references; a caption
(``figcaption``, else ``alt``) stays with its reference and every entry keeps its position.
Payloads live in a store keyed by the SHA-256 of their stored form, and references resolve
to them by a join on that digest.

A byte string is stored losslessly as a binary PGM image: 8-bit samples in rows of 64, the
bytes padded with zeros to a positive multiple of 64 and their true number in a comment.

Defined results: null or empty HTML gives no entries; a null text is stored as an empty one
(64 zero bytes); equal payloads share one digest, and a store may hold repeated rows of a
digest (they count once); a reference whose digest the store lacks keeps its position and
has null payload columns; repeated rows give repeated entries; an empty table gives no rows;
further columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
DIGEST = "sha256:"
_SKIP = {"script", "style", "noscript", "template"}
_INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "var", "wbr"}

ENTRY = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)
FEATURES = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


class _Sequence(HTMLParser):
    """Collects (kind, text, src, caption) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.entries: list[list] = []
        self._text: list[str] = []
        self._caption: list[str] | None = None
        self._figure: int | None = None  # entries at the figure's start
        self._skip = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.entries.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self._skip += 1
        elif tag == "figure":
            self._flush()
            self._figure = len(self.entries)
        elif tag == "figcaption" and self._figure is not None:
            self._flush()
            self._caption = []
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            if a.get("src"):
                self._flush()
                self.entries.append(["media", None, a["src"], a.get("alt") or None])
        elif tag not in _INLINE:
            self._flush()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption = " ".join("".join(self._caption).split())
            self._caption = None
            for e in self.entries[self._figure or 0 :]:
                if e[0] == "media" and caption:
                    e[3] = caption
        elif tag not in _INLINE:
            self._flush()
            if tag == "figure":
                self._figure = None

    def handle_data(self, data):
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)

    def close(self):
        super().close()
        self._flush()


def parse_sequence(html: str | None) -> list[list]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.entries


def interleave(pages: DataFrame, key: str | Column = "page_id", html: str | Column = "html") -> DataFrame:
    """One row per text block or media reference of each page, by position."""
    col = lambda c: F.col(c) if isinstance(c, str) else c

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for k, h in zip(*(batch.column(i)[lo : lo + 200].to_pylist() for i in (0, 1)), strict=True):
                    for at, (kind, text, src, caption) in enumerate(parse_sequence(h)):
                        digest = src[len(DIGEST) :] if src and src.startswith(DIGEST) else None
                        out.append((k, at, kind, text, src, digest, caption))
                kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=ENTRY.names)

    return pages.select(col(key).cast("long").alias("key"), col(html).alias("html")).mapInArrow(run, ENTRY)


def stored_form(text: Column) -> Column:
    """The PGM image that holds a text's UTF-8 bytes."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int")
    head = F.encode(F.concat(F.lit("P5\n# bytes="), n.cast("string"), F.lit(f"\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    return F.concat(head, raw, F.unhex(F.repeat(F.lit("00"), rows * WIDTH - n)))


def read_stored(media: bytes) -> tuple[int, np.ndarray]:
    """(bytes, samples in rows) of a stored form."""
    magic, comment, size, depth, rest = media.split(b"\n", 4)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(rest) != width * rows:
        raise ValueError("not a stored form")
    return int(comment.split(b"=")[1]), np.frombuffer(rest, np.uint8).reshape(rows, width)


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, deviation, an eight-bin histogram and a 64-bit hash of bright columns."""
    sums = samples.sum(axis=0, dtype=np.int64)
    n, total = samples.size, int(sums.sum())
    counts = np.bincount(samples.reshape(-1), minlength=256)
    square = int((counts * np.arange(256, dtype=np.int64) ** 2).sum())
    bright = np.packbits(sums * samples.shape[1] > total).tobytes().hex()
    bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    var = (square * n - total * total) / (n * n)
    return f"{samples.shape[0]}x{samples.shape[1]};mean={total / n:.4f};std={var**0.5:.4f};bins={bins};hash={bright}"


def media_features(store: DataFrame) -> DataFrame:
    """Sizes, digests and features of the payloads in ``store`` (digest, media), read back."""

    def run(batches):
        for batch in batches:
            out = []
            for digest, media in zip(batch.column(0), batch.column(1), strict=True):
                media = media.as_py()
                n, samples = read_stored(media)
                payload = samples.tobytes()
                sha = hashlib.sha256(payload).hexdigest()
                stored = hashlib.sha256(media).hexdigest()
                out.append((digest.as_py(), n, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), stored, feature_of(samples)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.string() if i in (0, 3, 6, 7) else pa.int64()) for i in range(len(FEATURES))], names=FEATURES.names
            )

    return store.select("digest", "media").mapInArrow(run, FEATURES)


def resolve(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Media entries of :func:`interleave` with the columns of the payload of their digest.

    Both sides are narrow; a digest that very many entries share is split by the adaptive
    skew join, since nothing is aggregated after it.
    """
    unique = payloads.dropDuplicates(["digest"])
    return entries.filter(F.col("kind") == "media").join(unique, "digest", "left")


def store_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Write each text's stored form under its digest and return the store read back."""
    media = docs.select(stored_form(F.col(text)).alias("media")).select(F.sha2("media", 256).alias("digest"), "media")
    media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


def document_html(text: Column) -> Column:
    """A document as HTML: its text, and a figure that refers to its stored form."""
    whole = F.coalesce(text, F.lit(""))
    safe = F.replace(F.replace(F.replace(whole, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.substring_index(safe, "\n", 1)
    return F.concat(
        F.lit("<article><p>"), lines, F.lit(f'</p><figure><img src="{DIGEST}'), F.sha2(stored_form(text), 256), F.lit('"><figcaption>'),
        F.length(whole).cast("string"), F.lit(" characters</figcaption></figure><p>"), F.substr(safe, F.length(lines) + 1), F.lit("</p></article>"),
    )

"""Bounded-space online best-fit packing of token sequences.

A fixed number of bins is open in a task; a bitset keyed by free space finds the bin in which a piece leaves the least
room. When none fits and all are open, the fullest closes. A task holds only its open bins, so its memory is bounded,
and tasks pack side by side; each may end with a few bins that are not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
OPEN_BINS = 256
END_ID = 1
#: Texts that are encoded and packed together; within them long pieces go first.
BATCH = 2000
#: Words that a generation of the encoder's cache may hold.
CACHED = 600_000
#: Marks that form one token group of their own after a word; none of them begins a special token.
MARKS = b"!\"#$%&'()*+,-./:;=?@[]^_`{}~"


class BestFit:
    """Open bins of ``length`` by free space."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_BINS):
        self.length, self.most, self.free, self.bins, self.open, self.made = length, most, 0, {}, 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin number, offset) for a piece of 1 to ``length`` tokens."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.length, self.made
            self.made += 1
        if left := space - size:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.length - space

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        self.open -= 1
        if not held:
            self.free ^= 1 << space
        return number


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class WordCoder:
    """Byte-pair ids of plain words: the vocabulary's merges as ranks, with one byte as the end of a word.

    The vocabulary numbers its merges in their order, so ids serve as ranks once ended bytes come first.
    """

    END = b"\x01"

    def __init__(self, tokenizer):
        import tiktoken

        letters = _byte_letters()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks: dict[bytes, int] = {}
        for word, i in tokenizer.get_vocab().items():
            body = word.removesuffix("</w>")
            if word not in special and all(c in letters for c in body):
                # an ended byte is never formed by a merge, so it comes before all merges
                ranks[bytes(letters[c] for c in body) + (self.END if body != word else b"")] = i
        ranks = {w: i for w, i in ranks.items() if w != self.END}
        ended = {w for w in ranks if len(w) == 2 and w.endswith(self.END)}
        order = sorted(ranks, key=lambda w: (0 if w in ended else 1 if len(w) == 1 else 2, ranks[w]))
        self.ids = [ranks[w].to_bytes(4, "little") for w in order]
        self.coding = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks={w: r for r, w in enumerate(order)} | {self.END: len(order)}, special_tokens={})

    def encode(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        spelt = self.ids
        return b"".join([spelt[r] for r in self.coding.encode_ordinary(word + "\x01")])


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit integers, equal to those of the tokenizer.

    The tokenizer's rules never look across a space or line feed, so a text is encoded part by part; parts that
    were seen before come from a cache of two generations, the older of which is dropped when the newer is full.
    """

    def __init__(self, path: str, most: int = CACHED):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words = WordCoder(self.tokenizer)
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def parts(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if b"<|" not in raw:  # special tokens are found before letters are lower-cased
            raw = raw.lower()
        return raw.replace(b"\n", b" ").split(b" ")

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        out = b"".join(map(self.__getitem__, self.parts(text)))
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return out

    @staticmethod
    def plain(word: str) -> bool:
        """Letters that the tokenizer's normal form and lower case leave as they are."""
        return word.isalpha() and (word.isascii() or max(word) < "\u0250") and word == word.lower()

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            body = part.rstrip(MARKS)
            text = body.decode()
            if self.plain(text):
                ids = self.words.encode(text) + (self[part[len(body) :]] if len(body) < len(part) else b"")
            else:
                ids = self._whole(part.decode())
        self[part] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every row of ``docs`` in pieces, placed in sequences.

    ids holds the piece's ids as little-endian unsigned 32-bit integers. ``path`` is the vocabulary file that
    all executors can open. Null and empty texts are the end id alone; other columns are not read; equal rows
    are packed each on its own; an empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bins, base = encoder(path), BestFit(length, open_bins), TaskContext.get().partitionId() << 36
        for whole in rows:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids = [code.encode(t or "") + end for t in batch.column("text").to_pylist()]
                pieces = [(row, k, k * length, min(length, len(x) // 4 - k * length)) for row, x in enumerate(ids) for k in range(-(-len(x) // (4 * length)))]
                pieces.sort(key=lambda p: -p[3])
                placed = [bins.put(p[3]) for p in pieces]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array([p[0] for p in pieces], pa.int32())),
                        pa.array([p[1] for p in pieces], pa.int32()),
                        pa.array([p[2] for p in pieces], pa.int64()),
                        pa.array([p[3] for p in pieces], pa.int64()),
                        pa.array([ids[p[0]][4 * p[2] : 4 * (p[2] + p[3])] for p in pieces], pa.binary()),
                        pa.array([base + n for n, _ in placed], pa.int64()),
                        pa.array([o for _, o in placed], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

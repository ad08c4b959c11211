"""Best-fit packing of tokenised documents into sequences.

Texts are tokenised where they are read; only pieces (id, length, checksum)
move on.  Pieces are dealt by a hash into buckets of a fixed expected number of
sequences, and each bucket is packed on its own by bounded-space online best-fit:
at most ``open_bins`` bins are open, a bitset tells which amounts of free space
there are, a piece goes to the open bin that it leaves fullest, and when one bin
too many is open the fullest is closed for good.

Pieces come in waves that a hash draws, longest first within a wave: what a wave
leaves open is filled up by the next.  So few bins stay open for long, and the
bound binds where over a third of a wave's pieces find no room together; it then
costs little, as the fullest bin has least to lose.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, utf8, written

SEQUENCE = 1024
END = 2
OPEN_BINS = 768
#: Sequences that a bucket is expected to fill, and pieces that a wave is expected to have.
BUCKET_SEQUENCES, WAVE_PIECES = 16_384, 2048
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Chunks whose ids a Python worker remembers.
MOST_CHUNKS = 150_000
_TWO_BLANKS, _BLANKS = re.compile(r" \s|\s "), re.compile(r"\s+")
#: Longer runs of blanks go to ``tokenizers``: looking for their end, the other's pattern uses up its stack.
MOST_BLANKS = 100_000


class Chunks(dict):
    """Ids (little-endian bytes) of chunks seen, bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.asarray(self.encode(" " + chunk), "<u4").tobytes()
        if len(self) < MOST_CHUNKS and len(chunk) < 40:
            self[chunk] = ids
        return ids


class Tokens:
    """Ids of a text by the byte-level vocabulary, as ``tokenizers`` gives them.

    The same merges run in ``tiktoken``, which is several times faster.  The
    vocabulary's pattern never joins what stands on either side of a single
    blank between two non-blanks, so such texts are cut there and the ids of
    frequent chunks remembered.  Texts with the special token's string or with a
    run of over ``MOST_BLANKS`` blanks go to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = vocabulary
        self.whole = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.chunks = Chunks(self.whole)
        self.slow = None

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text or (len(text) > MOST_BLANKS and any(b - a > MOST_BLANKS for a, b in map(re.Match.span, _BLANKS.finditer(text)))):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _TWO_BLANKS.search(text):
            return np.asarray(self.whole(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.asarray(self.whole(first), "<u4").tobytes() + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(1)
def _tokens(vocabulary: str | None, ranks: str | None) -> Tokens:
    import public_tokenizers

    return Tokens(vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_END = np.asarray([END], "<u4").tobytes()


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, but for the first piece."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str | None, ranks: str | None) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(vocabulary, ranks)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = tokens(text.as_buffer().to_pybytes().decode()) + _END
            rows += [(doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


class Packer:
    """Online best-fit with a bounded number of open bins."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.free = 0  # bit f is set if an open bin has f tokens of space
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bin_ = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length`` tokens, 1 to ``size``."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.size, self.made
            self.made += 1
        if left := space - length:
            self.bins[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
            if self.open > self.most:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
        return bin_, self.size - space


def pack(lengths: Iterable[int], size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(sequence, offset) of pieces in the order they come."""
    packer = Packer(size, open_bins)
    return [packer.place(n) for n in lengths]


def _packed(batches: Iterator[pa.RecordBatch], open_bins: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket; sequence ids are the bucket's number and a count."""
    bucket, packer = None, Packer(open_bins=open_bins)
    for batch in batches:
        ids, offsets = [], []
        for b, n in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist()):
            if b != bucket:
                bucket, packer = b, Packer(open_bins=open_bins)
            bin_, offset = packer.place(n)
            ids.append(b << 32 | bin_)
            offsets.append(offset)
        rest = [batch.column(n) for n in _PIECES.names]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*_PIECES.names, "sequence_id", "offset"])


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The pieces of each row of ``docs(doc_id, text)``; the vocabulary files' paths are parameters."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(lambda batches: _pieces(batches, vocabulary, ranks), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, open_bins: int = OPEN_BINS, bucket_sequences: int = BUCKET_SEQUENCES, wave_pieces: int = WAVE_PIECES, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Where each piece of each document goes.

    A null or empty text is its end token alone.  A text of any length is tokenised
    whole, in the memory of its ids (4 bytes each) and of the library; its pieces then
    go their own ways.  Repeated rows are packed each (their pieces look alike but for
    their place, and which gets which is any); a null doc_id is packed like
    any other; an empty table gives an empty result; extra columns are ignored.
    """
    pieces = written(tokenized_pieces(docs, vocabulary, ranks), "pieces")
    total, n = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    buckets = max(1, round(total / (SEQUENCE * bucket_sequences)))
    waves = max(1, round(n / buckets / wave_pieces))
    # Pieces of one document may go to different buckets, and so may rows that are alike: neither is a hot key.
    drawn = pieces.withColumn("_drawn", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    bucket, wave = F.pmod("_drawn", F.lit(buckets)).cast("int"), F.pmod(F.shiftright("_drawn", 32), F.lit(waves)).cast("int")
    dealt = drawn.withColumns({"bucket": bucket, "wave": wave}).drop("_drawn")
    dealt = dealt.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket", "wave", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(lambda batches: _packed(batches, open_bins), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; see ``pack_documents`` for the edge cases."""
    return pack_documents(table(spark, sf_dir, "documents"))

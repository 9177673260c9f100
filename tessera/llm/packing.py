"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each document becomes ids (plus an end id); only one longer than a sequence is cut, and its first piece
takes the remainder.  Pieces are dealt by hash to partitions of a few thousand or more (at most as many partitions
as the session shuffles to) and packed there by bounded-space online best fit: at most ``open_bins`` bins are open, kept by free space
with a bitset of the free spaces in use; a piece goes to the bin with least sufficient space, a full bin
is closed at once, and when one too many is open the fullest closes.  Pieces arrive in an order that does not
hang on their lengths; only blocks of ``open_bins`` of them are put longest first.  (A partition that is sorted as a
whole would close the bins that its later, shorter pieces need.)  Sequences are under 1 % more than the tokens
need from some thousand pieces a partition on.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks

#: Pieces of a partition, at least (where there are so many): the bins that its end leaves open are few against them.
PARTITION = 4000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space on which the pattern would go back step by step, further than its stack goes.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text, as little-endian bytes, under a tokenizer file (JSON).

    A byte-level BPE whose ids follow its merges is read into tiktoken's faster coder, which gives the same
    ids; any other file is left to its own library.  The file's added tokens are found in texts, as the
    library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, byte = spec["model"], spec.get("pre_tokenizer") or {}, _byte_of()
        added = spec.get("added_tokens", [])
        special = {x["content"]: x["id"] for x in added}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special} if isinstance(model["vocab"], dict) else {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        by_merge = [vocabulary.get("".join(m)) for m in merges] == list(range(256, 256 + len(merges)))
        plain = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        simple = plain and model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.coder, self.special = None, tuple(special)
        if simple and by_merge and len(vocabulary) == 256 + len(merges):
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
            self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        if self.coder:
            return b"".join(self._coded(text))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _coded(self, text: str) -> Iterator[bytes]:
        """Ids of the text; a long run of blanks is one piece, without its last one where a word follows, as the pattern says."""
        at = 0
        for run in LONG_BLANKS.finditer(text) if len(text) >= 5000 else ():
            last = run.end() == len(text) or (self.special and text.startswith(self.special, run.end()))
            end = run.end() - (not last)
            yield self.coder.encode_to_numpy(text[at : run.start()], allowed_special="all").astype("<u4").tobytes()
            yield np.array(self.coder._encode_single_piece(text[run.start() : end]), "<u4").tobytes()
            at = end
        yield self.coder.encode_to_numpy(text[at:], allowed_special="all").astype("<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32; with_ids adds ids (array<int>).

    A null text counts as empty (one piece with the end id).  Rows that repeat a doc_id are cut each on its own.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for part, raw in blocks.chunks(batches):
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), raw, strict=True):
                ids = encode(text.decode()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc, i, a, b - a, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("i4")] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    schema = PIECES + ", ids array<int>" * with_ids
    names, kinds = [x.split()[0] for x in schema.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best fit; place() gives the bin and the offset for a piece."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.free_set, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        got = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_set &= ~(1 << free)
        self.open -= 1
        return got

    def place(self, n: int) -> tuple[int, int]:
        fits = self.free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.made
            self.made += 1
        if left := free - n:
            if self.open >= self.most:
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.free_set |= 1 << left
            self.open += 1
        return bin_, self.length - free


def pack(cut: DataFrame, length: int = 1024, open_bins: int = 4096) -> DataFrame:
    """Place pieces: their columns (ids too, if there) with sequence_id and offset.

    sequence_id is the partition's number times 2**40 plus the bin's number in it.  A partition holds
    nothing but small rows and is sorted by their checksums, so a repeated task gives the same places.  No
    pieces: no rows.  Pieces that are alike in all columns are placed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bins = TaskContext.get().partitionId() << 40, BestFit(length, open_bins)
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            placed = np.empty((len(size), 2), np.int64)
            for a in range(0, len(size), open_bins):
                order = a + np.argsort(-size[a : a + open_bins], kind="stable")
                placed[order] = [bins.place(n) for n in size[order].tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + placed[:, 0]), pa.array(np.ascontiguousarray(placed[:, 1]))], [*batch.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    cut = blocks.written(cut, blocks.shared_dir(cut.sparkSession, "pieces"))  # they are counted first: many small partitions would leave bins open
    n = max(1, min(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), cut.count() // PARTITION))
    dealt = cut.repartition(n, "doc_id", "piece", "ids_crc32")
    return dealt.sortWithinPartitions("ids_crc32", "doc_id", "piece", "start", "length").mapInArrow(run, schema)

"""Alignment of two tokenizers by lockstep merging of their byte offsets.

Both tokenizations of a text cover the same bytes. A pair of pointers walks along them: where the two current tokens
overlap they are linked, then the token that ends first is left behind; where both end together is a cut, and cuts
separate the groups. One NumPy state vector holds the pointers of all documents of a block and moves them in lockstep;
whoever is done leaves the vector. A long document enters as several walkers, each over a stretch of its A tokens, so no
document keeps the vector waiting. Every step writes its links and cuts to places of their own (the sum of the two token
numbers grows by at least one a step), which puts them in text order without a sort.

How often an id pair is linked in the whole corpus is counted relationally. A block of documents, bounded in bytes, lists
each of its pairs once with a local count; these rows are summed per pair, the highest count per B id is found, and the
answers come back to the block by joins on pair and block. Rows grow with the number of blocks, no pair is hotter than
one row a block, and per-document sums are taken from the block's links, which were stored once.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens
(zeros and an empty digest); special strings are plain text; repeated rows are counted one by one; a very long text is a
block by itself; an empty table gives no row; columns other than those carried are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from watchgrid.llm.vocabulary import SPLIT, Remembered, plain_lines
from watchgrid.session import cut_lineage

#: Bytes of text and documents of one block.
BLOCK_BYTES = 2_000_000
BLOCK_DOCS = 4096
#: A tokens that one walker covers.
STRETCH = 256
#: An id pair is one number: the A id above so many bits of the B id.
B_BITS = 20
_CODEC = "zstd"


def _packed_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Pair:
    """Two tokenizers as functions from text to packed ids, words that repeat being looked up."""

    def __init__(self, ranks_path: str, model_path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        byte_level = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        encode = model.encode
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Words can be encoded one by one if no piece reaches over the front of a word or over a line feed.
        self._by_word = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self._a, self._b = (lambda t: _packed_ids(byte_level(" " + t))), (lambda t: _packed_ids(encode(t)))
        feed = _packed_ids(encode("\n"))
        self._a_words, self._b_words = Remembered(self._a), Remembered(self._b)
        self._a_firsts = Remembered(lambda w: _packed_ids(byte_level(w)))
        self._b_firsts = Remembered(lambda w: _packed_ids(encode("\n" + w))[len(feed) :])
        self._a_feed, self._b_feed = _packed_ids(byte_level("\n")), feed[-4:]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of the blank and the text by A, and of the text by B; nothing where bytes are not given back."""
        if not text:
            return b"", b""
        lines = plain_lines(text) if self._by_word else None
        if lines is None:
            a, b = self._a(text), self._b(text)
        else:
            a, b = [], []
            for line in lines:
                words_a, words_b = (self._a_firsts, self._b_firsts) if a else (self._a_words, self._b_words)
                a.append(words_a[line[0]] + b"".join(map(self._a_words.__getitem__, line[1:])))
                b.append(words_b[line[0]] + b"".join(map(self._b_words.__getitem__, line[1:])))
            a, b = self._a_feed.join(a), self._b_feed.join(b)
        want = b" " + text.encode("utf-8")
        for ids, known in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(known.__getitem__, memoryview(ids).cast("I"))) != want:
                return b"", b""
        return a, b


@lru_cache(maxsize=2)
def pair_of(ranks_path: str, model_path: str) -> Pair:
    return Pair(ranks_path, model_path)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, stretch: int = STRETCH):
    """Links (A place, B place) in text order, and which of them end both tokens.

    ``a_end`` and ``b_end`` are byte offsets of token ends over all documents, laid end to end on one axis; ``starts`` are
    the A places where documents begin."""
    count = len(a_end)
    first = np.unique(np.r_[starts[starts < count], np.arange(0, count, stretch)]).astype(np.int64)
    last = np.r_[first[1:], count]
    i = first
    j = np.searchsorted(b_end, np.where(first > 0, a_end[first - 1], 0), side="right")
    size = count + len(b_end)
    link_a, link_b = np.full(size, -1, np.int32), np.empty(size, np.int32)
    both = np.zeros(size, bool)
    while len(i):
        ends_a, ends_b = a_end[i], b_end[j]
        a_moves, b_moves = ends_a <= ends_b, ends_b <= ends_a
        place = i + j
        link_a[place], link_b[place], both[place] = i, j, a_moves & b_moves
        i, j = i + a_moves, j + b_moves
        going = i < last
        if not going.all():
            i, j, last = i[going], j[going], last[going]
    there = link_a >= 0
    return link_a[there], link_b[there], both[there]


@lru_cache(maxsize=1)
def _decimals(most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids as rows of bytes, and how many there are."""
    shown = np.zeros((most, 7), np.uint8)
    text = np.array([str(i) for i in range(most)], dtype="S7")
    shown[:] = text.view(np.uint8).reshape(most, 7)
    return shown, (shown > 0).sum(axis=1)


def group_texts(a_ids, b_ids, cut_a, cut_b, b_last) -> tuple[bytes, np.ndarray]:
    """The groups written out, and behind which byte each B token ends. ``cut_a``, ``cut_b``: the token ends its group;
    ``b_last``: the token is its document's last."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    b_before = np.r_[0, np.flatnonzero(cut_b) + 1]
    a_until = np.flatnonzero(cut_a) + 1
    at_a, at_b = np.arange(len(a_ids)) + b_before[group_a], np.arange(len(b_ids)) + a_until[group_b]
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    behind = np.empty(len(ids), np.uint8)
    ids[at_a], ids[at_b] = a_ids, b_ids
    behind[at_a] = np.where(cut_a, ord("|"), ord(","))
    behind[at_b] = np.where(b_last, 0, np.where(cut_b, ord(";"), ord(",")))
    digits, sizes = _decimals()
    shown, size = digits[ids], sizes[ids]
    shown[np.arange(len(ids)), size] = behind
    ends = np.cumsum(size + (behind > 0))
    return shown[shown > 0].tobytes(), ends[at_b]


class Aligned:
    """A block of documents after alignment."""

    def __init__(self, encoded: list[tuple[bytes, bytes]], a_sizes: np.ndarray, b_sizes: np.ndarray, stretch: int = STRETCH):
        a_ids, b_ids = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in zip(*encoded))
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in zip(*encoded))
        until_a, until_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        link_a, link_b, both = lockstep(np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids]), until_a - self.n_a, stretch)
        cut_a, cut_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        cut_a[link_a[both]], cut_b[link_b[both]] = True, True
        self.n_groups = np.diff(np.r_[0, np.cumsum(cut_a)][np.r_[0, until_a]])
        self.until = np.searchsorted(link_a, until_a)
        self.n_links = np.diff(np.r_[0, self.until])
        b_last = np.zeros(len(b_ids), bool)
        b_last[until_b[self.n_b > 0] - 1] = True
        text, ends = group_texts(a_ids, b_ids, cut_a, cut_b, b_last)
        bounds = np.r_[0, ends][np.r_[0, until_b]].tolist()
        self.digests = [hashlib.sha256(text[x:y]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]
        links = (a_ids[link_a] << B_BITS) | b_ids[link_b]
        self.pairs, self.links, self.counts = np.unique(links, return_inverse=True, return_counts=True)


def align(
    docs: DataFrame, ranks_path: str, model_path: str, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per block: documents as arrays (``rows``, counts, digests), the block's pairs with local counts, its links."""
    narrow = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    row = to_arrow_schema(narrow.schema).field("row")
    number = pa.list_(pa.int64())
    arrow = pa.schema(
        [("rows", pa.list_(row.type)), *[(n, number) for n in ("n_a", "n_b", "n_groups", "n_links")]]
        + [("digests", pa.list_(pa.string())), ("pairs", number), ("counts", number), ("links", pa.binary())]
    )

    def block_of(rows: list[pa.Array], encoded: list, a_sizes: np.ndarray, b_sizes: np.ndarray) -> pa.RecordBatch:
        found = Aligned(encoded, a_sizes, b_sizes)
        kind = np.uint16 if len(found.pairs) <= 1 << 16 else np.uint32
        columns = [pa.ListArray.from_arrays(pa.array([0, len(encoded)], pa.int32()), pa.concat_arrays(rows))]
        columns += [pa.array([getattr(found, n)], number) for n in ("n_a", "n_b", "n_groups", "n_links")]
        columns += [pa.array([found.digests]), pa.array([found.pairs], number), pa.array([found.counts], number)]
        columns += [pa.array([pa.compress(found.links.astype(kind).tobytes(), _CODEC, asbytes=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(ranks_path, model_path)
        sizes = [np.array([len(t) for t in known], np.int64) for known in (pair.a_bytes, pair.b_bytes)]
        rows, encoded, held = [], [], 0
        for batch in batches:
            begun = 0
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                encoded.append(pair.encode(text))
                held += len(text)
                if held >= block_bytes or len(encoded) >= BLOCK_DOCS:
                    rows.append(batch.column(0).slice(begun, at + 1 - begun))
                    yield block_of(rows, encoded, *sizes)
                    rows, encoded, held, begun = [], [], 0, at + 1
            if begun < batch.num_rows:
                rows.append(batch.column(0).slice(begun))
        if encoded:
            yield block_of(rows, encoded, *sizes)

    return narrow.mapInArrow(run, from_arrow_schema(arrow))


def pair_counts(listed: DataFrame) -> DataFrame:
    """``pair``, ``total`` (links in the corpus), ``best`` (no pair with this B id has more), from rows of ``pair``, ``n``."""
    totals = listed.groupBy("pair").agg(F.sum("n").alias("total"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    return totals.withColumn("best", F.col("total") == F.max("total").over(same_b))


def align_tokenizers(
    docs: DataFrame, ranks_path: str, model_path: str, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the carried columns), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = align(docs, ranks_path, model_path, carry, block_bytes)
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "it"))
    listed = listed.select("block", "place", F.col("it.pairs").alias("pair"), F.col("it.counts").alias("n"))
    answers = listed.drop("n").join(pair_counts(listed), "pair").groupBy("block")
    answers = answers.agg(F.collect_list(F.struct("place", "total", "best")).alias("answers"))
    met = blocks.drop("pairs", "counts").join(answers, "block", "left").drop("block")
    carried = to_arrow_schema(docs.select(F.struct(*carry).alias("row")).schema).field("row")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([carried, *[(n, pa.int64()) for n in names], ("groups_sha256", pa.string())])

    def sums(values: np.ndarray, links: np.ndarray, until: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values[links])][np.r_[0, until]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                counts = [column[n][k].values for n in ("n_a", "n_b", "n_groups", "n_links")]
                found = column["answers"][k].values
                size = len(found) if found is not None else 0
                total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                if size:
                    place = found.field("place").to_numpy()
                    total[place] = found.field("total").to_numpy()
                    best[place] = found.field("best").to_numpy(zero_copy_only=False)
                until = np.cumsum(counts[3].to_numpy())
                kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
                linked = int(until[-1]) if len(until) else 0
                links = np.frombuffer(pa.decompress(column["links"][k].as_py(), linked * kind.itemsize, _CODEC), kind)
                more = [pa.array(sums(v, links, until), pa.int64()) for v in (best, total)]
                yield pa.RecordBatch.from_arrays(
                    [column["rows"][k].values, *counts, *more, column["digests"][k].values], schema=schema
                )

    return met.mapInArrow(run, from_arrow_schema(schema))

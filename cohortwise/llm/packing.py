"""Best-fit decreasing packing of documents into token windows.

A document's ids and the end id are cut into full windows first; the rest, shorter than a window,
goes to the tightest open window that still holds it, found in a segment tree indexed by remaining
capacity, longest rest first. Only lengths decide, so ids never take part in the packing: pieces of
some bytes each are dealt by a hash of the row into groups of bounded size (at most GROUP_ROWS
documents on average), each group is packed on its own, and ids are cut where they were made. A
group leaves a few windows partly filled, which thousands of documents per group make negligible.

Null text counts as empty: one piece, the end id alone. Repeated rows, and rows that share a doc_id,
are documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_batches, cached, forget, free_name, table

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 16_384
CACHE = 800_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# The splitter's alphabet: printable bytes stand for themselves, the rest for characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
MARKS = frozenset(".,;:!?")


def in_alphabet(text: str) -> str:
    return text.encode().decode("latin-1").translate(_ALPHABET)


SPACE = in_alphabet(" ")


class Unsplit(Exception):
    """A segment beside a run of white space."""


class Segments(dict):
    """Ids of the segments met so far, each with the space before it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, segment: str) -> bytes:
        if not segment or segment[0].isspace() or segment[-1].isspace():
            raise Unsplit
        ids = self.encode(" " + segment)
        if len(self) >= CACHE:
            self.clear()
        self[segment] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    A byte-level tokenizer splits a text before a space that stands between two other characters, so
    the ids of a text are those of its space-separated segments, each with its space. Segments recur
    and are remembered, up to a bound. Texts with longer runs of white space, where that is not so,
    are encoded whole; so are all texts if the file has a normalizer or another splitter, and texts that
    hold the string of an added token. With `added_tokens` the string of a special token is that token, as
    the tokenizer has it by default; without, it is ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        self.splitter, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.by_segment = (
            self.tokenizer.normalizer is None and type(self.splitter).__name__ == "ByteLevel" and not self.splitter.add_prefix_space
        )
        self.segments = Segments(self.segment)
        self.tokens: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def token(self, token: str) -> bytes:
        """Ids of one token of the splitter, in the splitter's alphabet."""
        ids = self.tokens.get(token)
        if ids is None:
            ids = self.merged(token)
            if len(self.tokens) >= CACHE:
                self.tokens.clear()
            self.tokens[token] = ids
        return ids

    def merged(self, token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(token)]).tobytes()

    def segment(self, text: str) -> bytes:
        # A space and letters are one token, a closing mark after them another; the splitter, which
        # costs as much as the merges, is asked about everything else. Words are remembered as segments only.
        if text[0] == " ":
            word = text[1:]
            if word.isalpha():
                return self.merged(SPACE + (word if word.isascii() else in_alphabet(word)))
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.segments[word[:-1]] + self.token(word[-1])
        return b"".join(self.token(token) for token, _ in self.splitter.pre_tokenize_str(text))

    def __call__(self, text: str) -> bytes:
        if not self.by_segment or any(content in text for content in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            after = b"".join(map(self.segments.__getitem__, rest))
        except Unsplit:
            return self.whole(text)
        return self.segment(first) + after if first else after


_encoders: dict[tuple[str, bool], Encoder] = cached({})


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One per Python worker, which keeps nothing of a pipeline's earlier stages beside it."""
    forget(but=_encoders)
    if (path, added_tokens) not in _encoders:
        _encoders[path, added_tokens] = Encoder(path, added_tokens)
    return _encoders[path, added_tokens]


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
        path: str | None = None, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, piece_key and,
    if wanted, the ids. piece_key tells pieces of equal rows apart. `added_tokens`: see Encoder."""
    bounded_batches(docs.sparkSession)
    path, end = path or vocabulary_path(), np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added_tokens)
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for row, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    columns["row"].append(row)
                    columns["start"].append(start)
                    columns["length"].append(len(part) // 4)
                    columns["ids_crc32"].append(zlib.crc32(part))
                    columns["doc_tokens"].append(total)
                    if with_ids:
                        columns["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            out = {doc_id: batch.column(0).take(pa.array(columns["row"], pa.int64()))}
            out |= {n: pa.array(columns[n], pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")}
            if with_ids:
                out["ids"] = pa.array(columns["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(doc_id, text).mapInArrow(pieces, schema)


class Capacities:
    """Segment tree over remaining capacity; each leaf holds the open windows with that much left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least `need`, and that capacity."""
        node = need + self.size
        while not self.count[node]:
            # Up to the first subtree on the right, then down to its leftmost filled leaf.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.size
        found = self.open[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, found


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in decreasing order: the window each goes to, and its offset there."""
    tree, opened, windows, offsets = Capacities(window), 0, [], []
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, number = window, opened
            opened += 1
        else:
            capacity, number = found
        windows.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, number)
    return windows, offsets


def placed(pieces: pa.Table, base: int, doc_id: str, window: int) -> pa.Table:
    """The pieces of a group with sequence_id, from `base` on, and offset. The rows stay as they came, in their
    batches: a sorted copy would hold all ids twice, and leave as one batch."""
    keys = [("length", "descending"), (doc_id, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    order = pc.sort_indices(pieces.select([name for name, _ in keys]), sort_keys=keys).to_numpy()
    windows, offsets = best_fit(pieces["length"].to_numpy()[order].tolist(), window)
    sequence, offset = np.empty((2, len(order)), np.int64)
    sequence[order], offset[order] = np.array(windows, np.int64) + base, offsets
    return pieces.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, rows: int, doc_id: str = "doc_id", window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `window` ids; `rows` is how many documents
    they come from, which fixes the number of groups. Other columns go along."""
    groups = max(1, -(-rows // group_rows))
    group = free_name(pieces, "pack_group")
    names = pieces.columns

    def fill(pieces_: pa.Table) -> pa.Table:
        forget()  # the encoder too
        return placed(pieces_.select(names), pieces_[group][0].as_py() << 40, doc_id, window)

    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(doc_id, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(group).applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves: ids end to end, and where each document's piece begins."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.transform("parts", lambda p: F.struct(*[p[n].alias(n) for n in ("doc_id", "start", "length", "offset")])).alias("pieces"),
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(cut(docs, with_ids=False, added_tokens=True), docs.count())

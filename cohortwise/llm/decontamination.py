"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of some megabytes inside a task. Words that no benchmark item
has cannot be part of an occurrence, nor can a run of other words shorter than the shortest window;
what is left of the shard is indexed. Every window is found by backward search through wavelet
ranks, its occurrences are placed by sampled suffix positions, and overlapping spans are merged.
Documents never move: nothing is shuffled. The benchmark is read in blocks of at most BLOCK_WORDS
words, each broadcast and searched in a further pass of the same narrow stage.

Null texts have no words and no hits. Repeated rows are reported once each. Items without words have
no window; a null item id marks hits but is not listed. Other columns are ignored by `report` and
kept by `clean`, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .fm_index import FMIndex
from .shared import bounded_batches, forget, free_name, pieces, ranges, table, trim, utf8, words

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 4_000_000

INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
INSIDE[ord("A") : ord("Z") + 1] = True  # lower-cased before

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word", "word_end", "byte", "byte_end")]))
FOUND = [("n_words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType()))]
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "word_end", "byte", "byte_end")]))


class Windows:
    """The windows of a block of items as rows of symbols; symbol 0 stands for any other word."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        data, at = utf8(pa.array([text or "" for _, text in items], pa.large_string()))
        _, _, hashes, row = words(data, at, INSIDE)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n_words = np.bincount(row, minlength=len(items))
        first = np.cumsum(n_words) - n_words
        length = np.minimum(n_words, size)
        count = np.where(n_words > 0, n_words - length + 1, 0)
        begin = ranges(first, count)
        item, length = np.repeat(np.arange(len(items)), count), np.repeat(length, count)
        rows = np.zeros((len(begin), size), np.int64)
        for back in range(size):
            has = length > back
            rows[has, size - 1 - back] = symbols[(begin + length - 1 - back)[has]] + 1
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(axis=1)
        # Items of each distinct window.
        order = np.argsort(which, kind="stable")
        self.item = item[order]
        self.begin = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.shortest = int(self.lengths.min()) if len(self.rows) else 0


def occurrences(data: np.ndarray, at: np.ndarray, windows: Windows):
    """Per row of text: its words, the merged spans of words inside a window, the items found."""
    begin, end, hashes, row = words(data, at, INSIDE)
    n_rows = len(at) - 1
    n_words = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n_words) - n_words
    nothing = np.zeros(0, np.int64)
    if not len(windows.rows) or not len(begin):
        return n_words, (nothing,) * 3, begin, end, first, (nothing, nothing)
    place = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    symbol = np.where(windows.vocabulary[place] == hashes, place + 1, 0)
    # Runs of known words within one row; those shorter than every window hold no occurrence.
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] == 0) | (symbol[:-1] == 0) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(symbol)))
    long = (symbol[starts] > 0) & (sizes >= windows.shortest)
    starts, sizes = starts[long], sizes[long]
    if not len(starts):
        return n_words, (nothing,) * 3, begin, end, first, (nothing, nothing)
    # The shard's text: each run, then a separator. `source` leads back to the words.
    source = ranges(starts, sizes + 1)
    text = symbol[np.minimum(source, len(symbol) - 1)]
    text[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(text, len(windows.vocabulary) + 1)
    low, high = index.search(windows.rows, windows.lengths)
    position, window = index.locate(low, high)
    word = source[position]
    # Merge: how many occurrences cover each word.
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + windows.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.ones(len(hit) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
    edges = np.flatnonzero(edge)
    taken = hit[edges[:-1]]
    span, span_end = edges[:-1][taken], edges[1:][taken]
    listed = windows.begin[window + 1] - windows.begin[window]
    pairs = np.repeat(row[word], listed) * len(windows.ids) + windows.item[ranges(windows.begin[window], listed)]
    pairs = np.unique(pairs)
    return n_words, (span, span_end, row[span]), begin, end, first, (pairs // len(windows.ids), pairs % len(windows.ids))


def _block_scan(text: str, found: list[str], broadcast, shard_bytes: int):
    """mapInArrow function: adds one block's spans and items to the columns `found`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        windows = broadcast.value
        for batch in batches:
            for piece in pieces(batch, text, shard_bytes):
                data, at = utf8(piece.column(text))
                n_words, (span, span_end, span_row), begin, end, first, (item_row, item) = occurrences(data, at, windows)
                spans: list[list] = [list(x) if x else [] for x in piece.column(found[1]).to_pylist()]
                items: list[list] = [list(x) if x else [] for x in piece.column(found[2]).to_pylist()]
                for s, e, r in zip(span.tolist(), span_end.tolist(), span_row.tolist()):
                    spans[r].append({
                        "word": s - int(first[r]), "word_end": e - int(first[r]),
                        "byte": int(begin[s] - at[r]), "byte_end": int(end[e - 1] - at[r]),
                    })
                for r, i in zip(item_row.tolist(), item.tolist()):
                    items[r].append(windows.ids[i])
                out = {name: piece.column(k) for k, name in enumerate(piece.schema.names)}
                out |= dict(zip(found, (pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())))))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return scan


def merged(spans: list[dict]) -> list[list[int]]:
    """Spans of one document in order, overlapping ones as one."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["word"], s["word_end"])):
        if out and s["word"] < out[-1][1]:
            if s["word_end"] > out[-1][1]:
                out[-1][1], out[-1][3] = s["word_end"], s["byte_end"]
        else:
            out.append([s["word"], s["word_end"], s["byte"], s["byte_end"]])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator()
    for item, words_ in rows:
        cost = len(words_ or "") // 2 + 1
        if block and size + cost > limit:
            yield block
            block, size = [], 0
        block.append((item, words_))
        size += cost
    yield block


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         size: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS, then=None) -> tuple[DataFrame, list[str]]:
    """The documents with three more columns (whose names are returned): number of words, spans
    inside benchmark windows (one list per block, not yet merged across blocks), item ids found.

    `then` makes of these names a function over batches and its schema, which follows the search of the last
    block in the same Python worker."""
    spark = bounded_batches(docs.sparkSession)
    found: list[str] = []
    for name, kind in FOUND:
        found.append(free_name(docs, name))
        docs = docs.withColumn(found[-1], F.lit(None).cast(kind))
    scans = []
    for block in _blocks(benchmark, item_id, item_text, block_words):
        scans.append(_block_scan(text, found, spark.sparkContext.broadcast(Windows(block, size)), shard_bytes))
    for scan in scans[:-1]:
        docs = docs.mapInArrow(scan, docs.schema)
    last, schema = scans[-1], docs.schema
    if then is not None:
        finish, schema = then(found)
        scan, last = last, lambda batches: finish(scan(batches))
    return docs.mapInArrow(last, schema), found


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: its words, words inside a window, items found and their digest."""
    docs, found = find(docs.select(doc_id, text), benchmark, text, **options)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x) if x else [] for x in batch.column(found[1]).to_pylist()]
            items = [sorted({i for i in x or [] if i is not None}) for x in batch.column(found[2]).to_pylist()]
            n_hit = [sum(end - word for word, end, _, _ in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                 pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=[doc_id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, found[0], found[1], found[2]).mapInArrow(
        summary, f"`{doc_id}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, same columns, with every span cut out of the text and a space in its place.

    Documents without a hit are returned as they are; one of which no word is left is removed.
    """
    names, kinds = docs.columns, docs.schema

    def cutter(found: list[str]):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = batch.column(text).to_pylist(), []
                for r, (spans, n) in enumerate(zip(batch.column(found[1]).to_pylist(), batch.column(found[0]).to_pylist())):
                    spans = merged(spans) if spans else []
                    keep.append(not spans or sum(s[1] - s[0] for s in spans) < n)
                    if spans:
                        raw, at, kept = texts[r].encode(), 0, []
                        for _, _, begin, end in spans:
                            kept.append(raw[at:begin])
                            at = end
                        texts[r] = b" ".join([*kept, raw[at:]]).decode()
                columns = [pa.array(texts, batch.column(text).type) if n == text else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))
            trim()

        return cut, kinds

    return find(docs, benchmark, text, then=cutter, **options)[0]


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

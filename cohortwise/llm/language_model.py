"""A hierarchical Pitman-Yor language model of word pairs, fitted by Gibbs sampling over all documents.

Every context, a word that others follow, has a restaurant whose customers are the words that follow it;
all share the root restaurant as parent, and its own parent is even over the V known words and the unknown
one. A customer sits at a table of its word or opens a new one; each table is a customer of the parent.
With c customers of a word, t of its tables, T tables and C customers in all, discount d and strength s, the
predictive probability is (c - d t + (s + d T) parent) / (s + C).

A sweep seats the customers of every restaurant by the Chinese restaurant process given its parent: one
after another at first, the later ones in blocks of an eighth of those seated, of which the part that opens no table sits
together; then REMOVALS customers of every word, drawn anew each time, are taken out and seated again given
all others, all words of a restaurant at once. A word has as many customers in the root as tables in all
contexts; the root is then seated in the same way, and gives the next sweep its parent probabilities. The
first sweep has the even distribution as parent. A text's score adds up the decimal logarithms of the
probabilities averaged over the sweeps after BURN_IN.

How it runs. Documents are cut into chunks of about CHUNK_TOKENS tokens, in whole documents; a chunk knows its distinct words and
pairs, with their counts in the training documents. Words go to root buckets by ranges of their hash, which
number them; pairs go to pair buckets by the hash of the context, and contexts of more than PART_TOKENS
customers over several, so no word or context lies in one task. Per sweep a pair bucket sends, for each of
its words, how many tables it has, and gets back the root's customers and tables of these words and, of
contexts that lie in several buckets, their tables in all. Seats are never stored: a task draws them again
from the seed of sweep and bucket, so an executor that is lost changes nothing. The driver gets totals only.
Everything counted covers all documents and grows with them; words are told apart by 64-bit hashes.

Tokens are runs of bytes other than ASCII white space, with A-Z lower-cased, then one end; the first token's
context is the end. Null and empty texts have the end alone. Repeated rows are documents of their own; a null id is
the empty one. Without training documents every probability is 1 / (V + 1) with V = 0. An empty table gives
no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import WHITE, Staged, bounded_batches, mix, pieces, release, table, trim, utf8, words

CHUNK_TOKENS = 1 << 20
ROOT_WORDS = 1 << 20
BUCKET_PAIRS = 1 << 20
PART_TOKENS = 1 << 18
ROOT, CONTEXT = (0.6, 1.0), (0.75, 1.0)  # discount and strength
BURN_IN, SAMPLES, REMOVALS = 1, 3, 4
BLOCKS = 8
SEED = 11
MODULUS, HELD_OUT = 7, 2
END = np.uint64(0xE0D0E0D0E0D0E0D1)

_zstd = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """The array, its bytes sorted by place and compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (_zstd.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_zstd.decompress(data[8:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT


# Seating -----------------------------------------------------------------------------------------


def _choose(weight: np.ndarray, start: np.ndarray, end: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One position of each range, in proportion to the weights."""
    total = np.concatenate([[0.0], np.cumsum(weight)])
    at = np.searchsorted(total, total[start] + rng.random(len(start)) * (total[end] - total[start]), side="right") - 1
    at = np.clip(at, start, end - 1)
    for _ in range(2):  # rounding may lead to a neighbour without weight
        at = np.where(weight[at] > 0, at, np.maximum(at - 1, start))
    return at


def seat(count: np.ndarray, context: np.ndarray, parent: np.ndarray, tables: np.ndarray, fixed: np.ndarray,
         discount: float, strength: float, rng: np.random.Generator, removals: int = REMOVALS) -> np.ndarray:
    """Tables of each (context, word) with `count` customers and the word's `parent` probability.

    `tables` are those of each context and are kept up to date unless `fixed`."""
    taken = np.minimum(count, 1)
    tables = np.where(fixed, tables, np.bincount(context, taken, len(tables))).astype(np.float64)
    many = np.flatnonzero(count > 1)
    if not len(many):
        return taken
    many = many[np.argsort(-count[many], kind="stable")]
    c, ctx, p = count[many].astype(np.int64), context[many], parent[many]
    free = ~fixed[ctx]
    t = np.ones(len(c), np.int64)

    def move(change: np.ndarray, n: int) -> None:
        if change.any():
            np.add.at(tables, ctx[:n][free[:n]], change[free[:n]])

    # Tables are kept in the order of their words; words with more customers come first.
    owner, size = np.arange(len(c)), np.ones(len(c), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    seated = 1
    while True:
        n = int(np.searchsorted(-c, -seated, side="left"))  # words with customers left
        cut = int(np.searchsorted(owner, n))
        done.append((owner[cut:], size[cut:]))
        owner, size = owner[:cut], size[:cut]
        if not n:
            break
        block = np.minimum(max(1, seated // BLOCKS), c[:n] - seated)
        fresh = (strength + discount * tables[ctx[:n]]) * p[:n]
        new = rng.binomial(block, fresh / (fresh + seated - discount * t[:n]))
        edge = np.searchsorted(owner, np.arange(n + 1))
        joined = _choose(size - discount, edge[:-1], edge[1:], rng)
        size[joined] += block - new
        t[:n] += new
        move(new, n)
        at = np.repeat(edge[1:], new)
        owner, size = np.insert(owner, at, np.repeat(np.arange(n), new)), np.insert(size, at, 1)
        seated += max(1, seated // BLOCKS)
    owner, size = (np.concatenate([d[k] for d in reversed(done)]) for k in (0, 1))
    everyone = np.arange(len(c))
    for _ in range(removals):
        edge = np.searchsorted(owner, np.arange(len(c) + 1))
        left = _choose(size.astype(np.float64), edge[:-1], edge[1:], rng)
        size[left] -= 1
        empty = size[left] == 0
        t -= empty
        move(-empty.astype(np.int64), len(c))
        fresh = (strength + discount * tables[ctx]) * p
        opens = rng.random(len(c)) * (fresh + c - 1 - discount * t) < fresh
        joined = _choose(np.where(size > 0, size - discount, 0.0), edge[:-1], edge[1:], rng)
        # A new table takes the place of the one that fell empty.
        at = np.where(opens, left, joined)
        grows = opens & ~empty
        size[at[~grows]] += 1
        t += opens
        move(opens.astype(np.int64), len(c))
        owner, size = np.insert(owner, edge[1:][grows], everyone[grows]), np.insert(size, edge[1:][grows], 1)
        owner, size = owner[size > 0], size[size > 0]
    out = taken.copy()
    out[many] = t
    return out


# Chunks of documents ------------------------------------------------------------------------------

# Two rows per chunk: its documents (kind 0), and its distinct words and pairs (kind 1).
_CHUNK = "kind int, chunk long, ids array<{kind}>, trained array<boolean>, sizes binary, tokens binary, n_words long, words binary, counts binary, n_pairs long, first binary, second binary, seen binary"


def _chunks(id_type: pa.DataType):
    names = ["kind", "chunk", "ids", "trained", "sizes", "tokens", "n_words", "words", "counts", "n_pairs", "first", "second", "seen"]
    kinds = [pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list = []
        trained: list[bool] = []

        def flush() -> pa.RecordBatch:
            size = np.concatenate([s for _, s in held])
            vocabulary, token = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            train = np.repeat(np.array(trained, bool), size)
            counts = np.bincount(token[train], minlength=len(vocabulary))
            # The context of a document's first token is the end.
            before = np.empty(len(token), np.int64)
            before[1:] = token[:-1]
            before[0] = np.searchsorted(vocabulary, END)
            pairs, pair = np.unique(before * len(vocabulary) + token, return_inverse=True)
            seen = np.bincount(pair[train], minlength=len(pairs))
            first, second = pairs // len(vocabulary), pairs % len(vocabulary)
            chunk, n_pairs = (part << 32) + number, len(pairs)
            texts = [0, chunk, list(ids), list(trained), pack(size.astype(np.int64)), pack(pair.astype(np.int32)), None, None, None, n_pairs, None, None, None]
            found = [1, chunk, None, None, None, None, len(vocabulary), pack(vocabulary), pack(counts.astype(np.int64)), n_pairs,
                     pack(np.diff(first, prepend=0).astype(np.int32)), pack(second.astype(np.int32)), pack(seen.astype(np.int64))]
            for x in (held, ids, trained):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([a, b], k) for a, b, k in zip(texts, found, kinds)], names=names)

        n = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = utf8(piece.column("text"))
                _, _, hashes, row = words(data, at, ~WHITE)
                size = np.bincount(row, minlength=piece.num_rows) + 1
                ends = np.cumsum(size) - 1
                tokens = np.full(int(size.sum()), END, np.uint64)
                inside = np.ones(len(tokens), bool)
                inside[ends] = False
                tokens[inside] = hashes
                held.append((tokens, size))
                ids.extend(piece.column("id").to_pylist())
                trained.extend(piece.column("trained").to_pylist())
                n += len(tokens)
                if n >= CHUNK_TOKENS:
                    yield flush()
                    number, n = number + 1, 0
        if held:
            yield flush()
        trim()

    return cut


def _root_edges(buckets: int) -> list[np.uint64]:
    return [np.uint64((b << 64) // buckets) for b in range(1, buckets)]


def _sent_words(buckets: int):
    """mapInArrow function: each chunk's words and training counts, by ranges of the hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocabulary, counts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "words", "counts"))):
                vocabulary, counts = unpack(vocabulary, np.uint64), unpack(counts, np.int64)
                at = [0, *np.searchsorted(vocabulary, _root_edges(buckets)).tolist(), len(vocabulary)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(buckets), pa.int64()), pa.array([chunk] * buckets, pa.int64()),
                     *(pa.array([pack(x[i:j]) for i, j in zip(at, at[1:])], pa.binary()) for x in (vocabulary, counts))],
                    names=["root", "chunk", "words", "counts"])

    return send


def _numbered(buckets: int):
    """applyInArrow function over a root bucket: the words' ids and counts for every chunk that asked.

    Known words are numbered from 1, frequent ones first, the buckets taking turns; unknown ones are 0."""

    def number(parts: pa.Table) -> pa.Table:
        root = parts["root"][0].as_py()
        hashes = [unpack(x, np.uint64) for x in parts["words"].to_pylist()]
        counts = np.concatenate([unpack(x, np.int64) for x in parts["counts"].to_pylist()])
        vocabulary, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(vocabulary), np.int64)
        np.add.at(total, at, counts)
        known = total > 0
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(vocabulary))
        ids = np.where(known, 1 + rank * buckets + root, 0)
        edges = np.cumsum([0, *map(len, hashes)])
        once = np.arange(len(hashes)) == 0
        return pa.table({
            "chunk": parts["chunk"], "root": parts["root"],
            "ids": pa.array([pack(ids[at[i:j]]) for i, j in zip(edges, edges[1:])], pa.binary()),
            "totals": pa.array([pack(total[at[i:j]]) for i, j in zip(edges, edges[1:])], pa.binary()),
            "known": pa.array(once * int(known.sum())), "trained": pa.array(once * int(total.sum()))})

    return number


_SENT = "bucket long, chunk long, places binary, contexts binary, customers binary, first binary, second binary, seen binary"


def _sent_pairs(buckets: int):
    """applyInArrow function over a chunk's pairs and the ids of its words: its pairs for each pair bucket;
    for the bucket -1 the training count of each pair's word."""

    def send(chunks: pa.Table, named: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "places", "contexts", "customers", "first", "second", "seen")}
        if chunks.num_rows:
            row = chunks.to_pylist()[0]
            parts = sorted(named.select(["root", "ids", "totals"]).to_pylist(), key=lambda r: r["root"])
            ids, totals = (np.concatenate([unpack(r[k], np.int64) for r in parts]) for k in ("ids", "totals"))
            first, second = np.cumsum(unpack(row["first"], np.int32), dtype=np.int64), unpack(row["second"], np.int32)
            seen = unpack(row["seen"], np.int64)
            context, word = ids[first], ids[second]
            share = np.where(context == 0, buckets, -(-totals[first] // PART_TOKENS)).astype(np.uint64)
            part = mix(word.astype(np.uint64) + np.uint64(77)) % np.maximum(share, np.uint64(1))
            bucket = (mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                places = order[edges[b] : edges[b + 1]]
                if len(places):
                    contexts, own = np.unique(context[places], return_inverse=True)
                    customers = np.zeros(len(contexts), np.int64)
                    customers[own] = np.where(context[places] > 0, totals[first[places]], 0)
                    for k, v in zip(out, (b, row["chunk"], pack(np.diff(places, prepend=0).astype(np.int32)), pack(contexts), pack(customers),
                                          pack(own.astype(np.int32)), pack(word[places]), pack(seen[places]))):
                        out[k].append(v)
            for k, v in zip(out, (-1, row["chunk"], b"", b"", b"", b"", pack(totals[second]), b"")):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        trim()
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return send


_PAIRS = "bucket long, contexts binary, customers binary, words binary, first binary, second binary, count binary, chunks array<long>, places array<binary>, pairs array<binary>"


def _merged(roots: int):
    """applyInArrow function over a pair bucket: its distinct pairs with their counts, and where each chunk's
    pairs are among them. Words are in the order of the root buckets they belong to."""

    def merge(parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        contexts = [unpack(r["contexts"], np.int64) for r in rows]
        own = [unpack(r["first"], np.int32) for r in rows]
        first = np.concatenate([c[o] for c, o in zip(contexts, own)])
        vocabulary, second = np.unique(np.concatenate([unpack(r["second"], np.int64) for r in rows]), return_inverse=True)
        names, place = np.unique(np.concatenate(contexts), return_index=True)
        customers = np.concatenate([unpack(r["customers"], np.int64) for r in rows])[place]
        key = np.searchsorted(names, first) * len(vocabulary) + second
        pairs, pair = np.unique(key, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, pair, np.concatenate([unpack(r["seen"], np.int64) for r in rows]))
        by_root = np.lexsort((vocabulary, (vocabulary - 1) % roots))
        rank = np.empty(len(vocabulary), np.int64)
        rank[by_root] = np.arange(len(vocabulary))
        edges = np.cumsum([0, *map(len, own)])
        trim()
        return pa.table({
            "bucket": parts["bucket"].slice(0, 1), "contexts": pa.array([pack(names)]), "customers": pa.array([pack(customers)]), "words": pa.array([pack(vocabulary[by_root])]),
            "first": pa.array([pack(np.diff(pairs // len(vocabulary), prepend=0).astype(np.int32))]), "second": pa.array([pack(rank[pairs % len(vocabulary)].astype(np.int32))]),
            "count": pa.array([pack(count)]), "chunks": pa.array([[r["chunk"] for r in rows]], pa.list_(pa.int64())),
            "places": pa.array([[r["places"] for r in rows]], pa.list_(pa.binary())),
            "pairs": pa.array([[pack(pair[i:j].astype(np.int32)) for i, j in zip(edges, edges[1:])]], pa.list_(pa.binary()))})

    return merge


# Sweeps -------------------------------------------------------------------------------------------


class Totals:
    """What the driver knows of a sweep: words, training tokens, root customers and tables."""

    def __init__(self, known: int, tokens: int, customers: int = 0, tables: int = 0):
        self.known, self.tokens, self.customers, self.tables = known, tokens, customers, tables

    def even(self) -> float:
        return 1 / (self.known + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's predictive probability of words with so many customers and tables."""
        discount, strength = ROOT
        return (customers - discount * tables + (strength + discount * self.tables) * self.even()) / (strength + self.customers)


class Bucket:
    """A pair bucket's restaurants, or the part of them that lies in it."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.contexts, self.customers, self.words = (unpack(row[k], np.int64) for k in ("contexts", "customers", "words"))
        self.first, self.second = np.cumsum(unpack(row["first"], np.int32), dtype=np.int64), unpack(row["second"], np.int32)
        self.count = unpack(row["count"], np.int64)
        self.split = (self.customers > PART_TOKENS) & (self.contexts > 0)

    def answers(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The root's customers and tables of each word, and the tables of the split contexts."""
        found = [np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64), np.zeros(len(self.contexts), np.int64)]
        known = np.flatnonzero(self.words > 0)
        split = self.split_order(rows[0]["roots"]) if rows else []
        for at, k, into in ((known, "customers", found[0]), (known, "tables", found[1]), (split, "split", found[2])):
            if rows:
                into[at] = np.concatenate([unpack(r[k], np.int64) for r in sorted(rows, key=lambda r: r["root"])])
        return tuple(found)

    def split_order(self, roots: int) -> np.ndarray:
        at = np.flatnonzero(self.split)
        return at[np.lexsort((self.contexts[at], (self.contexts[at] - 1) % roots))]

    def seats(self, sweep: int, parent: np.ndarray, split_tables: np.ndarray | None) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64([SEED, sweep, self.number]))
        fixed = self.split if split_tables is not None else np.zeros(len(self.contexts), bool)
        tables = split_tables if split_tables is not None else np.zeros(len(self.contexts), np.int64)
        return seat(self.count, self.first, parent[self.second], tables, fixed, *CONTEXT, rng)

    def probability(self, seats: np.ndarray, parent: np.ndarray, split_tables: np.ndarray) -> np.ndarray:
        discount, strength = CONTEXT
        tables = np.where(self.split, split_tables, np.bincount(self.first, seats, len(self.contexts)))
        back = strength + discount * tables[self.first]
        return (self.count - discount * seats + back * parent[self.second]) / (strength + self.customers[self.first])


def _states(bucket: Bucket, answers: list[dict], totals: list[Totals], last: int):
    """(seats, parent before, parent after, split tables after) of every sweep up to `last`, as far as known."""
    by_sweep = {s: [r for r in answers if r["sweep"] == s] for s in range(last)}
    parent, split = np.full(len(bucket.words), totals[0].even()), None
    for sweep in range(last + 1):
        yield sweep, parent, split
        if sweep < last:
            customers, tables, split = bucket.answers(by_sweep[sweep])
            parent = totals[sweep + 1].parent(customers, tables)


_TABLES = "root long, bucket long, words binary, tables binary, contexts binary, split binary"


def _swept(sweep: int, totals: list[Totals], roots: int):
    """Cogroup function over a pair bucket and the root's answers: the tables of each of its words and split
    contexts, for every root bucket."""

    def sweep_(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("root", "bucket", "words", "tables", "contexts", "split")}
        for row in pairs.to_pylist():
            bucket = Bucket(row)
            *_, (_, parent, split) = _states(bucket, answers.to_pylist(), totals, sweep)
            seats = bucket.seats(sweep, parent, split)
            tables = np.bincount(bucket.second, seats, len(bucket.words)).astype(np.int64)
            own = np.bincount(bucket.first, seats, len(bucket.contexts)).astype(np.int64)
            known, order = np.flatnonzero(bucket.words > 0), bucket.split_order(roots)
            at = np.searchsorted((bucket.words[known] - 1) % roots, np.arange(roots + 1))
            split_at = np.searchsorted((bucket.contexts[order] - 1) % roots, np.arange(roots + 1))
            for r in range(roots):
                w, s = known[at[r] : at[r + 1]], order[split_at[r] : split_at[r + 1]]
                for k, v in zip(out, (r, bucket.number, pack(bucket.words[w]), pack(tables[w]), pack(bucket.contexts[s]), pack(own[s]))):
                    out[k].append(v)
        trim()
        return pa.table([pa.array(v, pa.int64() if k in ("root", "bucket") else pa.binary()) for k, v in out.items()], names=list(out))

    return sweep_


_ANSWERS = "sweep long, bucket long, root long, roots long, customers binary, tables binary, split binary, all_customers long, all_tables long"


def _answered(sweep: int, before: Totals, roots: int):
    """applyInArrow function over a root bucket: seats its customers, answers every pair bucket."""

    def answer(parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        ids, asked = ([unpack(r[k], np.int64) for r in rows] for k in ("words", "contexts"))
        own, split = ([unpack(r[k], np.int64) for r in rows] for k in ("tables", "split"))
        root = rows[0]["root"]
        words_, at = np.unique(np.concatenate(ids), return_inverse=True)
        customers = np.zeros(len(words_), np.int64)
        np.add.at(customers, at, np.concatenate(own))
        rng = np.random.Generator(np.random.PCG64([SEED, sweep, root, 1]))
        zero = np.zeros(len(words_), np.int64)
        # The root's tables in all are those of the sweep before; at first every word has one.
        tables = seat(customers, zero, np.full(len(words_), before.even()), np.array([before.tables or before.known]), np.ones(1, bool), *ROOT, rng)
        contexts, where = np.unique(np.concatenate(asked), return_inverse=True)
        in_all = np.zeros(len(contexts), np.int64)
        np.add.at(in_all, where, np.concatenate(split))
        edges, split_edges = np.cumsum([0, *map(len, ids)]), np.cumsum([0, *map(len, asked)])
        cut = lambda x, at, e: pa.array([pack(x[at[i:j]]) for i, j in zip(e, e[1:])], pa.binary())
        once = np.arange(len(rows)) == 0
        return pa.table({
            "sweep": pa.array([sweep] * len(rows), pa.int64()), "bucket": parts["bucket"], "root": parts["root"], "roots": pa.array([roots] * len(rows), pa.int64()),
            "customers": cut(customers, at, edges), "tables": cut(tables.astype(np.int64), at, edges), "split": cut(in_all, where, split_edges),
            "all_customers": pa.array(once * int(customers.sum())), "all_tables": pa.array(once * int(tables.sum()))})

    return answer


def _predicted(totals: list[Totals], burn_in: int, samples: int):
    """Cogroup function over a pair bucket and all answers: the logarithm of each pair's probability, averaged
    over the sampled sweeps, for every chunk that has it."""
    last = burn_in + samples

    def predict(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        chunks, places, values = [], [], []
        for row in pairs.to_pylist():
            bucket = Bucket(row)
            mean, before = np.zeros(len(bucket.count)), None
            for sweep, parent, split in _states(bucket, answers.to_pylist(), totals, last):
                if before is not None and sweep > burn_in:
                    seats = bucket.seats(sweep - 1, *before)
                    mean += bucket.probability(seats, parent, split)
                before = (parent, split)
            value = np.log10(mean / samples).astype(np.float32)
            for chunk, place, pair in zip(row["chunks"], row["places"], row["pairs"]):
                chunks.append(chunk)
                places.append(place)
                values.append(pack(value[unpack(pair, np.int32)]))
        trim()
        return pa.table([pa.array(chunks, pa.int64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["chunk", "places", "value"])

    return predict


def _scored(id_type: pa.DataType, totals: Totals):
    """Cogroup function over a chunk and its pairs' probabilities: a row per document."""

    def add(chunks: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        for row in chunks.to_pylist():
            parts = found.to_pylist()
            n = row["n_pairs"]
            value, count = np.zeros(n), np.zeros(n, np.int64)
            for r in parts:
                if r["places"]:
                    value[np.cumsum(unpack(r["places"], np.int32))] = unpack(r["value"], np.float32)
                else:
                    count = unpack(r["value"], np.int64)
            size, token = unpack(row["sizes"], np.int64), unpack(row["tokens"], np.int32)
            start = np.cumsum(size) - size
            base = np.log10((count + 1) / (totals.tokens + totals.known + 1))
            sums = lambda x: np.add.reduceat(x[token], start) if len(token) else np.zeros(0)
            for into, values in zip(out, (row["ids"], [not t for t in row["trained"]], size, sums((count > 0).astype(np.int64)), sums(base), sums(value))):
                into.extend(values)
        kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        trim()
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return add


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: Column | None = None,
          burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; the model learns
    from those that are not `held` out."""
    spark = bounded_batches(docs.sparkSession)
    staged = Staged(spark, "language-model")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (~(held_out(doc_id) if held is None else held)).alias("trained"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    if kind != "string":
        rows, kind = rows.withColumn("id", F.col("id").cast("long")), "bigint"
    texts, chunks = staged.write_parts(rows.mapInArrow(_chunks(id_type), _CHUNK.format(kind=kind)), "chunks", "kind", [0, 1])
    n_words, n_pairs = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0))).collect()[0]
    roots, buckets = max(1, -(-n_words // ROOT_WORDS)), max(1, -(-n_pairs // BUCKET_PAIRS))

    sent = chunks.select("chunk", "words", "counts").mapInArrow(_sent_words(roots), "root long, chunk long, words binary, counts binary")
    named = staged.write(sent.groupBy("root").applyInArrow(_numbered(roots), "chunk long, root long, ids binary, totals binary, known long, trained long"), "named")
    known, tokens = named.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).collect()[0]
    totals = [Totals(known, tokens)]

    own = chunks.select("chunk", "first", "second", "seen").groupBy("chunk")
    sent = staged.write(own.cogroup(named.groupBy("chunk")).applyInArrow(_sent_pairs(buckets), _SENT), "sent")
    staged.drop(named, chunks)
    pairs = staged.write(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_merged(roots), _PAIRS), "pairs")
    counted = staged.write(sent.where("bucket < 0").select("chunk", F.lit(b"").alias("places"), F.col("second").alias("value")), "counted")
    staged.drop(sent)
    release(spark)

    restaurants = pairs.drop("chunks", "places", "pairs")
    answers, kept = spark.createDataFrame([], _ANSWERS), []
    for sweep in range(burn_in + samples):
        tables = restaurants.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_swept(sweep, totals, roots), _TABLES)
        found = staged.write(tables.groupBy("root").applyInArrow(_answered(sweep, totals[-1], roots), _ANSWERS), "answers")
        sums = found.agg(F.coalesce(F.sum("all_customers"), F.lit(0)), F.coalesce(F.sum("all_tables"), F.lit(0))).collect()[0]
        totals.append(Totals(known, tokens, *sums))
        answers = answers.union(found)
        kept.append(found)
    predicted = pairs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        _predicted(totals, burn_in, samples), "chunk long, places binary, value binary")
    predicted = staged.write(predicted, "predicted")
    staged.drop(pairs, *kept)
    release(spark)
    texts = texts.select("chunk", "ids", "trained", "sizes", "tokens", "n_pairs").groupBy("chunk")
    out = texts.cogroup(predicted.union(counted).groupBy("chunk")).applyInArrow(
        _scored(id_type, totals[0]), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op12_language_model(spark, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

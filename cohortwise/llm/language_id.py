"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a sample of labelled text knows every substring of that sample. A
document is parsed against each automaton greedily: the longest match from a place is one phrase, and
the next phrase begins where it ends. Text of a language needs few, long phrases against its own
sample. Phrases cost about log2(sample length) bits each; the language with the fewest bits per byte
of the document wins.

The fit takes a sample bounded by two documented parameters: at most about SAMPLE_DOCS documents per
language, chosen by a hash of doc_id among those that may be learned from, and SAMPLE_BYTES bytes of
them, a run of each at a hashed offset of its text. Counts of documents per language, which set the share to take, cover all rows. Prediction
processes whole texts, cut into lanes of LANE bytes that are parsed side by side (a phrase does not go
past the end of its lane); all documents of a batch and all languages advance together, one byte a
step, through transition tables.

Text is read as UTF-8 with A-Z lower-cased; all digits are one symbol, all white space another. Null
texts, and texts without a letter, are `und` with score 0. If nothing can be learned every row is
`und`. Equal costs go to the language that sorts first. Score is how much fewer bits the winner needs
than the runner-up, from 0 to 1 (1 if there is one language only). Repeated rows are predicted each.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import bounded_batches, cached, free_name, pieces, table, utf8

SAMPLE_DOCS = 200
SAMPLE_BYTES = 48_000
LANE = 512
UNDETERMINED = "und"
HELD_OUT = 2

LETTER = re.compile(r"[^\W\d_]")
CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("A") : ord("Z") + 1] += 32
CLASS[ord("0") : ord("9") + 1] = ord("0")
CLASS[[*range(0x09, 0x0E), 0x20]] = ord(" ")


def automaton(text: list[int], n_symbols: int) -> np.ndarray:
    """Transition table of the suffix automaton of a list of symbols: state x symbol to state, state
    1 being the start and 0 none."""
    follow: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    last = 1
    for symbol in text:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at and symbol not in follow[at]:
            follow[at][symbol] = now
            at = link[at]
        if not at:
            link[now] = 1
        else:
            to = follow[at][symbol]
            if length[at] + 1 == length[to]:
                link[now] = to
            else:
                clone = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at and follow[at].get(symbol) == to:
                    follow[at][symbol] = clone
                    at = link[at]
                link[to] = link[now] = clone
        last = now
    out = np.zeros((len(follow), n_symbols), np.int32)
    for state, step in enumerate(follow):
        out[state, list(step)] = list(step.values())
    return out


class Parser:
    """The automata of all languages in one table, and the symbols they share."""

    def __init__(self, samples: dict[str, list[str]], sample_bytes: int = SAMPLE_BYTES):
        self.languages = sorted(samples)
        texts = []
        for language in self.languages:
            share = max(1, sample_bytes // max(1, len(samples[language])))
            # Every sampled document gives a share; what short ones leave goes to the others.
            raw = [CLASS[np.frombuffer(t.encode(), np.uint8)] for t in samples[language]]
            while sum(min(len(r), share) for r in raw) < min(sample_bytes, sum(map(len, raw))):
                share += max(1, share // 4)
            texts.append([r[(at := zlib.crc32(r.tobytes()) % max(1, len(r) - share + 1)) : at + share] for r in raw])
        seen = np.unique(np.concatenate([r for t in texts for r in t] + [np.zeros(0, np.uint8)]))
        self.symbol = np.zeros(256, np.int64)  # 0: met in no sample
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[CLASS]
        self.n_symbols = len(seen) + 2  # the last one separates sampled documents
        tables, self.start, self.bits, size = [], [], [], 0
        for parts in texts:
            text: list[int] = []
            for part in parts:
                text += self.symbol[part].tolist() + [self.n_symbols - 1]
            one = automaton(text, self.n_symbols)
            tables.append(np.where(one > 0, one + size, 0))
            self.start.append(size + 1)
            self.bits.append(np.log2(len(text) + 2))
            size += len(one)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.bits = np.array(self.bits)

    def costs(self, data: np.ndarray, at: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Bits per byte of each row of text under each language."""
        sizes = np.diff(at)
        lanes = -(-sizes // lane)
        row = np.repeat(np.arange(len(sizes)), lanes)
        begin = at[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        length = np.minimum(begin + lane, at[1:][row]) - begin
        by = np.argsort(-length, kind="stable")  # long lanes first: those that go on are a prefix
        begin, length, row = begin[by], length[by], row[by]
        symbols = self.symbol[data]
        phrases = np.zeros((len(self.languages), len(sizes)), np.int64)
        going = np.searchsorted(-length, -np.arange(1, lane + 1), side="right")
        for k, start in enumerate(self.start):
            state = np.zeros(len(begin), np.int64)  # no phrase yet: the first byte begins one
            count = np.zeros(len(begin), np.int64)
            root = self.table[start * self.n_symbols : (start + 1) * self.n_symbols]
            for step, n in enumerate(going.tolist()):
                if not n:
                    break
                symbol = symbols[begin[:n] + step]
                to = self.table[state[:n] * self.n_symbols + symbol]
                stuck = np.flatnonzero(to == 0)
                # A phrase ends before this byte and the next begins with it. A byte that the
                # sample lacks leads to state 0, from where every byte begins a phrase.
                count[stuck] += 1
                to[stuck] = root[symbol[stuck]]
                state[:n] = to
            np.add.at(phrases[k], row, count)
        return (phrases * self.bits[:, None] / np.maximum(sizes, 1)).T

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the winner and its score, per row of text."""
        costs = self.costs(data, at)
        best = costs.argmin(axis=1)
        if len(self.languages) == 1:
            return best, np.ones(len(best))
        two = np.partition(costs, 1, axis=1)[:, :2]
        return best, np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0, 1)


_parsers: dict[str, Parser] = cached({})


def parser(samples: str) -> Parser:
    """One per Python worker and sample."""
    name = hashlib.sha256(samples.encode()).hexdigest()
    if name not in _parsers:
        _parsers.clear()
        _parsers[name] = Parser(json.loads(samples))
    return _parsers[name]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of every fit; a row without an id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           docs_per_language: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Texts to learn from, by language: some `docs_per_language` documents with the smallest hashes
    of their id, of each at most an eighth of `sample_bytes` characters from a hashed place on. The size does not depend on the input's."""
    usable = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # Of n documents about 2 * docs_per_language fall below this hash; the smallest are taken.
    share = lambda n: min(1.0, 2 * docs_per_language / n)
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 40))
    limit = F.element_at(F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, int(share(n) * (1 << 40)))]), F.col(lang))
    size = F.lit(sample_bytes // 8)
    start = F.pmod(F.xxhash64(F.lit("offset"), F.col(doc_id)), F.greatest(F.length(text) - size + 1, F.lit(1))).cast("int") + 1
    rows = usable.where(order < limit).select(F.col(lang).alias("lang"), order.alias("order"), F.substring(F.col(text), start, size).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for name, _, value in sorted(set((r["lang"], r["order"], r["text"]) for r in rows)):
        if len(out.setdefault(name, [])) < docs_per_language:
            out[name].append(value)
    return out


def _judged(texts: pa.Array, data: np.ndarray, at: np.ndarray, known: Parser) -> tuple[list[str], list[float]]:
    if not known.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    best, score = known.predict(data, at)
    has_letter = [t is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
    return (
        [known.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has_letter)],
        [s if ok else 0.0 for s, ok in zip(score.tolist(), has_letter)],
    )


def identify(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with the language predicted for each and its score."""
    bounded_batches(docs.sparkSession)
    names, sampled = docs.columns, json.dumps(samples)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(sampled)
        for batch in batches:
            for piece in pieces(batch, text, 4 << 20):
                predicted, scores = _judged(piece.column(text), *utf8(piece.column(text)), known)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(n) for n in names), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                    names=[*names, lang_pred, score])

    added = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.mapInArrow(predict, T.StructType([*docs.schema, *added]))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    samples = sample(docs, doc_id, text, lang)
    rows = docs.select(doc_id, held_out(doc_id).alias("held_out"), F.col(text).alias("__text"))
    return identify(rows, samples, "__text").drop("__text")


def _with_letters(docs: DataFrame, text: str) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([t is not None and LETTER.search(t) is not None for t in batch.column(text).to_pylist()], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def keep_languages(docs: DataFrame, wanted: list[str] | None = None, **columns) -> DataFrame:
    """The documents whose language could be told, and is one of `wanted` if given; same columns. Where
    no language can be learned and none is wanted, the documents with a letter."""
    samples, text = sample(docs, **columns), columns.get("text", "text")
    if not samples and not wanted:
        return _with_letters(docs, text)
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = identify(docs, samples, text, pred, score)
    found = found.where(F.col(pred) != UNDETERMINED)
    return (found.where(F.col(pred).isin(wanted)) if wanted else found).select(*docs.columns)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))

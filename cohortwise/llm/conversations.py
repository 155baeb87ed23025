"""Conversation structure repair: turns aligned to the alternating grammar string.

A conversation should have the role initials `(s?(ua)+)?`. Its turns are aligned to such a string by edits:
Keep (0), Rerole to user or assistant (1), Delete (2), Insert an empty user or assistant turn (5); a
truncated turn that stays costs 5 more, blank and repeated turns have to go. The strings of all feasible
lengths that end alike are suffixes of one another, so one Wagner-Fischer table, filled from the last turn
backwards, has the cost of every length. It is filled only in Ukkonen's band: an alignment that costs no
more than a known one has few deletions and fewer insertions, which bounds the distance from the diagonal.
Of all lengths of least cost the audits are traced back and compared; the least in ASCII order counts.

Turns are taken by turn number, nulls first; turns with the same number by role, then by the digest of
their text. How it runs: rows are sorted by conversation and turn in ranges, so a conversation may spread
over many tasks. A task aligns the conversations it sees whole, many of one length at a time. Of others, and
of those with more than BLOCK turns, it aligns blocks of at most BLOCK turns: for every state the grammar may
be in before and after a block, the cheapest audit. Audits of equal cost over the same turns are never
prefixes of one another, so chaining the best audits of the blocks gives the best one of the conversation.
What a task holds of a conversation is then in proportion to its audit, which is one value of the result;
the digest of the repaired text is updated block by block.

Null conversation ids are one conversation; null roles and texts are taken as one space. Empty texts are
blank. A conversation without rows has zeros, an empty audit and the digest of the empty text. Repeated rows
are repeated turns: all but the first are duplicates. An empty table gives no rows. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Staged, bounded_batches, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK, BLOCK_BYTES = 1024, 4 << 20
CHUNK, CHUNK_BYTES = 4096, 8 << 20
CELLS = 4 << 20
FAR = 1 << 28
SPACE = r"\x20\x09-\x0D"
# States of the grammar: nothing yet, after s, before u, before a. The first and third may end it.
START, AFTER_S, BEFORE_U, BEFORE_A = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# Alignment of one block ------------------------------------------------------------------------


@dataclass
class Block:
    """Turns in order: initial of the role, whether they must go, whether they are truncated."""

    initial: str
    must: list[bool]
    cut: list[bool]
    roles: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)


class Tables:
    """Costs of aligning the turns from i on with the last r symbols of an alternating string that ends
    before `end` (0: u, 1: a), for blocks of equal size; r is stored by its distance from the diagonal."""

    def __init__(self, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, end: int, most: int):
        m, n = initial.shape
        self.n, self.end = n, end
        self.initial, self.must, self.cut = initial, must, cut
        self.most_deleted = min(n, most // DELETE)
        width = self.most_deleted + most // INSERT + 1
        at = np.arange(width)
        self.cost = np.full((n + 1, m, width), FAR, np.int32)
        r = at - self.most_deleted
        self.cost[n][:] = np.where(r >= 0, INSERT * r, FAR)
        for i in range(n - 1, -1, -1):
            after = self.cost[i + 1]
            r = n - i + at - self.most_deleted
            best = np.full((m, width), FAR, np.int32)
            best[:, :-1] = after[:, 1:] + DELETE
            symbol = np.where((end - r) % 2 == 0, ord("u"), ord("a"))
            stay = after + TRUNCATED * cut[:, i, None] + REROLE * (initial[:, i, None] != symbol)
            best = np.minimum(best, np.where(must[:, i, None], FAR, stay))
            best = np.minimum.accumulate(best - INSERT * at, axis=1) + INSERT * at
            self.cost[i] = np.where(r >= 0, np.minimum(best, FAR), FAR)

    def lengths(self, i: np.ndarray | int) -> np.ndarray:
        """The r of every stored cell of row i (of rows i)."""
        return self.n - np.asarray(i)[..., None] + np.arange(self.cost.shape[2]) - self.most_deleted

    def trace(self, block: np.ndarray, i: np.ndarray, r: np.ndarray) -> list[str]:
        """The least audit of every given cell."""
        n, block, i, r = self.n, block.copy(), i.copy(), r.copy()
        letters: list[np.ndarray] = []
        width = self.cost.shape[2]
        while ((i < n) | (r > 0)).any():
            b = r - (n - i) + self.most_deleted
            here, row, down = self.cost[i, block, b], np.minimum(i, n - 1), np.minimum(i + 1, n)
            more = i < n
            delete = more & (b + 1 < width) & (self.cost[down, block, np.minimum(b + 1, width - 1)] + DELETE == here)
            insert = ~delete & (r > 0) & (b > 0) & (self.cost[i, block, np.maximum(b - 1, 0)] + INSERT == here)
            stays = ~delete & ~insert & more & (r > 0)
            matches = self.initial[block, row] == np.where((self.end - r) % 2 == 0, ord("u"), ord("a"))
            letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(matches, ord("K"), ord("R"))))
            letters.append(np.where(delete | insert | stays, letter, 0).astype(np.uint8))
            i = i + (delete | stays)
            r = r - (insert | stays)
        if not letters:
            return [""] * len(block)
        return [row[row > 0].tobytes().decode() for row in np.stack(letters, axis=1)]


def _least(into: dict, key, cost: int, audit: str) -> None:
    if key not in into or (cost, audit) < into[key]:
        into[key] = (cost, audit)


def known_cost(initial: np.ndarray, must: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cost of some repair of each whole conversation: faulty turns go, and of the others either all stay,
    reroled, or those that do not alternate go as well."""
    n = initial.shape[1]
    good = ~must & ~cut
    place = np.cumsum(good, axis=1) - 1
    wrong = good & (initial != np.where(place % 2 == 0, ord("u"), ord("a")))
    reroled = DELETE * (~good).sum(axis=1) + wrong.sum(axis=1) + INSERT * (good.sum(axis=1) % 2)
    phase, deleted = np.zeros(len(initial), np.int64), np.zeros(len(initial), np.int64)
    for i in range(n):
        kept = good[:, i] & (initial[:, i] == np.where(phase == 0, ord("u"), ord("a")))
        phase, deleted = phase ^ kept, deleted + ~kept
    return np.minimum(np.minimum(reroled, DELETE * deleted + INSERT * phase), DELETE * n)


def align(blocks: list[Block], whole: bool) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """Per block the least (cost, audit) for each (state before, state after) that it can lead to.
    For `whole` conversations only what leads from the start to an end."""
    out: list[dict] = [{} for _ in blocks]
    sizes: dict[int, list[int]] = {}
    for k, block in enumerate(blocks):
        n = len(block.must)
        for state in (START,) if whole else (START, AFTER_S, BEFORE_U, BEFORE_A):  # all turns go
            _least(out[k], (state, state), DELETE * n, "D" * n)
        if n:
            sizes.setdefault(n, []).append(k)
    for n, members in sizes.items():
        step = max(1, CELLS // (n * (2 * n + 20)))
        for begin in range(0, len(members), step):
            part = members[begin : begin + step]
            _align_equal([blocks[k] for k in part], [out[k] for k in part], whole)
    return out


def _align_equal(blocks: list[Block], out: list[dict], whole: bool) -> None:
    n = len(blocks[0].must)
    # Only these three initials matter.
    initial = np.array([[ord(c) if c in "sua" else 0 for c in b.initial] for b in blocks], np.int64)
    must, cut = np.array([b.must for b in blocks], bool), np.array([b.cut for b in blocks], bool)
    if whole:
        most = int(known_cost(initial, must, cut).max())
    else:  # faulty turns go, others are reroled, at most two turns are added: possible from and to any state
        most = int((DELETE * (must | cut) + REROLE * ~(must | cut)).sum(axis=1).max()) + 2 * INSERT
    sblock, splace = np.nonzero((initial == ord("s")) & ~must)
    for end in (0,) if whole else (0, 1):
        tables = Tables(initial, must, cut, end, most)
        after = BEFORE_U if end == 0 else BEFORE_A
        # (cost of each cell, its block, its turn, its r, letters before it, states)
        wanted: list[tuple] = []
        costs, r = tables.cost[0], tables.lengths(0)
        own, zeros = np.arange(len(blocks)), np.zeros(len(blocks), np.int64)
        for first in (0,) if whole else (0, 1):
            fits = (r >= 0) & ((end - r) % 2 == first)
            if first == 0:
                wanted.append((np.where(fits & (r >= 1), costs, FAR), own, zeros, np.tile(r, (len(own), 1)), False,
                               [(START, after)] if whole else [(START, after), (AFTER_S, after), (BEFORE_U, after)]))
            else:
                wanted.append((np.where(fits, costs, FAR), own, zeros, np.tile(r, (len(own), 1)), False, [(BEFORE_A, after)]))
        if len(sblock):
            costs = tables.cost[splace + 1, sblock] + (DELETE * splace + TRUNCATED * cut[sblock, splace])[:, None]
            r = tables.lengths(splace + 1)
            fits = (r >= 1) & ((end - r) % 2 == 0)
            wanted.append((np.where(fits, np.minimum(costs, FAR), FAR), sblock, splace + 1, r, True, [(START, after)]))
            if not whole and end == 0:
                # All other turns go; outside the band, so not from the table.
                for k, i in zip(sblock.tolist(), splace.tolist()):
                    _least(out[k], (START, AFTER_S), DELETE * (n - 1) + TRUNCATED * int(cut[k, i]), "D" * i + "K" + "D" * (n - 1 - i))
        for costs, block, i, r, after_s, states in wanted:
            least = np.full(len(blocks), FAR, np.int64)
            np.minimum.at(least, block, costs.min(axis=1, initial=FAR))
            row, cell = np.nonzero((costs == least[block][:, None]) & (costs < FAR))
            for k, audit in zip(row.tolist(), tables.trace(block[row], i[row], r[row, cell])):
                b = int(block[k])
                if after_s:
                    audit = "D" * int(i[k] - 1) + "K" + audit
                for state in states:
                    _least(out[b], state, int(least[b]), audit)


def chained(blocks: list[dict]) -> tuple[int, str, list[int], list[str]]:
    """The least cost and audit over all blocks, with the state before and the audit of each block."""
    best: dict[int, tuple[int, str]] = {START: (0, "")}
    back: list[dict[int, int]] = []
    for block in blocks:
        found: dict[int, tuple[int, str]] = {}
        origin: dict[int, int] = {}
        for (before, after), (cost, audit) in block.items():
            if before in best:
                so_far = (best[before][0] + cost, best[before][1] + audit)
                if after not in found or so_far < found[after]:
                    found[after], origin[after] = so_far, before
        best = found
        back.append(origin)
    (cost, audit), state = min((best[s], s) for s in (START, BEFORE_U) if s in best)
    states, audits = [], []
    for block, origin in zip(reversed(blocks), reversed(back)):
        before = origin[state]
        audits.append(block[before, state][1])
        states.append(before)
        state = before
    return cost, audit, states[::-1], audits[::-1]


def repaired(roles: list[str], texts: list[str], audit: str, state: int = START) -> list[str]:
    """`role:text` of the turns an audit leaves, starting from a state of the grammar."""
    out, at = [], 0
    for letter in audit:
        role, text = ("assistant" if state == BEFORE_A else "user"), ""
        if letter != "I":
            if letter != "D":
                role, text = (roles[at] if letter == "K" else role), texts[at]
            at += 1
        if letter != "D":
            out.append(f"{role}:{text}")
            state = AFTER_S if role[:1] == "s" else BEFORE_U if state == BEFORE_A else BEFORE_A
    return out


# Rows --------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, gone) after the stated damage; a dropped row stays as a mark that its
    conversation exists."""
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.withColumn("kind", kind).select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("kind") == 0, F.lit("")).when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]


def turns(rows: DataFrame, staged: Staged) -> DataFrame:
    """The rows (conv, turn, role, text, gone) with their first fault, sorted by conversation and turn."""
    solid = F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    rows = staged.write(rows.select("*", F.md5("text").alias("digest"), (~solid & ~F.col("gone")).alias("blank"), (solid & ~ended & ~F.col("gone")).alias("cut"),
                                    F.monotonically_increasing_id().alias("row")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    again = rows.where("not gone and not blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    same = rows["conv"].eqNullSafe(again["c"]) & (rows["role"] == again["r"]) & (rows["digest"] == again["d"])
    later = F.coalesce((place > F.col("first")) & ~F.col("gone") & ~F.col("blank"), F.lit(False)).alias("later")
    order = _order()
    return rows.join(again, same, "left").select(*rows.columns, later).repartitionByRange(*order).sortWithinPartitions(*order)


_MATRIX = "array<struct<before:int,after:int,cost:bigint,audit:string>>"
_STATS = ["n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn"]
_PARTS = ("conv {conv}, whole boolean, part long, seq long, " + ", ".join(f"{s} long" for s in _STATS) +
          f", first_initial string, last_initial string, cost long, audit string, sha string, matrix {_MATRIX}, roles array<string>, texts array<string>")
_MATRIX_TYPE = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _stats(turn: list, gone: list[bool], blank: list[bool], later: list[bool], cut: list[bool], initial: str) -> dict:
    known = [t for t, g in zip(turn, gone) if t is not None and not g]
    pairs = sum(p not in ("su", "ua", "au") for p in map("".join, zip(initial, initial[1:])))
    return {
        "n": len(initial), "blank": sum(blank), "duplicate": sum(later), "truncated": sum(c and not l for c, l in zip(cut, later)), "illegal": pairs,
        "turns": sum(a != b for a, b in zip(known, known[1:])) + bool(known), "low": known[0] if known else None, "high": known[-1] if known else None,
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        "first_initial": initial[:1] or None, "last_initial": initial[-1:] or None,
    }


def _parts(conv_type: pa.DataType):
    """mapInArrow function over sorted turns: a row per conversation seen whole, or per block of one."""
    kinds = {"conv": conv_type, "whole": pa.bool_(), "part": pa.int64(), "seq": pa.int64(), **{s: pa.int64() for s in _STATS},
             "first_initial": pa.string(), "last_initial": pa.string(), "cost": pa.int64(), "audit": pa.string(), "sha": pa.string(),
             "matrix": _MATRIX_TYPE, "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}

    def finish(runs: list[tuple[dict, bool]], part: int, seq: int) -> pa.RecordBatch:
        made = []
        for rows, whole in runs:
            stay = [k for k, g in enumerate(rows["gone"]) if not g]
            # An empty role has no initial; no rule names the character that stands for it.
            initial = "".join((rows["role"][k] or "\0")[0] for k in stay)
            stats = _stats(rows["turn"], rows["gone"], rows["blank"], rows["later"], rows["cut"], initial)
            must = [rows["blank"][k] or rows["later"][k] for k in stay]
            block = Block(initial, must, [rows["cut"][k] and not rows["later"][k] for k in stay],
                          [rows["role"][k] for k in stay], [rows["text"][k] for k in stay])
            made.append((rows["conv"][0], whole, stats, block))
        out = {name: [] for name in kinds}
        for whole in (True, False):
            group = [m for m in made if m[1] == whole]
            for (conv, _, stats, block), states in zip(group, align([m[3] for m in group], whole)):
                row = {"conv": conv, "whole": whole, "part": part, "seq": seq, **stats}
                seq += 1
                if whole:
                    row["cost"], row["audit"], _, _ = chained([states])
                    row["sha"] = hashlib.sha256("\n".join(repaired(block.roles, block.texts, row["audit"])).encode()).hexdigest()
                else:
                    row["matrix"] = [{"before": b, "after": a, "cost": c, "audit": t} for (b, a), (c, t) in states.items()]
                    row["roles"] = block.roles
                    row["texts"] = [None if m else t for t, m in zip(block.texts, block.must)]
                for name, values in out.items():
                    values.append(row.get(name))
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    names = ["conv", "turn", "role", "text", "gone", "blank", "later", "cut"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        current: dict[str, list] = {k: [] for k in names}
        size, first, split = 0, True, False  # of the run held: its bytes, whether it is the partition's first, whether blocks of it are out
        runs: list[tuple[dict, bool]] = []
        held = held_bytes = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in names]
            for row in zip(*columns):
                new = bool(current["conv"]) and row[0] != current["conv"][0]
                if new or len(current["conv"]) >= BLOCK or size >= BLOCK_BYTES:
                    runs.append((current, new and not first and not split))
                    held, held_bytes = held + len(current["conv"]), held_bytes + size
                    first, split = (False, False) if new else (first, True)
                    current, size = {k: [] for k in names}, 0
                    if held >= CHUNK or held_bytes >= CHUNK_BYTES:
                        yield finish(_in_order(runs), part, seq)
                        seq += len(runs)
                        runs, held, held_bytes = [], 0, 0
                for k, value in zip(names, row):
                    current[k].append(value)
                size += len(row[3])
        if current["conv"]:
            runs.append((current, False))
        if runs:
            yield finish(_in_order(runs), part, seq)

    return scan


def _in_order(runs: list[tuple[dict, bool]]) -> list[tuple[dict, bool]]:
    """Whole conversations first, as they are numbered; blocks keep their order."""
    return sorted(runs, key=lambda r: not r[1])


def _joined(conv_type: pa.DataType):
    """applyInArrow function over the blocks of one conversation, without their texts: per block the state
    before it and its audit; the last one carries the conversation's figures and audit."""

    def join(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        cost, audit, states, audits = chained([{(m["before"], m["after"]): (m["cost"], m["audit"]) for m in r["matrix"]} for r in rows])
        with_turns, with_rows = [r for r in rows if r["low"] is not None], [r for r in rows if r["n"]]
        distinct = sum(r["turns"] for r in rows) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(with_turns, with_turns[1:]))
        pairs = [a["last_initial"] + b["first_initial"] for a, b in zip(with_rows, with_rows[1:])]
        figures = {
            "gaps": with_turns[-1]["high"] - with_turns[0]["low"] + 1 - distinct if with_turns else 0,
            **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")},
            "illegal": sum(r["illegal"] for r in rows) + sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost,
        }
        last = len(rows) - 1
        whole = lambda value: pa.array([value if k == last else None for k in range(len(rows))])
        return pa.table({
            "part": pa.array([r["part"] for r in rows], pa.int64()), "seq": pa.array([r["seq"] for r in rows], pa.int64()),
            "state": pa.array(states, pa.int32()), "edits": pa.array(audits, pa.string()), "last": pa.array([k == last for k in range(len(rows))]),
            "audit": whole(audit).cast(pa.string()), **{c: whole(v).cast(pa.int64()) for c, v in figures.items()}})

    return join


_JOINED = "part long, seq long, state int, edits string, last boolean, audit string, " + ", ".join(f"{c} long" for c in COUNTS)


def _digests(conv_type: pa.DataType):
    """mapInArrow function over the blocks of conversations in order: the digest, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, empty = hashlib.sha256(), True
        for batch in batches:
            kept = []
            for row in batch.to_pylist():
                lines = repaired(row["roles"], row["texts"], row["edits"], row["state"])
                if lines:
                    sha.update((("" if empty else "\n") + "\n".join(lines)).encode())
                    empty = False
                if row["last"]:
                    kept.append([row["conv"], *(row[c] for c in COUNTS), row["audit"], sha.hexdigest()])
                    sha, empty = hashlib.sha256(), True
            columns = list(zip(*kept)) or [()] * (len(COUNTS) + 3)
            kinds = [conv_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["conv", *COUNTS, "audit", "sha"])

    return run


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of every conversation of the rows
    (conv, turn, role, text, gone); rows that are `gone` count for nothing."""
    spark = bounded_batches(rows.sparkSession)
    staged = Staged(spark, "conversations")
    conv = rows.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if kind == pa.int64():
        rows, conv = rows.withColumn("conv", F.col("conv").cast("long")), "bigint"
    sorted_turns = turns(rows.withColumn("turn", F.col("turn").cast("long")), staged)
    wanted = sorted_turns.select("conv", "turn", "role", "text", "gone", "blank", "later", "cut")
    parts = staged.write(wanted.mapInArrow(_parts(kind), _PARTS.format(conv=conv)), "parts")
    known = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = parts.where("whole").select("conv", known.alias("gaps"), *COUNTS[1:], "audit", "sha")
    blocks = parts.where("not whole")
    joined = blocks.drop("roles", "texts", "cost", "audit", "sha").groupBy("conv").applyInArrow(_joined(kind), _JOINED)
    texts = blocks.select("conv", "part", "seq", "roles", "texts").join(joined, ["part", "seq"])
    order = [F.col("conv").asc_nulls_first(), "part", "seq"]
    split = texts.repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _digests(kind), f"conv {conv}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, sha string")
    return whole.union(split)


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    found = repair(damage(rows))
    return found.select(F.col("conv").alias("conv_id"), *COUNTS, "audit", F.col("sha").alias("repaired_sha256"))

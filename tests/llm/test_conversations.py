import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import conversations as C

from .conftest import SF

SOLID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(initial, must, cut):
    """The least (cost, audit) by walking an automaton forwards; every audit is kept, so it is exact."""
    best = {"": (0, "")}  # "", "s" (needs u), "u" (needs u next, may end), "a" (needs a next)
    step = {("", "s"): "s", ("", "u"): "a", ("s", "u"): "a", ("u", "u"): "a", ("a", "a"): "u"}

    def least(options):
        out = {}
        for state, value in options:
            if state not in out or value < out[state]:
                out[state] = value
        return out

    def inserted(found):
        options = list(found.items())
        for _ in range(3):
            found = least([(step[s, c], (cost + 5, audit + "I")) for s, (cost, audit) in found.items() for c in "ua" if (s, c) in step])
            options += found.items()
        return least(options)

    for i, m, c in zip(initial, must, cut):
        options = []
        for s, (cost, audit) in inserted(best).items():
            options.append((s, (cost + 2, audit + "D")))
            if not m:
                if (s, i) in step:
                    options.append((step[s, i], (cost + 5 * c, audit + "K")))
                options += [(step[s, x], (cost + 1 + 5 * c, audit + "R")) for x in "ua" if (s, x) in step]
        best = least(options)
    return min(v for s, v in inserted(best).items() if s in ("", "u"))


def written(rows, audit):
    out, at, state = [], 0, "start"
    for e in audit:
        symbol = "assistant" if state == "u" else "user"
        if e in "KR":
            role = rows[at][2] if e == "K" else symbol
            out.append(f"{role}:{rows[at][3]}")
            state = role[0]
        elif e == "I":
            out.append(f"{symbol}:")
            state = symbol[0]
        at += e != "I"
    return "\n".join(out)


def key(row):
    conv, turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest()


def brute(rows, after_damage=None):
    after = damaged(rows) if after_damage is None else after_damage
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=key)
        seen, must, cut, blank, duplicate = set(), [], [], 0, 0
        for _, _, role, text in own:
            solid = SOLID.findall(text)
            again = bool(solid) and (role, text) in seen
            seen.add((role, text))
            blank, duplicate = blank + (not solid), duplicate + again
            must.append(not solid or again)
            cut.append(bool(solid) and not again and solid[-1] not in ".!?")
        initial = [r[2][:1] for r in own]
        known = [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(initial, must, cut)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
        out.append((conv, gaps, blank, duplicate, sum(cut), illegal, cost, audit, hashlib.sha256(written(own, audit).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in C.repair(C.damage(df.withColumnRenamed("conv_id", "conv").select("conv", "turn", "role", "text"))).collect()), key=repr)


def test_alignment_against_automaton():
    rng = random.Random(13)
    blocks = []
    for n in (0, 1, 2, 3, 5, 8, 13, 30):
        for _ in range(60):
            initial = "".join(rng.choice("suaux" if rng.random() < 0.5 else "ua") for _ in range(n))
            blocks.append(C.Block(initial, [rng.random() < 0.2 for _ in initial], [rng.random() < 0.25 for _ in initial]))
    for b in blocks:
        b.cut = [c and not m for c, m in zip(b.cut, b.must)]
    for b, found in zip(blocks, C.align(blocks, True)):
        assert C.chained([found])[:2] == cheapest(b.initial, b.must, b.cut)
    # Cut into parts anywhere, the chained audits are the same.
    for b in blocks:
        n = len(b.initial)
        at = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(3)))
        parts = [C.Block(b.initial[i:j], b.must[i:j], b.cut[i:j]) for i, j in zip([0, *at], [*at, n])]
        cost, audit, states, audits = C.chained(C.align(parts, False))
        assert (cost, audit) == cheapest(b.initial, b.must, b.cut) and "".join(audits) == audit


def test_all_small_conversations():
    blocks = [C.Block("".join(i), [c == "m" for c in k], [c == "c" for c in k])
              for n in range(4) for i in itertools.product("suax", repeat=n) for k in itertools.product("-mc", repeat=n)]
    for b, found in zip(blocks, C.align(blocks, True)):
        assert C.chained([found])[:2] == cheapest(b.initial, b.must, b.cut)


def test_band_holds_the_least_cost():
    rng = np.random.Generator(np.random.PCG64(3))
    initial = rng.choice([ord("u"), ord("a"), ord("s")], (50, 40))
    must, cut = rng.random((50, 40)) < 0.1, rng.random((50, 40)) < 0.1
    known = C.known_cost(initial, must, cut)
    narrow, wide = C.Tables(initial, must, cut, 0, int(known.max())), C.Tables(initial, must, cut, 0, 1000)
    least = lambda t: np.where((t.lengths(0) % 2 == 0) & (t.lengths(0) >= 0), t.cost[0], C.FAR).min(axis=1)
    assert (least(narrow) == least(wide)).all() and (least(wide) <= known).all()


@pytest.mark.parametrize("block", [C.BLOCK, 3])
def test_query(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    found = C.op13_conversations(spark, SF)
    assert found.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


ODD = [
    (1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 5, "", "x"), (1, 9, "assistant", "Yes \n\t"), (1, 9, "assistant", "ok!"),
    (None, 3, "system", "Be good."), (None, None, "user", "a?"), (None, 4, "assistant", "漢字."), (None, 4, "tool", "..."), (2, 1, "user", ""),
    (3, None, "system", "Only."), (4, 7, "assistant", "w " * 200_000 + "."), (4, 8, "User", "done."), (5, 1, "user", " \n "), (5, 2, "user", "　"),
    *((6, t, "su a"[t % 4 : t % 4 + 1] + "x", f"t{t % 11}" + ".!? "[t % 4]) for t in range(90)), *((7, 1, "user", "same.") for _ in range(40)),
    *((20 + k, t, r, x) for k in range(60) for t, (r, x) in enumerate([("user", "q."), ("assistant", "a."), ("user", "q."), ("assistant", "b")])),
]


@pytest.mark.parametrize("block", [C.BLOCK, 4])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    df = spark.createDataFrame(ODD, SCHEMA)
    # Columns called like those made on the way do not matter.
    assert run(df.withColumns({c: F.lit("x") for c in ("row", "digest", "blank", "cost", "gone")})) == brute(ODD)
    assert run(df.where("false")) == []


def test_conversations_that_vanish(spark):
    dropped = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run(spark.createDataFrame([(*dropped, "user", "x.")], SCHEMA)) == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

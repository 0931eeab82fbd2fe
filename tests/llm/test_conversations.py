"""Conversation repair against a search over all edit sequences, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from corpusmill.llm import conversations

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, pos string, gone string, copy string, kind string, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def damage(rows):
    show = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "k")
        seen.add((role, text))
    return out


def search(initials, found):
    """The cheapest audit, by trying every edit at every place; state: the initials so far, shortened to what can follow."""

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(initials):
            if state in ("", "a"):
                options.append((0, ""))
        else:
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            more = 3 * (found[i] == "t")
            options.append(add(4, "D", best(i + 1, state, 0)))
            if found[i] not in "bd":
                if initials[i] and initials[i] in allowed:
                    options.append(add(more, "K", best(i + 1, initials[i], 0)))
                options += [add(3 + more, "R", best(i + 1, c, 0)) for c in allowed if c != "s"]
        if inserts < 4:
            allowed = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            options += [add(3, "I", best(i, c, inserts + 1)) for c in allowed]
        return min((o for o in options if o), default=None)

    def add(cost, edit, rest):
        return rest and (cost + rest[0], edit + rest[1])

    for i in range(len(initials), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def repaired(rows, audit):
    lines, state, i = [], "", 0
    for edit in audit:
        follows = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if edit != "I":
            _, role, text = rows[i]
            i += 1
        if edit == "D":
            continue
        line = f"{follows}:" if edit == "I" else f"{follows}:{text}" if edit == "R" else f"{role}:{text}"
        lines.append(line)
        state = line[0]
    return "\n".join(lines)


def want(rows):
    out = []
    for conv, kept in damage(rows).items():
        found = faults(kept)
        initials = [r[1][:1] for r in kept]
        turns = sorted({r[0] for r in kept if r[0] is not None})
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = search(tuple(initials), tuple(found))
        text = repaired(kept, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in re.findall(r"(?:^|\n)([^:\n]*):", text))) or "\n" in "".join(r[2] for r in kept)
        out.append((conv, gaps, *(found.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def same(got, rows):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want(rows)))


def made_up(seed, n, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = r.randint(-2, 3)
        for _ in range(r.randint(0, longest)):
            turn += r.choice((1, 1, 1, 1, 2, 5))
            text = r.choice(("Yes.", "No!", "one two", "so?\n", "", " \t", "What is it", "again and again.", f"text {r.random()}."))
            rows.append((conv, turn, r.choice(("user", "assistant", "user", "assistant", "system", "tool", "s", "")), text))
    return rows


AWKWARD = [
    *[(1000, None, "user", None), (1000, None, None, "A?"), (1000, None, "assistant", "B."), (1000, 3, "user", "é" * 30_000)],
    *[(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)],
    *[(1001, 4, "user", "same.")] * 9,
    *[(1002, k, "assistant", "long. " * 20_000) for k in range(3)],
    *[(1003, t, "system", " \x1c") for t in range(4)],
    *[(-5, t, "uncle" if t % 2 else "aunt", "ok.") for t in range(6)],
]


def test_query(spark, tmp_path):
    rows = made_up(1, 120) + AWKWARD
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    same(conversations.op11_conversation_repair(spark, str(tmp_path)).collect(), rows)


@pytest.mark.parametrize("long,piece,fan", [(0, 1, 2), (2, 3, 2), (5, 2, 3)])
def test_long_conversations_go_through_the_tree(spark, monkeypatch, long, piece, fan):
    for name, value in (("LONG_ROWS", long), ("PIECE", piece), ("FAN", fan)):
        monkeypatch.setattr(conversations, name, value)
    rows = made_up(2, 40, 30) + AWKWARD
    same(conversations.repair(conversations.damaged(frame(spark, rows)), gone=conversations.F.col("gone")).collect(), rows)


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 50)
    monkeypatch.setattr(conversations, "LONG_ROWS", 100)
    r = random.Random(5)
    rows = [(7, t, r.choice(("user", "assistant")), f"line {r.randint(0, 700)}" + r.choice(".,")) for t in range(900)] + made_up(3, 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(conversations.repair(conversations.damaged(frame(spark, rows)), gone=conversations.F.col("gone")).collect(), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_and_nothing(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (2, 0, "user", " ")]
    got = {r["conv_id"]: r for r in conversations.repair(frame(spark, rows), texts=True).collect()}
    assert (got[1]["audit"], got[1]["cost"]) == ("KIKD", 7)
    assert got[1]["repaired"] == "system:Be kind.\nuser:\nassistant:Hello."
    assert (got[2]["audit"], got[2]["repaired"]) == ("D", "")
    assert not conversations.repair(frame(spark, [])).count()


@pytest.mark.parametrize("seed", range(60))
def test_products_find_the_cheapest_and_least(seed):
    r = random.Random(seed)
    initials = tuple(r.choice("suuaax") for _ in range(r.randint(0, 9)))
    found = tuple(r.choice("kkkktbd") for _ in initials)
    symbols = "".join("d" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initials, found, strict=True))
    assert conversations.cheapest(conversations.product(symbols)) == search(initials, found)


def test_grouping_changes_no_product():
    r = random.Random(9)
    for _ in range(40):
        symbols = "".join(r.choice("suaxdSUAX") for _ in range(r.randint(2, 40)))
        whole = conversations.product(symbols)
        k = r.randrange(1, len(symbols))
        assert conversations.times(conversations.product(symbols[:k]), conversations.product(symbols[k:])) == whole
        left = conversations.IDENTITY
        for s in symbols:
            left = conversations.times(left, conversations.turn(s))
        assert left == whole

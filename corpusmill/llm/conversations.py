"""Repair of conversation structure by a scan of min-plus matrices.

A conversation must read `(s?(ua)+)?` by the initials of its roles. Its four states (nothing, system, user and
assistant last) make each turn a 4x4 matrix: entry (i, j) is the cheapest way from state i to state j
over that turn, with any insertions before it (their closure), as (cost, audit): addition puts edits
after one another, minimum takes the lower cost and of equal ones the ASCII-least audit. Audits of one stretch of turns and of equal cost are
never prefixes of each other (only insertions could follow, and they cost), so the minimum goes through products and they may be grouped
freely: a stretch's product is a balanced tree over its turns.

Rows are sorted over all tasks by conversation and turn, in ranges that may cut a conversation. What
lies wholly inside a task's range is repaired there. Conversations that a range cuts, or that are longer than
LONG_ROWS or LONG_BYTES, leave the task as rows: their repeated rows are found by grouping, their turns
become products of PIECE turns, and FAN neighbouring products at a time become one until each conversation has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, hash_pair, map_arrow, stored

#: Longer conversations don't stay in a task's memory.
LONG_ROWS, LONG_BYTES = 4096, 8 << 20
#: Turns of a long conversation whose product is made at once, and products that become one.
PIECE, FAN = 2048, 8
KEEP, REROLE, DELETE, INSERT, REPAIR = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
#: State after the user or assistant turn that each state asks for next (nothing, system, user, assistant).
_NEXT = (2, 2, 3, 2)
_ROLES = (None, None, "user", "assistant")
#: States in which a turn is kept, and the state after it, by its initial.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
Matrix = tuple[tuple, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product over (cost, audit); None stands for no way."""
    out = []
    for row in a:
        line = []
        for j in range(4):
            best = None
            for x, way in zip(row, b, strict=True):
                y = way[j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                    best = (cost, x[1] + y[1])
            line.append(best)
        out.append(tuple(line))
    return tuple(out)


IDENTITY: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))
_ONE: Matrix = tuple(tuple((INSERT, "I") if _NEXT[i] == j else (0, "") if i == j else None for j in range(4)) for i in range(4))
#: Any number of insertions; more than three lead nowhere new.
CLOSURE: Matrix = times(_ONE, times(_ONE, _ONE))


@cache
def turn(symbol: str) -> Matrix:
    """The matrix of one turn. symbol: d if it must go, else its initial (x: no known role), in capitals if it is truncated."""
    ways: list[list] = [[None] * 4 for _ in range(4)]
    low, more = symbol.lower(), REPAIR * symbol.isupper()
    for i in range(4):
        ways[i][i] = (DELETE, "D")
        if symbol != "d":
            options = [(REROLE + more, "R", _NEXT[i])] + [(KEEP + more, "K", j) for at, j in _KEPT.get(low, {}).items() if at == i]
            for cost, edit, j in options:
                ways[i][j] = min(filter(None, (ways[i][j], (cost, edit))))
    return times(CLOSURE, tuple(map(tuple, ways)))


@lru_cache(maxsize=20_000)
def _short(symbols: str) -> Matrix:
    return _halves(symbols) if len(symbols) > 1 else turn(symbols)


def _halves(symbols: str) -> Matrix:
    half = len(symbols) // 2
    return times(product(symbols[:half]), product(symbols[half:]))


def product(symbols: str) -> Matrix:
    """The product of the turns' matrices, by halves; short stretches are remembered."""
    if not symbols:
        return IDENTITY
    return _short(symbols) if len(symbols) <= 12 else _halves(symbols)


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of the whole conversation: from nothing to nothing or to an assistant's turn."""
    whole = times(matrix, CLOSURE)[0]
    return min(whole[0], whole[3])


@lru_cache(maxsize=20_000)
def _answer(symbols: str) -> tuple[int, str]:
    return cheapest(product(symbols))


class _Applied:
    """Carries edits out, turn by turn, and hashes `role:text` lines."""

    def __init__(self, audit: str, texts: bool):
        self.audit, self.at, self.state, self.lines = audit, 0, 0, 0
        self.hash, self.texts = hashlib.sha256(), [] if texts else None

    def _line(self, role: str, text: str) -> None:
        line = ("\n" if self.lines else "") + f"{role}:{text}"
        self.lines += 1
        self.hash.update(line.encode())
        if self.texts is not None:
            self.texts.append(line)

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            self._line(_ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[role[:1]][self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self._line(_ROLES[self.state], text)

    def ended(self) -> tuple[str, str | None]:
        self.inserted()
        return self.hash.hexdigest(), None if self.texts is None else "".join(self.texts)


class _Gaps:
    """Turn numbers that a sorted run of turns leaves out."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = 0

    def add(self, at: int | None) -> None:
        if at is not None and at != self.last:
            self.first = at if self.first is None else self.first
            self.last, self.distinct = at, self.distinct + 1

    def value(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def _whole(rows: list[tuple], texts: bool) -> tuple:
    """The result of one conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, hash, text. rows: (turn, role, text) in order."""
    seen, gaps, symbols, count, illegal, before = set(), _Gaps(), [], {"b": 0, "d": 0, "t": 0}, 0, None
    for at, role, text in rows:
        gaps.add(at)
        end = text.rstrip(SPACE)
        initial = role[:1]
        if before is not None and before + initial not in LEGAL:
            illegal += 1
        before = initial
        symbol = initial if initial in _KEPT else "x"
        if not end:
            count["b"] += 1
            symbol = "d"
        elif (role, text) in seen:
            count["d"] += 1
            symbol = "d"
        elif end[-1] not in ENDS:
            count["t"] += 1
            symbol = symbol.upper()
        seen.add((role, text))
        symbols.append(symbol)
    key = "".join(symbols)
    cost, audit = _answer(key) if len(key) <= 64 else cheapest(product(key))
    applied = _Applied(audit, texts)
    for _, role, text in rows:
        applied.row(role, text)
    return (gaps.value(), count["b"], count["d"], count["t"], illegal, cost, audit, *applied.ended())


_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"), ("repaired", "string")]
_ROW = [("pos", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("gone", "boolean")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_EMIT = 2000
_EMIT_BYTES = 4 << 20


def _batches(rows: Iterator[tuple], columns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of bounded rows and bytes of text."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*held, strict=True), columns, strict=True)], [n for n, _ in columns])

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= _EMIT or size > _EMIT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _inside(texts: bool):
    """Conversations that lie wholly inside the task's range become results, others stay rows."""
    none_row, none_result = (None,) * len(_ROW), (None,) * len(_RESULT)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        conv, size, first, passing = None, 0, True, True

        def closed() -> tuple:
            return (conv, *none_row, *_whole([r[1:4] for r in held if not r[4]], texts))

        for own, *row in _rows(batches):
            if first or own != conv:
                if not first and not passing:
                    yield closed()
                conv, held, size, passing, first = own, [], 0, first, False
            if not passing:
                held.append(tuple(row))
                size += len(row[3] or "") + len(row[2] or "")
                if len(held) > LONG_ROWS or size > LONG_BYTES:
                    passing = True
                    yield from ((conv, *r, *none_result) for r in held)
                    held = []
            else:
                yield (conv, *row, *none_result)
        yield from ((conv, *r, *none_result) for r in held)  # the last may go on in the next range

    columns = [("conv", "long"), *_ROW, *_RESULT]
    return lambda batches: _batches(results(batches), columns)


_PIECE = [("conv", "long"), ("first", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("opens", "string"), ("closes", "string")]
_PIECE_SCHEMA = ", ".join(f"{n} {k}" for n, k in _PIECE) + ", costs array<long>, audits array<string>"


def _piece_batch(pieces: list[tuple]) -> pa.RecordBatch:
    """pieces: the columns of _PIECE and a matrix."""
    columns = list(zip(*pieces, strict=True))
    flat = [[w for row in m for w in row] for m in columns[-1]]
    arrays = [pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns[:-1], _PIECE, strict=True)]
    arrays += [pa.array([[w and w[0] for w in m] for m in flat], pa.list_(pa.int64())), pa.array([[w and w[1] for w in m] for m in flat], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [*(n for n, _ in _PIECE), "costs", "audits"])


def _matrix(costs: list, audits: list) -> Matrix:
    ways = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(ways[i : i + 4]) for i in range(0, 16, 4))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, pos, initial, fault) as products of at most PIECE turns."""
    held: list[tuple] = []

    def piece() -> pa.RecordBatch:
        faults = "".join(f for *_, f in held)
        initials = [i for _, _, i, _ in held]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))
        known = [i if i in _KEPT else "x" for i in initials]
        symbols = "".join("d" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(known, faults, strict=True))
        return _piece_batch([(held[0][0], held[0][1], faults.count("b"), faults.count("d"), faults.count("t"), illegal, initials[0], initials[-1], product(symbols))])

    for row in _rows(batches):
        if held and (row[0] != held[0][0] or len(held) == PIECE):
            yield piece()
            held = []
        held.append(row)
    if held:
        yield piece()


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring products of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["first"])
    level = [_matrix(r["costs"], r["audits"]) for r in rows]
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    illegal = sum(r["illegal"] for r in rows) + sum(a["closes"] + b["opens"] not in LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True))
    sums = [sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")]
    return pa.Table.from_batches([_piece_batch([(rows[0]["conv"], rows[0]["first"], *sums, illegal, rows[0]["opens"], rows[-1]["closes"], level[0])])])


def _reduced(pieces: DataFrame) -> DataFrame:
    """One product for each conversation: FAN neighbours at a time, so that no task joins more."""
    while True:
        placed = stored(pieces.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy("first")) - 1))
        if not placed.where("place > 0").limit(1).count():
            return placed.drop("place")
        one = placed.withColumn("group", F.floor(F.col("place") / FAN)).drop("place")
        alone = Window.partitionBy("conv", "group")
        counted = one.withColumn("n", F.count("*").over(alone))
        several = counted.where("n > 1").drop("n").groupBy("conv", "group").applyInArrow(lambda t: _joined(t.drop(["group"])), _PIECE_SCHEMA)
        pieces = counted.where("n = 1").drop("n", "group").unionByName(several)


def _streamed(texts: bool):
    """Long conversations: a header with the audit, then the rows in order; their texts are hashed as they pass."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, head, gaps, applied, began = None, None, None, None, False

        def closed() -> tuple:
            return (conv, gaps.value(), *head, *applied.ended())

        for own, _, at, role, text, gone, *header in _rows(batches):
            if not began or own != conv:
                if began:
                    yield closed()
                conv, gaps, began = own, _Gaps(), True
                head = tuple(header) if header[-1] is not None else (0, 0, 0, 0, 0, "")
                applied = _Applied(head[-1], texts)
            if not gone:
                gaps.add(at)
                applied.row(role, text)
        if began:
            yield closed()

    columns = [("conv", "long"), *_RESULT]
    return lambda batches: _batches(results(batches), columns)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's product as (conv, blank, duplicate, truncated, illegal, cost, audit)."""
    rows = ((*head, *cheapest(_matrix(costs, audits))) for *head, costs, audits in _rows(batches))
    return _batches(rows, [("conv", "long"), *_RESULT[1:7]])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None, texts: bool = False) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with texts also repaired.

    Turns go by number, nulls first; rows of one number by role, then by text (64 characters of each, then a hash). Null roles and texts are empty.
    Edits are as the module says; audit has their initials (K, R, D, I), repaired the `role:text` lines. gone: rows that only keep their
    conversation in the result. Rows with a null conversation are one conversation. Repeated rows are turns of their own (and duplicates).
    A conversation without rows has zeros, an empty audit and the hash of an empty string. Other columns are dropped; an empty table gives an empty result.
    Very long texts and conversations pass in bounded memory but for the audit, of which a product holds 16; the hash of one conversation's text runs in one task, since SHA-256 has no other way.
    """
    left_out = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    role, text = (F.when(~left_out, F.coalesce(F.col(c), F.lit(""))) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.when(~left_out, F.col(turn_col).cast("long")).alias("turn"), role.alias("role"), text.alias("text"), left_out.alias("gone"))
    order = ["conv", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text"), "salt"]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "gone")
    schema = lambda columns: ", ".join(f"{n} {k}" for n, k in columns)
    once = stored(map_arrow(ranged, _inside(texts), schema([("conv", "long"), *_ROW, *_RESULT])))
    results = [("conv", "long"), *_RESULT]
    inside = once.where("pos is null").select(*[n for n, _ in results])
    cut = once.where("pos is not null").select("conv", *[n for n, _ in _ROW])
    present = cut.where("not gone")
    one, two = hash_pair(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    hashed = present.select("conv", "pos", F.left("role", F.lit(1)).alias("initial"), _end("text").alias("end"), one.alias("one"), two.alias("two"))
    first = hashed.groupBy(F.col("conv").alias("c"), F.col("one").alias("o"), F.col("two").alias("t")).agg(F.min("pos").alias("least"))
    met = hashed.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")))
    fault = F.when(F.col("end") == "", "b").when(F.col("pos") > F.col("least"), "d").when(~F.col("end").isin(*ENDS), "t").otherwise("k")
    marked = met.select("conv", "pos", "initial", fault.alias("fault")).repartitionByRange("conv", "pos").sortWithinPartitions("conv", "pos")
    whole = _reduced(map_arrow(marked, _cut, _PIECE_SCHEMA))
    answers = map_arrow(whole.drop("first", "opens", "closes"), _answers, schema([("conv", "long"), *_RESULT[1:7]]))
    empty = lambda columns: [F.lit(None).cast(k).alias(n) for n, k in columns]
    header = answers.select("conv", F.lit(-1).cast("long").alias("pos"), *empty(_ROW[1:4]), F.lit(True).alias("gone"), *[n for n, _ in _RESULT[1:7]])
    stream = cut.select("*", *empty(_RESULT[1:7])).unionByName(header).repartition("conv").sortWithinPartitions("conv", "pos")
    long = map_arrow(stream, _streamed(texts), schema(results))
    out = inside.unionByName(long).withColumnRenamed("conv", "conv_id")
    return out if texts else out.drop("repaired")


def _end(name: str) -> Column:
    """The last character that is no ASCII white space; empty if there is none."""
    return F.right(F.rtrim(F.col(name), F.lit(SPACE)), F.lit(1))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations rows with the contract's faults, by crc32(`conv_id:turn`) % 20; dropped rows stay, marked gone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _oracle() -> str:
    """The contract in SQL: the four states as strings of padded cost and audit, so that the least string is the cheapest and least audit."""
    add = lambda s, cost, edit: f"(lpad(CAST(CAST(left({s}, 10) AS INT) + {cost} AS VARCHAR), 10, '0') || substr({s}, 11) || '{edit}')"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def closed(source: str) -> str:
        two = least("s2", *(add(s, INSERT, "I") for s in ("s0", "s1", "s3")))
        return f"(SELECT * EXCLUDE (s3), {least('s3', add('s2', INSERT, 'I'))} AS s3 FROM (SELECT * EXCLUDE (s2), {two} AS s2 FROM {source}))"

    edit = lambda s, cost, letter, when: f"CASE WHEN {when} THEN {add(s, cost, letter)} END"
    more, may = f"{REPAIR} * (fault = 't')::INT", "fault NOT IN ('b', 'd')"
    to_user = [edit(s, f"{more} + {c}", e, f"{may} AND {w}") for s in ("s0", "s1", "s3") for c, e, w in ((KEEP, "K", "initial = 'u'"), (REROLE, "R", "TRUE"))]
    to_other = [edit("s2", f"{more} + {c}", e, f"{may} AND {w}") for c, e, w in ((KEEP, "K", "initial = 'a'"), (REROLE, "R", "TRUE"))]
    step = f"""SELECT conv, n + 1 AS n, {add('s0', DELETE, 'D')} AS s0, {least(add('s1', DELETE, 'D'), edit('s0', f'{more} + {KEEP}', 'K', f"{may} AND initial = 's'"))} AS s1,
      {least(add('s2', DELETE, 'D'), *to_user)} AS s2, {least(add('s3', DELETE, 'D'), *to_other)} AS s3"""
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
raw AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT raw.* EXCLUDE (key), xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::UBIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 20 AS kind FROM raw, crc),
hurt AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial, rtrim(text, {space}) AS bare FROM hurt),
said AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN n > min(n) OVER (PARTITION BY conv, role, text) THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
  lag(initial) OVER (PARTITION BY conv ORDER BY n) AS before FROM placed),
way AS (SELECT DISTINCT conv, 0::BIGINT AS n, '0000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM said
  UNION ALL {step} FROM {closed("(SELECT way.*, said.initial, said.fault FROM way JOIN said ON way.conv IS NOT DISTINCT FROM said.conv AND said.n = way.n + 1)")}),
best AS (SELECT conv, {least("s0", "s3")} AS s FROM {closed("(SELECT * FROM way QUALIFY n = max(n) OVER (PARTITION BY conv))")}),
letters AS (SELECT conv, unnest(range(1, length(s) - 9)) AS pos, s FROM best),
edits AS (SELECT conv, pos, s[10 + pos] AS edit, sum((s[10 + pos] <> 'I')::INT) OVER w AS n, sum((s[10 + pos] <> 'D')::INT) OVER w AS line FROM letters WINDOW w AS (PARTITION BY conv ORDER BY pos)),
named AS (SELECT e.*, r.role, r.text, max((e.edit = 'K' AND e.line = 1 AND r.initial = 's')::INT) OVER (PARTITION BY e.conv) AS system FROM edits e LEFT JOIN said r ON e.edit <> 'I' AND e.conv IS NOT DISTINCT FROM r.conv AND e.n = r.n WHERE e.edit <> 'D'),
texts AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text FROM named GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM said GROUP BY conv)
SELECT c.conv AS conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal,
  coalesce(CAST(left(b.s, 10) AS BIGINT), 0) AS cost, coalesce(substr(b.s, 11), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS conv FROM conversations) c LEFT JOIN counts k ON k.conv IS NOT DISTINCT FROM c.conv LEFT JOIN best b ON b.conv IS NOT DISTINCT FROM c.conv LEFT JOIN texts t ON t.conv IS NOT DISTINCT FROM c.conv"""


OP11_SQL = _oracle()


def op11_conversation_repair(spark, sf_dir):
    """All conversations, damaged as the contract says, and repaired."""
    return repair(damaged(documents(spark, sf_dir, "conversations")), gone=F.col("gone"))

"""Conversation structure repair: the cheapest edits that make the roles of a conversation fit a grammar.

Three weighted automata are composed. The input accepts the conversation's rows, each a symbol of role initial and fault; the
edit transducer keeps a row (0), gives it another role (2), deletes it (3), or inserts an empty row (2), keeping a
truncated row costs 1 more, and blank or duplicate rows can only be deleted; the grammar accepts ``(s?(ua)+)?``. Arcs of the
composition are made when a state first asks for them. Its states are (row, inserts since, grammar state), without cycles, and
the shortest path is found from the end: weights are pairs of cost and label string, and while ``a < b`` gives ``xa < xb``,
it does not give ``ax < bx``, so strings may only grow at their front. From one state all arcs differ in their label,
so the least string is that of the least label, and costs with one label for each state and row say it all.

Rows are sorted by conversation, turn (nulls first), role and text over range partitions, so a conversation of any
length is spread over tasks. Those that lie inside a partition and have at most ``CHUNK`` rows and ``CHARACTERS`` are solved there. The first and last of
a partition, and longer ones, go on as chunks: each chunk is a matrix of least costs from grammar state to grammar state;
their products from the end give the costs behind each chunk; with these a chunk's path is found from each of the four states, and
following them from the first chunk on tells which one is taken. Only the digest of a conversation's whole text, and its
audit, one cell each by nature, meet in one task, which reads the rows in order and holds one at a time.

Defined results: null turn comes first and counts for no gap; null role or text counts as the empty string (the query puts
a space there); a null conv_id is a conversation; equal rows of one turn are interchangeable, others of one turn go by role and
text; a conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written

#: Rows and characters that a task holds of one conversation.
CHUNK, CHARACTERS = 50_000, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
NONE = 1 << 60

# The grammar: states, moves by role initial, and states in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = {START, ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where the one role that may be put in leads from each state.
PUT = {q: to for (q, role), to in MOVES.items() if to in ROLES}
LEGAL = {"su", "ua", "au"}

SOLVED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in SOLVED.split(", ")]


def fault(text: str) -> str:
    """b: blank, t: truncated, n: none."""
    end = text.rstrip(BLANK)
    return "b" if not end else "n" if end[-1] in ".!?" else "t"


def symbol(role: str, what: str) -> str:
    """Role initial (``-`` for one that the grammar does not know) and fault (d: duplicate)."""
    return (role[0] if role[:1] in ("s", "u", "a") and role else "-") + what


# ---- composition and shortest path --------------------------------------------------------------


@lru_cache(maxsize=None)
def arcs(q: int, row: str) -> list[tuple[str, int, int]]:
    """label, cost, next state of the composed automaton for a row met in a grammar state."""
    edits: list[tuple[str, int, str | None]] = [("D", DELETE, None)]
    if row[1] not in "bd":
        late = TRUNCATED if row[1] == "t" else 0
        edits += [("K", KEEP + late, row[0]), ("R", REROLE + late, "u"), ("R", REROLE + late, "a")]
    reached = [(label, cost, q if out is None else MOVES.get((q, out))) for label, cost, out in edits]
    return [(label, cost, to) for label, cost, to in reached if to is not None]


def _with_inserts(best: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """No state is more than two inserts away from another, and coming back to one never pays."""
    for _ in range(2):
        best = [min(best[q], (min(NONE, INSERT + best[PUT[q]][0]), "I")) for q in STATES]
    return best


def _lowered(best: list[tuple[int, str]]) -> tuple[int, tuple[int, ...], str]:
    low = min(cost for cost, _ in best)
    low = 0 if low >= NONE else low
    return low, tuple(cost - low if cost < NONE else NONE for cost, _ in best), "".join(label for _, label in best)


@lru_cache(maxsize=1 << 16)
def _before(row: str, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """Least cost in front of a row, what each state costs above it, and the label each state takes, by the costs behind it."""
    return _lowered(_with_inserts([min((min(NONE, cost + behind[to]), label) for label, cost, to in arcs(q, row)) for q in STATES]))


def ends() -> list[int]:
    """Costs behind the last row."""
    return [cost for cost, _ in _with_inserts([(0, "") if q in ENDS else (NONE, "") for q in STATES])]


def backwards(rows: list[str], behind: Iterable[int]) -> tuple[list[int], list[str]]:
    """Costs of the states in front of the rows, and each row's labels by state."""
    total, costs, _ = _lowered([(c, "") for c in behind])
    taken = []
    for row in reversed(rows):
        more, costs, labels = _before(row, costs)
        total += more
        taken.append(labels)
    return [total + c if c < NONE else NONE for c in costs], taken[::-1]


def forwards(rows: list[str], taken: list[str], q: int, last: bool) -> tuple[str, int]:
    """The labels of the path from a state, and where it leads."""
    audit = []
    for row, labels in zip(rows, taken, strict=True):
        while labels[q] == "I":
            audit.append("I")
            q = PUT[q]
        audit.append(labels[q])
        q = next(to for label, _, to in arcs(q, row) if label == labels[q])
    while last and q not in ENDS:
        audit.append("I")
        q = PUT[q]
    return "".join(audit), q


class Edited:
    """Takes the rows of a conversation one by one; gives label, role and text of those that stay or come in."""

    def __init__(self) -> None:
        self.q, self.audit, self.at = START, "", 0

    def chunk(self, audit: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        self.audit, self.at = audit, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.q = PUT[self.q]
            yield "I", ROLES[self.q], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        label = self.audit[self.at]
        self.at += 1
        if label != "D":
            self.q = MOVES[self.q, role[0]] if label == "K" else PUT[self.q]
            yield label, role if label == "K" else ROLES[self.q], text


class Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self) -> None:
        self.hash, self.between = hashlib.sha256(), b""

    def add(self, edited: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in edited:
            self.hash.update(self.between + role.encode() + b":" + text.encode())
            self.between = b"\n"


def illegal(rows: list[str]) -> int:
    return sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))


def solved(rows: list[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Results and repaired rows of a whole conversation of (turn, role, text)."""
    seen: set[tuple[str, str]] = set()
    symbols = []
    for _, role, text in rows:
        what = fault(text)
        symbols.append(symbol(role, "d" if what != "b" and (role, text) in seen else what))
        seen.add((role, text))
    costs, taken = backwards(symbols, ends())
    audit, _ = forwards(symbols, taken, START, True)
    edited, digest = Edited(), Digest()
    out = [*edited.chunk(audit)]
    for _, role, text in rows:
        out += edited.row(role, text)
    out += edited.inserted()
    digest.add(out)
    turns = {t for t, _, _ in rows if t is not None}
    count = lambda x: sum(s[1] == x for s in symbols)
    values = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("b"), count("d"), count("t"), illegal(symbols), costs[START], audit, digest.hash.hexdigest()]
    return dict(zip(NAMES, values, strict=True)), out


# ---- the whole table ----------------------------------------------------------------------------


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(sql: str, id_type: pa.DataType) -> pa.Schema:
    """An Arrow schema for conv_id and these columns."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([("conv_id", id_type), *[(c.split()[0], kinds[c.split()[1]]) for c in sql.split(", ")]])


PASS = f"chunk long, place long, turn long, role string, text string, code string, edit string, {SOLVED}"


def _sorted_rows(emit_rows: bool, chunk_rows: int):
    """Sorted rows (conv_id, turn, role, text, present) to results of conversations inside the partition (or their repaired rows), and the rows of the others by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []
        first, long, chunk, place = True, False, TaskContext.get().partitionId() << 32, 0
        current, held, weight, any_row = object(), [], 0, False

        def passed() -> Iterator[tuple]:
            """Held rows as rows of chunks."""
            nonlocal place, chunk, weight
            for turn, role, text, present in held:
                if place and place % chunk_rows == 0:
                    chunk += 1
                yield (current, chunk, place, turn, role, text, symbol(role, fault(text)) if present else "m", None, *[None] * len(NAMES))
                place += 1
            held.clear()
            weight = 0

        def ended(last: bool) -> None:
            nonlocal first, long, chunk, place, weight
            if first or long or last:
                out.extend(passed())
                chunk, place = chunk + 1, 0
            else:
                values, rows = solved([(t, r, x) for t, r, x, present in held if present])
                held.clear()
                weight = 0
                if emit_rows:
                    out.extend((current, None, k, None, role, text, None, edit, *[None] * len(NAMES)) for k, (edit, role, text) in enumerate(rows))
                else:
                    out.append((current, *[None] * 7, *values.values()))
            first = long = False

        for batch in batches:
            schema = schema or _arrow(PASS, batch.column(0).type)
            for conv, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not any_row or conv != current:
                    if any_row:
                        ended(False)
                    current, any_row = conv, True
                held.append(row)
                weight += len(row[2])
                if len(held) >= chunk_rows or weight > CHARACTERS:
                    long = True
                    out.extend(passed())
            if out:
                yield _batch(out, schema)
                out.clear()
        if any_row:
            ended(True)
        if out:
            yield _batch(out, schema)

    return run


SEGMENT = "chunk long, symbols string, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, matrix string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be known of each chunk: its symbols, counts and matrix of costs."""
    for batch in batches:
        rows = []
        for conv, chunk, entries in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            of_place = {e["place"]: e for e in entries if e["code"]}
            first = {e["place"] for e in entries if not e["code"]}
            order = [of_place[p] for p in sorted(of_place) if of_place[p]["code"] != "m"]
            symbols = [e["code"] if e["code"][1] == "b" or e["place"] in first else e["code"][0] + "d" for e in order]
            turns = [e["turn"] for e in order if e["turn"] is not None]
            unit = lambda r: [0 if q == r else NONE for q in STATES]
            matrix = [backwards(symbols, unit(r))[0] for r in STATES]  # by exit, then entry
            count = lambda x: sum(s[1] == x for s in symbols)  # noqa: E731, B023
            rows.append((
                conv, chunk, "".join(symbols), count("b"), count("d"), count("t"), illegal(symbols), symbols[0] if symbols else None, symbols[-1] if symbols else None,
                min(turns, default=None), max(turns, default=None), len(set(turns)), " ".join(str(c) for line in matrix for c in line),
            ))
        if rows:
            yield _batch(rows, _arrow(SEGMENT, batch.column(0).type))


BEHIND = "chunk long, behind string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _combined(table: pa.Table) -> pa.Table:
    """For the chunks of one conversation the costs behind each; with the first one the conversation's numbers."""
    chunks = sorted(table.to_pylist(), key=lambda x: x["chunk"])
    behind = ends()
    out = []
    for x in reversed(chunks):
        matrix = [int(c) for c in x["matrix"].split()]
        out.append((x["conv_id"], x["chunk"], " ".join(map(str, behind))))
        behind = [min(min(NONE, matrix[4 * r + q] + behind[r]) for r in STATES) for q in STATES]
    full = [x for x in chunks if x["symbols_n"]]
    turns = [x for x in full if x["turns"]]
    meeting = sum(a["most"] == b["least"] for a, b in zip(turns, turns[1:], strict=False))
    gaps = turns[-1]["most"] - turns[0]["least"] + 1 - (sum(x["turns"] for x in turns) - meeting) if turns else 0
    total = lambda c: sum(x[c] for x in full)
    apart = sum(a["last"][0] + b["first"][0] not in LEGAL for a, b in zip(full, full[1:], strict=False))
    numbers = (gaps, total("blank"), total("duplicate"), total("truncated"), total("illegal") + apart, behind[START])
    rows = [(*row, *(numbers if k == 0 else [None] * 6)) for k, row in enumerate(reversed(out))]
    return pa.Table.from_batches([_batch(rows, _arrow(BEHIND, table.schema.field("conv_id").type))])


PATHS = "chunk long, audits string, exits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path through a chunk from each of the four states, and where it leads."""
    for batch in batches:
        rows = []
        for conv, chunk, symbols, behind, last, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = [symbols[k : k + 2] for k in range(0, len(symbols), 2)]
            _, taken = backwards(own, map(int, behind.split()))
            ways = [forwards(own, taken, q, last) for q in STATES]
            rows.append((conv, chunk, ",".join(audit for audit, _ in ways), "".join(str(q) for _, q in ways), *numbers))
        if rows:
            yield _batch(rows, _arrow(PATHS, batch.column(0).type))


def _chained(table: pa.Table) -> pa.Table:
    """The state in which each chunk of a conversation begins."""
    q, rows = START, []
    for x in sorted(table.to_pylist(), key=lambda x: x["chunk"]):
        rows.append((x["conv_id"], x["chunk"], q))
        q = int(x["exits"][q])
    return pa.Table.from_batches([_batch(rows, _arrow("chunk long, entry int", table.schema.field("conv_id").type))])


def _streamed(emit_rows: bool):
    """Rows in order, each chunk's audit in front of it, to the results or the repaired rows of their conversations; one row is held at a time."""
    schema_of = "place long, role string, text string, edit string" if emit_rows else SOLVED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, place = None, [], 0
        current, state, digest, audits, numbers = None, None, None, [], None

        def put(edited: Iterable[tuple[str, str, str]]) -> None:
            nonlocal place
            if emit_rows:
                for edit, role, text in edited:
                    out.append((current, place, role, text, edit))
                    place += 1
            else:
                digest.add(edited)

        def ended() -> None:
            put(state.inserted())
            if not emit_rows:
                out.append((current, *numbers, "".join(audits), digest.hash.hexdigest()))

        for batch in batches:
            schema = schema or _arrow(schema_of, batch.column(0).type)
            for conv, place_in, role, text, code, audit, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        ended()
                    current, state, digest, audits, place = conv, Edited(), Digest(), [], 0
                if place_in < 0:
                    put(state.chunk(audit))
                    audits.append(audit)
                    numbers = own if own[0] is not None else numbers
                elif code != "m":
                    put(state.row(role, text))
            if out:
                yield _batch(out, schema)
                out.clear()
        if state is not None:
            ended()
        if out:
            yield _batch(out, schema)

    return run


def _solve(rows: DataFrame, present: str | None, emit_rows: bool, chunk_rows: int) -> DataFrame:
    ship_package(rows.sparkSession)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.col(present) if present else F.lit(True)).alias("present"), F.monotonically_increasing_id().alias("row"))
    # Equal rows may lie in several partitions, and the bounds hold short texts.
    ordered = slim.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64), "row").sortWithinPartitions("conv_id", "turn", "role", "text", "row")
    done = written(ordered.select("conv_id", "turn", "role", "text", "present").mapInArrow(_sorted_rows(emit_rows, chunk_rows), f"conv_id {id_type}, {PASS}"), "conversations")
    results = ["conv_id", "place", "role", "text", "edit"] if emit_rows else ["conv_id", *NAMES]
    inside, across = done.where("code is null").select(results), done.where("code is not null")

    # Of equal rows of a conversation the first is none; it says so by a row of its own, so that nothing is joined.
    line = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    first = across.where("code <> 'm'").groupBy("conv_id", line.alias("line")).agg(F.min(F.struct("chunk", "place")).alias("at")).select("conv_id", "at.chunk", "at.place", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("turn"))
    entries = across.select("conv_id", "chunk", "place", "code", "turn").unionByName(first).groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("place", "code", "turn")).alias("entries"))
    segments = written(entries.mapInArrow(_segments, f"conv_id {id_type}, {SEGMENT}"), "segments")
    known = segments.withColumn("symbols_n", F.length("symbols")).drop("symbols").groupBy("conv_id").applyInArrow(_combined, f"conv_id {id_type}, {BEHIND}").drop("conv_id")
    final = segments.groupBy("conv_id").agg(F.max("chunk").alias("chunk")).select("chunk", F.lit(True).alias("is_last"))
    met = segments.select("conv_id", "chunk", "symbols").join(known, "chunk").join(final, "chunk", "left")
    numbers = NAMES[:6]
    paths = written(met.select("conv_id", "chunk", "symbols", "behind", F.coalesce("is_last", F.lit(False)), *numbers).mapInArrow(_paths, f"conv_id {id_type}, {PATHS}"), "paths")
    entry = paths.select("conv_id", "chunk", "exits").groupBy("conv_id").applyInArrow(_chained, f"conv_id {id_type}, chunk long, entry int").drop("conv_id")
    heads = paths.join(entry, "chunk").select("conv_id", "chunk", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("code"), F.get(F.split("audits", ",", -1), F.col("entry")).alias("audit"), *numbers)
    lines = across.select("conv_id", "chunk", "place", "role", "text", "code", F.lit("").alias("audit"), *[F.lit(None).cast("long").alias(c) for c in numbers])
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place").drop("chunk")
    schema = "place long, role string, text string, edit string" if emit_rows else SOLVED
    return inside.unionByName(stream.mapInArrow(_streamed(emit_rows), f"conv_id {id_type}, {schema}"))


def repair(rows: DataFrame, present: str | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, one row for each conversation. Rows whose column ``present`` is false only name a conversation."""
    return _solve(rows, present, False, chunk_rows)


def repaired(rows: DataFrame, present: str | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I): the rows of the repaired conversations."""
    return _solve(rows, present, True, chunk_rows)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows with the faults that the query's contract plants; a dropped row stays to name its conversation."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.encode(F.concat(some("conv_id"), F.lit(":"), some("turn")), "UTF-8")) % 20
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    each = rows.select("conv_id", "turn", "role", "text", lot.alias("lot"))
    out = each.select("conv_id", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(some("role")).alias("role"), text.alias("text"), (F.col("lot") != 0).alias("present"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return out.drop("col")

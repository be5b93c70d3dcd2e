"""Repair of conversation structure by Wagner-Fischer target alignment.

The turns of a good conversation read `(s?(ua)+)?` in role initials. A conversation's turns
are aligned to that alternating string, cut at every feasible length: keeping a turn costs
0, giving it another role 2, deleting it 3, inserting an empty one 2; blank and repeated
turns must go, and a truncated turn that stays adds 1. All lengths share one table, as each
target is a prefix of the next. The cost of a plain repair bounds it: cells and lengths that
cannot beat that incumbent are left out (Ukkonen's band). Every length of the least cost is
traced back to its ASCII-least audit, and the least audit wins.

A conversation is read as a stream of sorted turns in segments of SEGMENT turns, each
aligned from every role that can stand before it to every role that can end it. Two audits
of equal cost over the same turns and ends are never prefixes of one another, so joining
best segments gives the best whole. What all remaining alternatives agree on is written
out at once: a long conversation is never held, unless its first edit hangs on its last turn.

Defined cases: nulls count as one space, except that a null turn stays null, sorts first and
has no gap, and that a null conv_id is a conversation of its own. Rows of equal turn are
ordered by role and text. A role counts by its first character, so a foreign role that
begins with s, u or a may be kept. An empty table gives no rows. Other columns are left
behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
SPACE = " \t\n\x0b\x0c\r"
START = "^"  # nothing written yet
EDITS = "conv_id long, step long, edit string, turn long, old_role string, fault string, role string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROLES = {"u": "user", "a": "assistant"}
BATCH_CHARS = 4_000_000


# ---- rows ----


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fate for every row by crc32 of `conv_id:turn`."""
    fate = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    role, text = _or_space("role"), _or_space("text")
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(fate != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns of whole conversations per task, in order, with their first fault or null.

    One shuffle: the window over (conv_id, role, text) reuses the partitions by conv_id.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text")
    )
    order = [F.col("turn").asc_nulls_first()]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(body == "", F.lit("blank"))
        .when(seen > 1, F.lit("duplicate"))
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    )
    placed = rows.repartition("conv_id").withColumn("fault", fault)
    return placed.sortWithinPartitions("conv_id", *order, "role", "text")


# ---- alignment of one segment ----


def _code(role: str, fault: str | None) -> str:
    """One character for all that alignment asks of a turn; - must go, capitals are truncated."""
    if fault in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def _match(code: str, target: str) -> tuple[int, str] | None:
    """Cost and edit of letting a turn stand for a target role."""
    late = 1 if code.isupper() else 0
    if code.lower() == target:
        return late, "K"
    if code == "-" or target == "s":
        return None
    return 2 + late, "R"


def _incumbent(codes: str, target: str) -> int:
    """Cost of a plain repair: delete what must go, give the rest its role, and add up to
    two turns, which reaches either last role."""
    cost = at = 0
    for code in codes:
        found = _match(code, target[at])
        if found is None:
            cost += 3
        else:
            cost, at = cost + found[0], at + 1
    return cost + 4


def _table(codes: str, target: str, bound: int) -> list[dict[int, int]]:
    """Row i: least cost of bringing i turns to the first j target roles, inside the band."""
    must = [0]
    for code in codes:
        must.append(must[-1] + (code == "-"))
    rows: list[dict[int, int]] = []
    for i in range(len(codes) + 1):
        spare = bound - 3 * (must[-1] - must[i])  # what the turns so far may cost
        low = max(0, i - spare // 3)
        high = i - must[i] + max(0, spare - 3 * must[i]) // 2
        row: dict[int, int] = {}
        for j in range(low, min(high, len(target) - 1) + 1):
            costs = [0] if i == j == 0 else []
            if i:
                above = rows[i - 1]
                if j in above:
                    costs.append(above[j] + 3)
                if j and j - 1 in above and (found := _match(codes[i - 1], target[j - 1])):
                    costs.append(above[j - 1] + found[0])
            if j - 1 in row and target[j - 1] != "s":
                costs.append(row[j - 1] + 2)
            if costs and min(costs) <= spare:
                row[j] = min(costs)
        rows.append(row)
    return rows


def _audit(codes: str, target: str, rows: list[dict[int, int]], length: int) -> str:
    """The ASCII-least audit among all cheapest alignments to `length` roles.

    Traced back first to find the cells on a cheapest path, then read forward.
    """
    n = len(codes)

    def steps(i: int, j: int) -> Iterator[tuple[str, int, int]]:
        """Cheapest edits out of a cell, in the order of their letters."""
        here = rows[i][j]
        if i < n and rows[i + 1].get(j) == here + 3:
            yield "D", i + 1, j
        if target[j] != "s" and rows[i].get(j + 1) == here + 2:
            yield "I", i, j + 1
        if i < n and (found := _match(codes[i], target[j])) and rows[i + 1].get(j + 1) == here + found[0]:
            yield found[1], i + 1, j + 1

    on_path = [set() for _ in range(n + 1)]
    on_path[n].add(length)
    for i in range(n, -1, -1):
        for j in sorted(rows[i], reverse=True):
            if j < length and any(b in on_path[a] for _, a, b in steps(i, j)):
                on_path[i].add(j)
            elif j == length and i < n and any(b in on_path[a] for e, a, b in steps(i, j) if e != "I"):
                on_path[i].add(j)
    i = j = 0
    audit = []
    while (i, j) != (n, length):
        edit, i, j = next(s for s in steps(i, j) if s[2] <= length and s[2] in on_path[s[1]])
        audit.append(edit)
    return "".join(audit)


def _targets(state: str, n: int, has_system: bool) -> list[str]:
    pairs = "ua" * (n + 2)
    if state == "u":
        return [pairs[1:]]
    return [pairs, "s" + pairs] if state == START and has_system else [pairs]


@lru_cache(maxsize=1 << 16)
def align(codes: str, state: str, wanted: str) -> dict[str, tuple[int, str]]:
    """{last role: (cost, audit)} of the best edits of a segment that follows `state`.

    `wanted` names the last roles that matter.
    """
    n = len(codes)
    best: dict[str, tuple[int, str]] = {}
    if state in wanted:
        best[state] = (3 * n, "D" * n)
    if state == START and "s" in wanted:
        kept = [(3 * (n - 1) + c.isupper(), "D" * i + "K" + "D" * (n - 1 - i)) for i, c in enumerate(codes) if c in "sS"]
        if kept:
            best["s"] = min(kept)
    ends = [w for w in wanted if w in "ua"]
    for target in _targets(state, n, "s" in codes.lower()):
        plain = _incumbent(codes, target)
        bound = max((min(plain, best[e][0]) if e in best else plain for e in ends), default=0)
        rows = _table(codes, target, bound)
        for end in ends:
            lengths = [j for j in rows[n] if j and target[j - 1] == end and (target[0] != "s" or j > 1)]
            if not lengths:
                continue
            cost = min(rows[n][j] for j in lengths)
            if end in best and best[end][0] < cost:
                continue
            found = min((cost, _audit(codes, target, rows, j)) for j in lengths if rows[n][j] == cost)
            best[end] = min(best.get(end, found), found)
    return best


# ---- streams ----


def _next(state: str, edit: str, role: str) -> str:
    if edit == "D":
        return state
    return role[:1] if edit == "K" else "a" if state == "u" else "u"


class Repair:
    """Edits of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.base, self.step = START, 0
        self.paths: dict[str, tuple[int, str]] = {START: (0, "")}  # since `base`
        self.held: list[tuple] = []  # turns the paths cover, then the open segment
        self.open = 0

    def add(self, turn: tuple) -> list[tuple]:
        self.held.append(turn)
        self.open += 1
        return self._close("^sua") if self.open == SEGMENT else []

    def end(self) -> list[tuple]:
        done = self._close("^a")
        _, audit = min(self.paths.values())
        return done + self._write(audit)

    def _close(self, wanted: str) -> list[tuple]:
        segment = self.held[len(self.held) - self.open :]
        codes = "".join(_code(role, fault) for _, role, _, fault in segment)
        reached: dict[str, tuple[int, str, str]] = {}
        for state, (cost, audit) in self.paths.items():
            for end, (more, edits) in align(codes, state, wanted).items():
                found = (cost + more, audit + edits, state)
                reached[end] = min(reached.get(end, found), found)
        u = reached["u"][0] if "u" in reached else 1 << 60
        a = reached["a"][0] if "a" in reached else 1 << 60
        near = min(a, u + 2)  # an insertion leads from u to a; from a, a late system turn costs 3
        limit = {START: near + 3, "s": near, "u": a + 2, "a": u + 2}
        reached = {s: p for s, p in reached.items() if p[0] <= limit[s]}
        self.open, done = 0, []
        origins = {p[2] for p in reached.values()}
        if len(origins) == 1:
            cost, audit = self.paths[origins.pop()]
            reached = {s: (p[0] - cost, p[1][len(audit) :], "") for s, p in reached.items()}
            done = self._write(audit)
        self.paths = {s: p[:2] for s, p in reached.items()}
        return done

    def _write(self, audit: str) -> list[tuple]:
        """Take `audit` off the front: rows of EDITS without their conv_id."""
        out, at = [], 0
        for edit in audit:
            turn, role, text, fault = (None, None, "", None) if edit == "I" else self.held[at]
            at += edit != "I"
            self.base = _next(self.base, edit, role or "")
            new_role = role if edit == "K" else None if edit == "D" else ROLES[self.base]
            out.append((self.step, edit, turn, role, fault, new_role, None if edit == "D" else text))
            self.step += 1
        del self.held[:at]
        return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(first of its group, row) of rows sorted by their first column."""
    last = object()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[0] != last, row
            last = row[0]


def repair(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: EDITS.

    A deleted turn has no role and text, an inserted one no turn, old role or fault. Rows of
    a conversation lie together and in the order of `step`.
    """
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in EDITS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, owner, work = 0, None, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for first, (conv_id, *turn) in _grouped(batches):
            if first and work is not None:
                rows += [(owner, *r) for r in work.end()]
            if first:
                owner, work = conv_id, Repair()
            rows += [(owner, *r) for r in work.add(tuple(turn))]
            size += len(turn[2]) + 64
            if size > BATCH_CHARS and rows:
                yield batch()
                rows, size = [], 0
        if work is not None:
            rows += [(owner, *r) for r in work.end()]
        if rows:
            yield batch()

    return with_faults(turns).mapInArrow(run, EDITS)


class _Summary:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.audit, self.sha = conv_id, [], hashlib.sha256()
        self.low = self.high = self.last = None
        self.distinct = self.illegal = self.cost = self.written = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.before: str | None = None

    def add(self, edit, turn, old_role, fault, role, text) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            initial = old_role[:1]
            if self.before is not None:
                self.illegal += (self.before, initial) not in (("s", "u"), ("u", "a"), ("a", "u"))
            self.before = initial
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.last
                self.high = self.last = turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            self.written += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of `repair`'s result as it stands: SUMMARY. No shuffle."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in SUMMARY.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        work: _Summary | None = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for first, (conv_id, _, *edit) in _grouped(batches):
            if first:
                if work is not None:
                    rows.append(work.row())
                work = _Summary(conv_id)
            work.add(*edit)
            if len(rows) >= 10_000:
                yield batch()
                rows = []
        if work is not None:
            rows.append(work.row())
        if rows:
            yield batch()

    return edits.mapInArrow(run, SUMMARY)


def repaired_summaries(conversations: DataFrame) -> DataFrame:
    """SUMMARY of every conv_id after damage and repair; zeros where no row is left."""
    found = summaries(repair(damaged(conversations)))
    named = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    joined = named.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    columns = [c for c in found.columns if c != "conv_id"]
    return joined.select(F.col("_id").alias("conv_id"), *(F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in columns))

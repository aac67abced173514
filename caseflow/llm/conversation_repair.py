"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows, in order of turn, are edited at least cost until the
initials of the roles read ``(s?(ua)+)?``.  Edits: Keep, Rerole (to user or
assistant), Delete, Insert (an empty user or assistant turn).  The edits form a
lattice of nodes (rows consumed, state of the pattern) with integer costs.

The auction (Bertsekas 1991) keeps a price per node and a path.  At the end of
the path, the cheapest arc plus the price behind it is looked at: if it exceeds
the node's own price, the price rises to it and the path contracts by this
node, otherwise the path extends along the arc.  Prices never pass the distance
to the goal, so when the path arrives, its nodes carry exact distances.  Nodes
are taken as origins from the last row back, and a path also arrives at a node
that an earlier path has settled, so the work is linear in the rows.  Arcs
whose cost equals the drop of the prices are tight; every shortest path runs
along tight arcs only, and the one with the ASCII-least initials is traced by
taking the least letter at each node (a letter determines the next state).

The job: rows are numbered by a range sort of narrow rows, so that a
conversation may lie in many partitions, and cut into pieces of at most
``PIECE`` rows.  One auction per piece and goal gives the costs between its
entry and exit states; one auction over a conversation's pieces (one small row
per ``PIECE`` rows) gives the prices at the borders; with these each piece is
traced for itself.  Only the hash of a repaired conversation is sequential: its
rows stream, sorted, through one task that holds one batch of them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import WS_CHARS, written

PIECE = 1024

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: states of the pattern: nothing yet, after s, after u, after a
STATES = range(4)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}                      # by an inserted or re-roled turn
ROLE_CODE = {"s": 1, "u": 2, "a": 3}                 # any other initial: 0
NONE, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60
#: cost of ending in each state: two, one or no inserted turns are missing
END = [0, 2 * INSERT, INSERT, 0]

Arc = tuple[str, int, int, int]                      # letter, cost, layer, state


def auction(layers: int, arcs: Callable[[int, int], list[Arc]], goal: list[int]) -> list[list[int]]:
    """Exact distances to the goal for every node (layer, state) of a lattice
    with ``layers`` layers before the last, whose prices ``goal`` are fixed."""
    price = [[0] * 4 for _ in range(layers)] + [list(goal)]
    settled = {(layers, s) for s in STATES}
    for layer in range(layers - 1, -1, -1):
        for state in STATES:
            path = [(layer, state)]
            while path[-1] not in settled:
                i, s = path[-1]
                best, at = FAR, None
                for _, cost, j, t in arcs(i, s):
                    if cost + price[j][t] < best:
                        best, at = cost + price[j][t], (j, t)
                if at is None or price[i][s] < best:          # contraction
                    price[i][s] = best
                    if at is None:                            # the goal cannot be reached from here
                        settled.add((i, s))
                    if len(path) > 1:
                        path.pop()
                else:                                         # extension
                    path.append(at)
            settled.update(path)
    return price


def row_arcs(codes: list[int]) -> Callable[[int, int], list[Arc]]:
    """Arcs of the lattice of rows; a code is role * 4 + fault."""
    def arcs(i: int, s: int) -> list[Arc]:
        role, fault = divmod(codes[i], 4)
        out = [("D", DELETE, i + 1, s), ("I", INSERT, i, NEXT[s])]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if (role == 1 and s == 0) or (role > 1 and role == NEXT[s]):
                out.append(("K", KEEP + extra, i + 1, role))
            out.append(("R", REROLE + extra, i + 1, NEXT[s]))
        return out
    return arcs


def trace(codes: list[int], price: list[list[int]], state: int) -> tuple[str, int]:
    """Least initials along tight arcs from the first layer, and the state
    behind the last row."""
    arcs, i, letters = row_arcs(codes), 0, []
    while i < len(codes):
        letter, _, i, state = min(a for a in arcs(i, state) if price[i][state] == a[1] + price[a[2]][a[3]])
        letters.append(letter)
    return "".join(letters), state


def _towards(goal: int, arcs: Callable[[int, int], list[Arc]]) -> Callable[[int, int], list[Arc]]:
    """The arcs without those after which ``goal`` is out of reach: nothing
    leads back to the first two states."""
    return arcs if goal > 1 else lambda i, s: [a for a in arcs(i, s) if a[3] <= goal]


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs between entry and exit states of every piece, and its counts."""
    for batch in batches:
        costs, illegal, distinct, rows = [], [], [], batch.column("rows").to_pylist()
        for piece in rows:
            codes = [r["code"] for r in piece]
            table = [auction(len(codes), _towards(e, row_arcs(codes)), [0 if s == e else FAR for s in STATES])[0]
                     for e in STATES]
            costs.append([table[e][s] for s in STATES for e in STATES])
            roles, turns = [c // 4 for c in codes], [r["turn"] for r in piece]
            illegal.append(sum(p not in ((1, 2), (2, 3), (3, 2)) for p in zip(roles, roles[1:], strict=False)))
            distinct.append(len({t for t in turns if t is not None}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("piece"), pa.array(costs, pa.list_(pa.int64())),
             pa.array(illegal, pa.int64()), pa.array(distinct, pa.int64()),
             *(pa.array([f(p) for p in rows], pa.int64()) for f in (
                 lambda p: p[0]["code"] // 4, lambda p: p[-1]["code"] // 4,
                 lambda p: min((r["turn"] for r in p if r["turn"] is not None), default=None),
                 lambda p: max((r["turn"] for r in p if r["turn"] is not None), default=None),
                 *(lambda p, f=f: sum(r["code"] % 4 == f for r in p) for f in (BLANK, DUPLICATE, CUT))))],
            names=["conv_id", "piece", "costs", "illegal", "turns", "role_a", "role_z", "turn_a", "turn_z",
                   "blank", "duplicate", "truncated"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its total cost, illegal pairs and distinct turns, and
    the prices behind each of its pieces."""
    for batch in batches:
        out = {k: [] for k in ("cost", "illegal", "turns", "behind")}
        for pieces in batch.column("pieces").to_pylist():
            def arcs(k: int, s: int, pieces=pieces) -> list[Arc]:
                return [("", c, k + 1, e) for e, c in enumerate(pieces[k]["costs"][4 * s:4 * s + 4]) if c < FAR]
            # an inserted turn between two pieces belongs to the later one
            price = auction(len(pieces), arcs, END)
            pairs = list(zip(pieces, pieces[1:], strict=False))
            out["cost"].append(price[0][0])
            out["illegal"].append(sum(p["illegal"] for p in pieces) + sum(
                (a["role_z"], b["role_a"]) not in ((1, 2), (2, 3), (3, 2)) for a, b in pairs))
            out["turns"].append(sum(p["turns"] for p in pieces) - sum(
                a["turn_z"] is not None and a["turn_z"] == b["turn_a"] for a, b in pairs))
            out["behind"].append([{"piece": p["piece"], "last": k == len(pieces) - 1, "price": price[k + 1]}
                                  for k, p in enumerate(pieces)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(out[k], pa.int64()) for k in ("cost", "illegal", "turns")),
             pa.array(out["behind"], pa.list_(pa.struct([("piece", pa.int64()), ("last", pa.bool_()),
                                                         ("price", pa.list_(pa.int64()))])))],
            names=["conv_id", "cost", "illegal", "turns", "behind"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and exit state of every piece for each entry state; the turns
    missing behind a conversation's last row are in its last piece's letters."""
    for batch in batches:
        letters, exits = [], []
        for piece, goal, last in zip(*(batch.column(c).to_pylist() for c in ("rows", "price", "last")), strict=True):
            codes = [r["code"] for r in piece]
            price = auction(len(codes), row_arcs(codes), goal)
            found = [trace(codes, price, s) if price[0][s] < FAR else ("", s) for s in STATES]
            letters.append([t + "I" * (END[e] // INSERT) if last else t for t, e in found])
            exits.append([e for _, e in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("first"), pa.array(letters, pa.list_(pa.string())),
             pa.array(exits, pa.list_(pa.int64()))], names=["conv_id", "first", "letters", "exits"])


class _Writer:
    """The repaired conversation, hashed row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.entry = conv_id, 0, 0
        self.sha, self.empty, self.audit, self.todo = hashlib.sha256(), True, [], deque()

    def line(self, role: str, text: str):
        self.sha.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def add(self, letters: list[str], exits: list[int]):
        self.audit.append(letters[self.entry])
        self.todo.extend(letters[self.entry])
        self.entry = exits[self.entry]

    def inserted(self):
        while self.todo and self.todo[0] == "I":
            self.todo.popleft()
            self.state = NEXT[self.state]
            self.line("user" if self.state == 2 else "assistant", "")

    def row(self, role: str, text: str):
        self.inserted()
        letter = self.todo.popleft()
        if letter == "K":
            self.state = ROLE_CODE[role[:1]]
            self.line(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.line("user" if self.state == 2 else "assistant", text)

    def done(self) -> dict:
        self.inserted()
        return {"conv_id": self.conv_id, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_WRITTEN = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows and, before the rows they are for, the letters of pieces."""
    now, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    out.append(now.done())
                now = _Writer(r["conv_id"])
            if r["letters"] is not None:
                now.add(r["letters"], r["exits"])
            else:
                now.row(r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _WRITTEN)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.done()], _WRITTEN)


def _rows(conversations: DataFrame) -> DataFrame:
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                known("role"), known("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage, decided by ``crc32("conv_id:turn") % 20``: 0 drops the row,
    1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets
    its role to user.  Nulls count as one space."""
    sign = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = _rows(conversations).withColumn("d", F.crc32(sign) % 20).where("d <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(conversations: DataFrame, ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """Cheapest repair of ``conversations(conv_id, turn, role, text)``.

    One row per conversation, and per further conv_id of ``ids``: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (see the
    module's text; a row counts under its first fault: no visible character;
    role and text of an earlier row; last visible character not ``.!?``).

    A null role or text counts as one space; rows of one turn go by role and
    hash of the text, null turns first; a null conv_id is a conversation of its
    own.  Repeated rows are duplicates.  A conversation without rows gets zeros,
    an empty audit and the hash of the empty string; an empty table gives an
    empty result.  Other columns are ignored.  Long texts take part as a whole
    and lie in one row of one batch; long conversations are cut into pieces.
    """
    rows = _rows(conversations).withColumn("h", F.md5("text"))
    key = ["conv_id", F.asc_nulls_first("turn"), "role", "h"]
    seen = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    fault = (F.when(seen == "", BLANK).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE))
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*(F.when(initial == c, n) for c, n in ROLE_CODE.items()), F.lit(0))
    narrow = rows.select("conv_id", "turn", "h", F.col("role"), fault.alias("fault"), role.alias("r"))
    spread = F.xxhash64(F.monotonically_increasing_id())              # equal rows may lie in several partitions
    narrow = written(narrow.withColumn("_", spread).repartitionByRange(*key, "_").sortWithinPartitions(*key, "_").drop("_")
                     .withColumn("ord", F.monotonically_increasing_id()), "turns")
    firsts = (narrow.groupBy("conv_id", "role", "h").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("q"), F.col("h").alias("g"), "first"))
    marked = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("q"))
                         & (F.col("h") == F.col("g")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("ord") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    # numbers count up within a partition, so a piece is a run of one conversation
    part = F.struct("ord", (F.col("r") * 4 + fault).cast("long").alias("code"), "turn", F.col("role"), "h")
    pieces = written(marked.groupBy("conv_id", F.expr(f"ord div {int(piece)}").alias("piece"))
                     .agg(F.sort_array(F.collect_list(part)).alias("rows"))
                     .withColumn("first", F.col("rows")[0]).withColumn(
                         "rows", F.transform("rows", lambda r: F.struct(r["code"], r["turn"]))), "pieces")
    sums = written(pieces.select("conv_id", "piece", "rows").mapInArrow(
        _transfers, "conv_id long, piece long, costs array<long>, illegal long, turns long, role_a long, role_z long, "
        "turn_a long, turn_z long, blank long, duplicate long, truncated long"), "transfers")
    narrow_sum = ["piece", "costs", "illegal", "turns", "role_a", "role_z", "turn_a", "turn_z"]
    each = sums.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*narrow_sum))).alias("pieces"))
    solved = written(each.mapInArrow(
        _borders, "conv_id long, cost long, illegal long, turns long, "
        "behind array<struct<piece:long,last:boolean,price:array<long>>>"), "borders")
    behind = solved.select(F.col("conv_id").alias("c"), F.inline("behind").alias("p", "last", "price"))
    traced = written(pieces.join(behind, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
                     .select("conv_id", "first", "rows", "last", "price").mapInArrow(
        _traces, "conv_id long, first struct<ord:long,code:long,turn:long,role:string,h:string>, "
        "letters array<string>, exits array<long>"), "traces")

    plans = traced.select("conv_id", "first.turn", "first.role", "first.h", F.lit(None).cast("string").alias("text"),
                          F.col("first.ord").alias("at"), "letters", "exits")
    lines = rows.select("conv_id", "turn", "role", "h", "text", F.lit(None).cast("long").alias("at"),
                        F.lit(None).cast("array<string>").alias("letters"), F.lit(None).cast("array<long>").alias("exits"))
    stream = (plans.unionByName(lines).repartition("conv_id")
              .sortWithinPartitions(*key, F.asc_nulls_last("at")).select("conv_id", "role", "text", "letters", "exits"))
    texts = written(stream.mapInArrow(_write, "conv_id long, audit string, repaired_sha256 string"), "repaired", 500)

    counts = sums.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.min("turn_a").alias("low"), F.max("turn_z").alias("high"))
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")) if ids is not None else _rows(conversations).select("conv_id")
    out = out.distinct()
    for n, side in enumerate((counts, solved.drop("behind"), texts)):
        side = side.withColumnRenamed("conv_id", f"k{n}")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col(f"k{n}")), "left").drop(f"k{n}")
    gaps = F.col("high") - F.col("low") + 1 - F.col("turns")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", F.coalesce(gaps, zero).alias("gaps"),
                      *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

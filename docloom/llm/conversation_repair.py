"""Conversation structure repair: the cheapest edits that give roles of the form (system? (user assistant)+)?.

A state says how far the roles have come: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant. Going backward over a conversation's rows, ``cost_to_go`` has the least cost from each state to the end; a forward walk then takes, among the edits on a cheapest way, the one with the least letter: Delete, Insert, Keep, Rerole. From a state a letter leads to one state only, so the walk gives the least audit.
The vectors of cost, less their minimum, are few, so each step is looked up once it has been made.

Rows are dealt by ranges of (conversation, turn), which cut a long conversation anywhere. A conversation that lies inside a range is repaired there and then. The first and the last one of each range may go on in the next one; for those, each piece gives its costs between states (a 4 by 4 matrix), the driver chains the two small rows a range, and every piece is walked from its entry state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import LARGE_ROWS, materialise, partitions

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of keeping or reroling a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = range(4)
FAR = 1 << 40
#: The state behind a role's initial, by state; a pair that is not here breaks the form.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one user or assistant role that fits behind a state, and the state behind it.
FITTING = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Cost from each state to the end once all rows are used, by inserts alone.
END = (0, 2 * INSERT, INSERT, 0)
#: Bytes of text in a range of rows.
RANGE_BYTES = 64 << 20

Kind = tuple[str, bool, bool]  # initial, deletion required, truncated
Vector = tuple[int, ...]


@lru_cache(maxsize=1 << 16)
def cost_to_go(kind: Kind, after: Vector) -> Vector:
    """Least cost from each state before a row, given that behind it."""
    initial, gone, cut = kind
    here = [DELETE + after[s] for s in STATES]
    if not gone:
        for s in STATES:
            here[s] = min(here[s], REROLE + cut * TRUNCATED + after[FITTING[s][1]])
            if (s, initial) in AFTER:
                here[s] = min(here[s], cut * TRUNCATED + after[AFTER[s, initial]])
    for _ in range(2):  # two inserts reach every state that inserts can reach
        here = [min(here[s], INSERT + here[FITTING[s][1]]) for s in STATES]
    return tuple(here)


@lru_cache(maxsize=1 << 16)
def walk(kind: Kind, after: Vector, state: int) -> tuple[str, int]:
    """The edits before and at a row from a state (inserts, then one for the row) and the state behind it."""
    initial, gone, cut = kind
    here, letters = cost_to_go(kind, after), ""
    while True:
        left, behind = here[state], FITTING[state][1]
        if left == DELETE + after[state]:
            return letters + "D", state
        if left == INSERT + here[behind]:
            letters, state = letters + "I", behind
        elif (state, initial) in AFTER and left == cut * TRUNCATED + after[AFTER[state, initial]]:
            return letters + "K", AFTER[state, initial]
        else:
            return letters + "R", behind


def shifted(vector: Vector) -> tuple[Vector, int]:
    low = min(vector)
    return tuple(x - low for x in vector), low


def backward(kinds: list[Kind], end: Vector) -> tuple[list[Vector], Vector]:
    """The cost vector behind each row, less its minimum, and the whole one before the first row."""
    vector, total = shifted(end)
    behind = [vector] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        behind[i] = vector
        vector, low = shifted(cost_to_go(kinds[i], vector))
        total += low
    return behind, tuple(x + total for x in vector)


def forward(kinds: list[Kind], behind: list[Vector], state: int) -> tuple[list[str], int]:
    """The edits at each row from an entry state, and the exit state."""
    edits = []
    for kind, after in zip(kinds, behind, strict=True):
        letters, state = walk(kind, after, state)
        edits.append(letters)
    return edits, state


def closing(state: int) -> str:
    """Inserts behind the last row."""
    return "I" * (END[state] // INSERT)


def rebuilt(roles: list[str], texts: list[str], edits: list[str], state: int, tail: str = "") -> list[str]:
    """The repaired turns as ``role:text``."""
    out = []
    for role, text, letters in zip([*roles, ""], [*texts, ""], [*edits, tail], strict=True):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                out.append(f"{role}:{text}")
                state = AFTER[state, role[:1]]
            else:
                name, state = FITTING[state]
                out.append(f"{name}:{text if letter == 'R' else ''}")
    return out


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def row_kinds(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[list[Kind], dict[str, int]]:
    """Each row's kind and the number of rows by first fault: blank, else role and text as earlier, else truncated. ``seen`` has the digests of rows before these, and is added to."""
    kinds, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in zip(roles, texts, strict=True):
        bare, own = text.rstrip(SPACE), digest(role, text)
        fault = "blank" if not bare else "duplicate" if own in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add(own)
        if fault:
            faults[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return kinds, faults


def illegal_steps(roles: list[str]) -> int:
    initials = [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def turn_facts(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """Least and greatest turn and the number of distinct ones, without nulls."""
    known = {t for t in turns if t is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return most - least + 1 - distinct if distinct else 0


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the contract damages them by the crc32 of ``conv_id:turn``; a null counts as one space there and as role or text."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("__z"))
    text = F.when(F.col("__z") == 1, "").when(F.col("__z") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__z") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__z") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.filter("__z <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("__copies").alias("__copy")).drop("__copy")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_ROW = "turns array<long>, roles array<string>, texts array<string>"


def repair(rows: DataFrame, range_bytes: int = RANGE_BYTES, least_ranges: int = 0) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of (conv_id, turn, role, text).

    Rows go by turn, nulls first, then by role and a hash of the text, so the order of ties does not hang on the input's. Null roles and texts count as one space; rows without a conv_id are one conversation, whose id is null. Repeated rows are duplicates of the first. Extra columns are not read; no row gives no conversation.
    A range of rows holds some ``range_bytes`` of text, and a conversation may have any number of ranges. Its digest is a chain over all its text, so the pieces of a cut conversation are read in order by one task, one at a time.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(partitions(rows.sparkSession), least_ranges, -(-size // range_bytes))
    order = ["conv_id", "turn", "role", "__h"]
    dealt = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    facts = f"conv_id {kind}, gaps long, {', '.join(f'{x} long' for x in _COUNTS)}, audit string, repaired_sha256 string"
    done = materialise(dealt.drop("__h").mapInArrow(_repair_range(to_arrow_type(rows.schema["conv_id"].dataType)), f"{facts}, part int, {_ROW}"))
    names = ["conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256"]
    inside = done.filter("part IS NULL").select(*names)
    return inside.unionByName(_repair_cut(done.filter("part IS NOT NULL").select("conv_id", "part", "turns", "roles", "texts"), facts))


def _repair_range(kind: pa.DataType):
    """Repairs the conversations inside a range; hands on the rows of the first and the last one."""
    longs = [(x, pa.int64()) for x in ("gaps", *_COUNTS)]
    rows = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    schema = pa.schema([("conv_id", kind), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), *rows])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, turns, roles, texts) in order; a conversation may span batches."""
        now: tuple | None = None
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("conv_id", "turn", "role", "text")]
            for conv, own in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
                _, *lists = map(list, zip(*own, strict=True))
                if now and now[0] == conv:
                    for known, more in zip(now[1:], lists, strict=True):
                        known.extend(more)
                else:
                    if now:
                        yield now
                    now = (conv, *lists)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, held, first = TaskContext.get().partitionId(), [], None, True
        for own in conversations(batches):
            if first:
                out, first = [_piece(part, *own)], False
                continue
            if held:
                out.append(_whole(*held))
            held = own
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held:
            out.append(_piece(part, *held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _piece(part: int, conv, turns: list, roles: list, texts: list) -> dict:
    return {"conv_id": conv, "part": part, "turns": turns, "roles": roles, "texts": texts}


def _whole(conv, turns: list, roles: list, texts: list) -> dict:
    kinds, faults = row_kinds(roles, texts, set())
    behind, costs = backward(kinds, END)
    edits, state = forward(kinds, behind, 0)
    tail = closing(state)
    text = "\n".join(rebuilt(roles, texts, edits, 0, tail))
    return {"conv_id": conv, "gaps": gaps(*turn_facts(turns)), **faults, "illegal": illegal_steps(roles), "cost": costs[0], "audit": "".join(edits) + tail, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _repair_cut(pieces: DataFrame, facts: str) -> DataFrame:
    """The conversations at the ends of ranges, of which each range has a piece or two. The driver gets a few dozen numbers a piece."""
    spark, kind = pieces.sparkSession, pieces.schema["conv_id"].dataType.simpleString()
    pieces = pieces.withColumn("seen", F.array().cast("array<binary>"))
    # Rows seen in an earlier piece of the conversation: only digests move, one a piece.
    marks = pieces.select("conv_id", "part", "roles", "texts").mapInArrow(_digests, f"conv_id {kind}, part int, mark binary")
    if pieces.groupBy("conv_id").count().filter("count > 1").isEmpty():
        seen = None
    else:
        firsts = marks.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("part").alias("least"))
        again = marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m"))).filter("part > least")
        seen = again.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.collect_set("mark").alias("found"))
    if seen is not None:
        pieces = pieces.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select("conv_id", "part", "turns", "roles", "texts", F.coalesce("found", "seen").alias("seen"))
        pieces = materialise(pieces, **LARGE_ROWS)
    stats = f"conv_id {kind}, part int, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    rows = sorted(pieces.mapInArrow(_measure, stats).collect(), key=lambda r: (r["conv_id"] is not None, 0 if r["conv_id"] is None else r["conv_id"], r["part"]))
    chains = [list(own) for _, own in groupby(rows, key=lambda r: r["conv_id"])]
    ahead, totals = {}, {}
    for chain in chains:
        vector = END
        for r in reversed(chain):
            ahead[r["conv_id"], r["part"]] = vector
            vector = tuple(min(r["costs"][4 * s + t] + vector[t] for t in STATES) for s in STATES)
        steps = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(chain, chain[1:], strict=False))
        totals[chain[0]["conv_id"]] = [sum(r[x] for r in chain) for x in ("blank", "duplicate", "truncated")] + [sum(r["illegal"] for r in chain) + steps, vector[0]]
    exits = {(r["conv_id"], r["part"]): r["exits"] for r in pieces.mapInArrow(_passing(ahead), f"conv_id {kind}, part int, exits array<int>").collect()}
    entry, final = {}, set()
    for chain in chains:
        state = 0
        for r in chain:
            entry[at := (r["conv_id"], r["part"])] = state
            state = exits[at][state]
        final.add(at)
    # Distinct turns: the ranges are ordered by turn, so only numbers move.
    turns = pieces.select("conv_id", F.explode("turns").alias("turn")).filter("turn IS NOT NULL").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count_distinct("turn").alias("n"))
    spans = turns.select(F.col("conv_id").alias("c"), (F.col("b") - F.col("a") + 1 - F.col("n")).alias("gaps"))
    counted = spark.createDataFrame([(c, *x) for c, x in totals.items()], f"c {kind}, {', '.join(f'{x} long' for x in _COUNTS)}")
    written = pieces.mapInArrow(_rewritten(ahead, entry, final), f"conv_id {kind}, part int, audit string, lines array<string>")
    chained = written.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    out = chained.join(counted, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(*[x.split()[0] for x in facts.split(", ")])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, dict]]:
    """Pieces one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.schema.field("conv_id").type, batch.slice(i, 1).to_pylist()[0]


def _table(kind: pa.DataType, rows: list[dict], **columns: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", kind), *columns.items()]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, piece in _each(batches):
        own = {digest(r, t) for r, t in zip(piece["roles"], piece["texts"], strict=True)}
        yield _table(kind, [{"conv_id": piece["conv_id"], "part": piece["part"], "mark": m} for m in own], part=pa.int32(), mark=pa.binary())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's least costs from each entry state to each exit state, its faults, and the initials at its ends."""
    for kind, piece in _each(batches):
        roles = piece["roles"]
        kinds, faults = row_kinds(roles, piece["texts"], {bytes(m) for m in piece["seen"]})
        to = [backward(kinds, tuple(0 if s == t else FAR for s in STATES))[1] for t in STATES]
        row = {"conv_id": piece["conv_id"], "part": piece["part"], "costs": [min(to[t][s], FAR) for s in STATES for t in STATES], **faults, "illegal": illegal_steps(roles), "first": roles[0][:1], "last": roles[-1][:1]}
        counts = {x: pa.int64() for x in ("blank", "duplicate", "truncated", "illegal")}
        yield _table(kind, [row], part=pa.int32(), costs=pa.list_(pa.int64()), **counts, first=pa.string(), last=pa.string())


def _passing(ahead: dict):
    """The exit state for each entry state, given the costs behind the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, piece in _each(batches):
            at = piece["conv_id"], piece["part"]
            kinds, _ = row_kinds(piece["roles"], piece["texts"], {bytes(m) for m in piece["seen"]})
            behind, _ = backward(kinds, ahead[at])
            yield _table(kind, [{"conv_id": at[0], "part": at[1], "exits": [forward(kinds, behind, s)[1] for s in STATES]}], part=pa.int32(), exits=pa.list_(pa.int32()))

    return run


def _rewritten(ahead: dict, entry: dict, final: set):
    """A piece's audit and repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, piece in _each(batches):
            at = piece["conv_id"], piece["part"]
            kinds, _ = row_kinds(piece["roles"], piece["texts"], {bytes(m) for m in piece["seen"]})
            behind, _ = backward(kinds, ahead[at])
            edits, state = forward(kinds, behind, entry[at])
            tail = closing(state) if at in final else ""
            row = {"conv_id": at[0], "part": at[1], "audit": "".join(edits) + tail, "lines": rebuilt(piece["roles"], piece["texts"], edits, entry[at], tail)}
            yield _table(kind, [row], part=pa.int32(), audit=pa.string(), lines=pa.list_(pa.string()))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation from its pieces in order, one piece in memory at a time."""
    for (conv, kind), own in groupby(_each(batches), key=lambda x: (x[1]["conv_id"], x[0])):
        audit, chain, begun = [], hashlib.sha256(), False
        for _, piece in own:
            audit.append(piece["audit"])
            for line in piece["lines"]:
                chain.update((("\n" if begun else "") + line).encode())
                begun = True
        yield _table(kind, [{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": chain.hexdigest()}], audit=pa.string(), repaired_sha256=pa.string())


def repair_all(original: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """:func:`repair` of ``rows``, with a row for every conv_id of ``original``: zeros, an empty audit and the empty text's digest where no row is left."""
    found = repair(rows, **options)
    ids = original.select(F.col("conv_id").alias("__id")).distinct()
    out = ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", *_COUNTS)]
    return out.select(F.col("__id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

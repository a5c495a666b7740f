"""Conversation structure repair with a suffix-shared automaton.

A row of a conversation is one symbol: its role (s, u, a, x for others; capital if its text is cut short) or D if it has to
go (blank, or its role and text came earlier). A conversation is the string of its symbols, its signature. The cheapest
edits of the rest of a conversation depend on the rest alone and on the state of the grammar ``(s?(ua)+)?``, so signatures
are minimised from the end: sorted by their reverse, those that end alike lie next to each other, and a walk over them
shares one automaton node for each common ending. Each node has, once for all conversations that pass it, the cost to go
and the first edit of the best audit from each of four grammar states; following these edits gives the audit.

Rows are put in order by range partitions over (conversation, turn, role, hash of the text), so a conversation of any
length is spread over tasks, in segments of bounded length. One that has several is solved from its last segment back: each
gives the least costs from every state to every state (four by four), these are joined to costs at the bounds, and the walk
starts from these costs instead of the grammar's end. Texts move once, for the repaired rows. A conversation's hash is one
sequential digest and its audit one value, so a single task streams its rows and holds its audit, a byte a row.

Defined results: null role or text is one space; a null conversation is one of its own; null turns come first; equal turns
go by role, then by the SHA-256 of role and text; equal rows are neighbours; an empty table gives an empty table; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, hot_join, parallelism, slices

SEGMENT = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
NO = 1 << 60  # a cost that nothing reaches
#: Grammar states: nothing yet, after system, after user, after assistant. The row that each asks for, and where that leads.
STATES, NEXT_ROLE, NEXT_STATE = range(4), ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Costs to go at the end of a conversation, and the inserts that they take.
END = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))
FINAL = "end"
LEGAL = {"su", "ua", "au"}

Node = tuple[tuple[int, str], ...]  # for each state: cost to go, first edit


def node(symbol: str, rest: Node) -> Node:
    """The node of ``symbol`` in front of the node ``rest``. Of equally cheap edits the first in ASCII order."""
    role, cut_short = symbol.lower(), TRUNCATED * symbol.isupper()
    own = []
    for state in STATES:
        ways = [(DELETE + rest[state][0], "D")]
        if symbol != "D":
            if role in KEEP[state]:
                ways.append((cut_short + rest[KEEP[state][role]][0], "K"))
            ways.append((REROLE + cut_short + rest[NEXT_STATE[state]][0], "R"))
        own.append(min(ways))
    for _ in range(2):  # two inserts lead from any state to any that follows
        own = [min(own[state], (INSERT + own[NEXT_STATE[state]][0], "I")) for state in STATES]
    return tuple((min(cost, NO), edit) for cost, edit in own)


def end_node(costs: str) -> Node:
    """The node behind a segment: the end of the conversation, or the costs to go from the next segment on."""
    return END if costs == FINAL else tuple((int(c), "") for c in costs.split(","))


class Walk:
    """The automaton along one signature at a time; what it shares with the one before, from the end, is not made again."""

    def __init__(self) -> None:
        self.end, self.reverse, self.nodes, self.made = None, "", [], 0

    def to(self, end: str, reverse: str) -> None:
        if end != self.end:
            self.end, self.reverse, self.nodes = end, "", [end_node(end)]
        same, most = 0, min(len(reverse), len(self.reverse))
        while same < most and reverse[same] == self.reverse[same]:
            same += 1
        del self.nodes[same + 1 :]
        for symbol in reverse[same:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
        self.made += len(reverse) - same
        self.reverse = reverse

    def audit(self, state: int) -> tuple[int, str, int]:
        """Cost to go, the edits of the best audit through this segment, and the state behind it."""
        cost, edits, k = self.nodes[-1][state][0], [], len(self.nodes) - 1
        while edit := self.nodes[k][state][1]:
            edits.append(edit)
            if edit in "IR":
                state = NEXT_STATE[state]
            elif edit == "K":
                state = KEEP[state][self.reverse[k - 1].lower()]
            k -= edit != "I"
        return cost, "".join(edits), state


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with one fault in every fourth or so, by the CRC of ``conv_id:turn``; ``copies`` says how often each stands."""
    act = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.withColumn("_act", act).where("_act <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_act") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_act") == 1, "").when(F.col("_act") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("_act") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, k``: ``k`` names conversation, role and text."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    of = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    return plain.withColumn("k", F.unhex(F.sha2(F.concat(F.unhex(F.sha2(whole.cast("binary"), 256)), of.cast("binary")), 256))).withColumn("w", F.unhex(F.sha2(whole.cast("binary"), 256)))


def order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("w").asc()]


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, w, n, blank, truncated, early``: equal rows together; ``early`` if none like them came before."""
    left = F.rtrim("text", F.lit(BLANKS))
    seen = rows.withColumn("blank", left == "").withColumn("truncated", ~F.right(left, F.lit(1)).isin(".", "!", "?"))
    seen = seen.groupBy("conv_id", "turn", "role", "w", "k", "blank", "truncated").agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    seen = cut(seen)
    firsts = seen.groupBy("k").agg(F.min(place).alias("first"), F.count("*").alias("_n"))
    out = hot_join(seen, firsts, "k", "_n", "turn", limit=1_000_000).withColumn("early", F.col("first") == place).drop("k", "first")
    out._steps = seen._steps
    return out


SEGMENTS = "part int, seq long, signature string, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, least long, most long, first_role string, last_role string"


def segments(flagged: DataFrame, length: int = SEGMENT) -> DataFrame:
    """Rows in order, as signatures of at most ``length`` symbols with the counts that a digest needs."""
    names = ["conv_id", *[c.split()[0] for c in SEGMENTS.split(", ")]]
    kind = flagged.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, own = TaskContext.get().partitionId(), 0, [], None
        schema = None

        def closed() -> None:
            nonlocal own, seq
            if own is not None:
                own["signature"] = "".join(own["signature"])
                out.append(own | {"part": part, "seq": seq})
                own, seq = None, seq + 1

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int64()), ("signature", pa.string()), *[(c, pa.int64()) for c in names[4:13]], ("first_role", pa.string()), ("last_role", pa.string())])
            for piece in slices(batch):
                for r in piece.to_pylist():
                    left, initial = r["n"], r["role"][:1]
                    if own is not None and own["conv_id"] != r["conv_id"]:
                        closed()
                    early = r["early"]
                    while left:
                        if own is not None and own["size"] >= length:
                            closed()
                        if own is None:
                            own = {"conv_id": r["conv_id"], "signature": [], "size": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first_turn": r["turn"], "last_turn": None, "least": r["turn"], "most": r["turn"], "first_role": initial, "last_role": None}
                        if r["turn"] is not None and own["last_turn"] != r["turn"]:
                            own["turns"] += 1
                            own["least"], own["most"] = r["turn"] if own["least"] is None else own["least"], r["turn"]
                        own["last_turn"] = r["turn"]
                        n = min(left, length - own["size"])
                        own["illegal"] += n - 1 + (own["last_role"] is not None and own["last_role"] + initial not in LEGAL)
                        own["last_role"] = initial
                        if r["blank"]:
                            own["blank"] += n
                            own["signature"].append("D" * n)
                        else:
                            own["duplicate"] += n - early
                            own["truncated"] += early and r["truncated"]
                            role = initial if initial and initial in "sua" else "x"
                            own["signature"].append((role.upper() if r["truncated"] else role) * early + "D" * (n - early))
                        early, left, own["size"] = False, left - n, own["size"] + n
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in out], schema=schema)
                    out.clear()
        closed()
        if out:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in out], schema=schema)

    ranges = flagged.select("conv_id", "turn", "role", "w", "n", "blank", "truncated", "early").repartitionByRange(parallelism(flagged.sparkSession), *order())
    return ranges.sortWithinPartitions(*order()).mapInArrow(run, f"conv_id {kind}, {SEGMENTS}")


def with_ends(segs: DataFrame) -> DataFrame:
    """Adds ``end``, the costs to go behind each segment, and ``first``, whether it begins its conversation."""
    kind = segs.schema["conv_id"].dataType.simpleString()
    many = segs.groupBy("conv_id").agg(F.count("*").alias("_parts"))
    split = cut(segs.alias("s").join(many.where("_parts > 1").alias("m"), F.col("s.conv_id").eqNullSafe(F.col("m.conv_id"))).select("s.conv_id", "part", "seq", "signature"))
    single = [F.col("s.conv_id").eqNullSafe(F.col("m.conv_id")), F.col("s.part") == F.col("m.part"), F.col("s.seq") == F.col("m.seq")]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for signature in batch.column(3).to_pylist():
                ways = [tuple((NO * (state != out), "") for state in STATES) for out in STATES]  # one walk for each state behind
                for symbol in reversed(signature):
                    ways = [node(symbol, way) for way in ways]
                costs.append([cost for way in ways for cost, _ in way])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "costs"])

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("part", "ascending"), ("seq", "ascending")])
        to_go, ends = [cost for cost, _ in END], [FINAL]
        for costs in reversed(rows["costs"].to_pylist()[1:]):
            to_go = [min(min(costs[4 * out + state] + to_go[out] for out in STATES), NO) for state in STATES]
            low = min(to_go)
            to_go = [cost - low if cost < NO else NO for cost in to_go]
            ends.append(",".join(map(str, to_go)))
        return rows.select(["conv_id", "part", "seq"]).append_column("end", pa.array(ends[::-1])).append_column("first", pa.array([k == 0 for k in range(len(ends))]))

    # a row for each segment of a conversation: its length divided by that of a segment
    ends = split.mapInArrow(tables, f"conv_id {kind}, part int, seq long, costs array<long>").groupBy("conv_id").applyInArrow(joined, f"conv_id {kind}, part int, seq long, end string, first boolean")
    return segs.alias("s").join(ends.alias("m"), single, "left").select("s.*", F.coalesce("m.end", F.lit(FINAL)).alias("end"), F.coalesce("m.first", F.lit(True)).alias("first"))


def audited(segs: DataFrame) -> DataFrame:
    """Adds ``costs, audits, states`` for each state a segment may be entered in; first ones only have the first state."""
    names = [c for c in segs.columns if c not in ("signature", "end")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segs.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, memo = Walk(), {}
        for batch in batches:
            for part in slices(batch, 256):
                found = []
                for reverse, end, first in zip(*(part.column(c).to_pylist() for c in ("reverse", "end", "first")), strict=True):
                    if end != walk.end or reverse != walk.reverse:
                        walk.to(end, reverse)
                        memo = {}
                    if first not in memo:
                        memo[first] = [walk.audit(state) for state in (STATES[:1] if first else STATES)]
                    found.append(memo[first])
                own = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *own], names=[*names, "costs", "audits", "states"])

    by = [F.col("end"), F.col("reverse"), F.col("conv_id"), F.col("part"), F.col("seq")]  # equal signatures may be dealt over tasks
    ranges = segs.withColumn("reverse", F.reverse("signature")).drop("signature").repartitionByRange(parallelism(segs.sparkSession), *by)
    return ranges.sortWithinPartitions(*by).mapInArrow(run, f"{fields}, costs array<long>, audits array<string>, states array<int>")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) for each edit; deleted rows keep their own role and text."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K":
            state = KEEP[state][role[:1]]
        elif edit != "D":
            role, state = NEXT_ROLE[state], NEXT_STATE[state]
        yield edit, role, text


DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def solved(segs: list[dict]) -> dict:
    """Counts, cost and audit of a conversation from its segments in order."""
    out, state, audits, before = dict.fromkeys(DIGEST, 0), 0, [], None
    turns = 0
    for s in segs:
        state_in = 0 if s["first"] else state
        audits.append(s["audits"][state_in])
        edits, state = s["audits"][state_in], s["states"][state_in]
        out["cost"] += REROLE * edits.count("R") + DELETE * edits.count("D") + INSERT * edits.count("I")
        for c in ("blank", "duplicate", "truncated", "illegal"):
            out[c] += s[c]
        turns += s["turns"]
        if before is not None:
            turns -= s["first_turn"] is not None and s["first_turn"] == before["last_turn"]
            out["illegal"] += before["last_role"] + s["first_role"] not in LEGAL
        before = s
    least, most = [s["least"] for s in segs if s["least"] is not None], [s["most"] for s in segs if s["most"] is not None]
    out["gaps"] = most[-1] - least[0] + 1 - turns if least else 0
    return out | {"audit": "".join(audits)}


def streamed(rows: DataFrame, ids: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """Each conversation's segments, then its rows, in order in one task, which keeps none of the rows."""
    rows = keyed(rows)
    flagged = faults(rows)
    solved_segs = audited(with_ends(cut(segments(flagged, length))))
    dropped(flagged)
    own = ["first", "audits", "states", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "least", "most", "first_role", "last_role"]
    tags = [
        ids.select("conv_id").distinct().withColumn("tag", F.lit(0)),
        solved_segs.select("conv_id", F.lit(1).alias("tag"), "part", "seq", F.struct(*own).alias("seg")),
        rows.select("conv_id", F.lit(2).alias("tag"), "turn", "role", "w", "text", "copies"),
    ]
    every = tags[0].unionByName(tags[1], allowMissingColumns=True).unionByName(tags[2], allowMissingColumns=True)
    by = [F.col("conv_id").asc_nulls_first(), F.col("tag"), F.col("part"), F.col("seq"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("w")]
    every = every.repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions(*by)
    return every.select("conv_id", "tag", "seg", "role", "text", "copies"), own


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict], Iterator[tuple[str, str]]]]:
    """(id, segments, rows) of each conversation; rows are read as they are asked for."""
    from itertools import chain, groupby, repeat

    def plain() -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    for conv_id, group in groupby(plain(), key=lambda r: (r[0],)):
        segs, rows = [], iter(())
        for r in group:
            if r[1] == 1:
                segs.append(r[2])
            elif r[1] == 2:
                rows = chain.from_iterable(repeat((x[3], x[4]), x[5]) for x in chain([r], group))
                break
        yield conv_id[0], segs, rows


def repair(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """``conv_id, at, edit, role, text``: every conversation's edits in order; those with edit D are out, the others make it up.

    ``rows`` has ``conv_id, turn, role, text`` and, if rows stand several times, ``copies``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    every, _ = streamed(rows, rows, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = [pa.int64(), pa.string(), pa.string(), pa.string()]

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), id_type), *(pa.array(list(c), t) for c, t in zip(cols[1:], types, strict=True))], names=["conv_id", "at", "edit", "role", "text"])

        first = next(batches, None)
        if first is not None:
            from itertools import chain

            id_type = first.schema.field("conv_id").type
            for conv_id, segs, own in conversations_of(chain([first], batches)):
                for at, (edit, role, text) in enumerate(edited(solved(segs)["audit"], own)):
                    out.append((conv_id, at, edit, role, text))
                    if len(out) >= 512:
                        yield batch()
            if out:
                yield batch()

    return every.mapInArrow(run, f"conv_id {kind}, at long, edit string, role string, text string")


def digest(rows: DataFrame, ids: DataFrame, length: int = SEGMENT) -> DataFrame:
    """One row for each conversation of ``ids``: its faults, the cost, the audit and the SHA-256 of the repaired rows."""
    kind = ids.schema["conv_id"].dataType.simpleString()
    every, _ = streamed(rows, ids, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *DIGEST, "audit", "repaired_sha256"]
        first = next(batches, None)
        if first is None:
            return
        from itertools import chain

        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *[(c, pa.int64()) for c in DIGEST], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = []
        for conv_id, segs, own in conversations_of(chain([first], batches)):
            found, sha, comma = solved(segs), hashlib.sha256(), ""
            cut_short = 0
            for edit, role, text in edited(found["audit"], own):
                if edit != "D":
                    sha.update(f"{comma}{role}:{text}".encode())
                    comma = "\n"
                    cut_short += edit != "I" and text.rstrip(BLANKS)[-1:] not in (".", "!", "?")
            out.append({"conv_id": conv_id, **found, "cost": found["cost"] + TRUNCATED * cut_short, "repaired_sha256": sha.hexdigest()})
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in out], schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in out], schema=schema)

    return every.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in DIGEST) + ", audit string, repaired_sha256 string")

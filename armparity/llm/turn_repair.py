"""Conversation structure repair over a suffix-shared automaton.

A conversation is a string of letters, one per row: the role and the fault of the row.
What the rest of a conversation costs depends only on what is left of that string and on
the state of the role grammar ``(s?(ua)+)?``. So the distinct strings of all conversations
are put in the order of their reversals: strings that share an end then stand together,
and each end, a node of the automaton, is made once, from the last letter back, with its
cost-to-go and first edit by grammar state. A string's cheapest edits are read along its
nodes. The strings are dealt by ranges, so only the nodes on the border of two ranges are
made twice, and a task holds the nodes of one string at a time.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant row 3; a truncated row that stays costs 3 more; blank and duplicate rows have
to go. From a grammar state a letter of the audit leads to one other state, so the
ASCII-least of the cheapest audits takes the least of the cheapest edits at each step.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import BLANKS, checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar: at the start, after the system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State that a row written in a state leads to, and its role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_FAR = 1 << 60

#: Letters of a row: its role's initial, in capitals if truncated, ``d`` if it has to go; any other initial is ``x`` or ``X``.
_MUST_GO = "d"


def _kept(state: int, letter: str) -> int | None:
    """State after keeping a row, if the grammar allows it."""
    low = letter.lower()
    if low == "s" and state == _START:
        return _SYSTEM
    if low == "u" and state != _USER or low == "a" and state == _USER:
        return _NEXT[state]
    return None


def _ended() -> tuple[tuple[int, str], ...]:
    """Node of the empty end: the grammar is fulfilled at the start and after an assistant row; else rows are inserted."""
    return _with_inserts([(0, ""), (_FAR, ""), (_FAR, ""), (0, "")])


def _with_inserts(best: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    """Costs and first edits by state, where any number of rows may be inserted first."""
    cost = [c for c, _ in best]
    for _ in range(3):
        cost = [min(c, INSERT + cost[_NEXT[q]]) for q, c in enumerate(cost)]
    out = []
    for q, (c, edit) in enumerate(best):
        options = [edit] if c == cost[q] else []
        if INSERT + cost[_NEXT[q]] == cost[q]:
            options.append("I")
        out.append((cost[q], min(options)))
    return tuple(out)


def _node(letter: str, rest: tuple[tuple[int, str], ...]) -> tuple[tuple[int, str], ...]:
    """The node of ``letter`` before the end whose node is ``rest``."""
    best = []
    for q in range(4):
        options = [(DELETE + rest[q][0], "D")]
        if letter != _MUST_GO:
            more = TRUNCATED if letter.isupper() else 0
            options.append((REROLE + more + rest[_NEXT[q]][0], "R"))
            if (to := _kept(q, letter)) is not None:
                options.append((KEEP + more + rest[to][0], "K"))
        best.append(min(options))
    return _with_inserts(best)


class _Ends:
    """Nodes of the ends of one string, the empty end first. A next string keeps the nodes of the end that both share."""

    def __init__(self) -> None:
        self.reversed, self.nodes = "", [_ended()]

    def move(self, back: str) -> None:
        """On to the string whose reversal is ``back``."""
        shared = len(os.path.commonprefix((self.reversed, back)))
        del self.nodes[shared + 1 :]
        for letter in back[shared:]:
            self.nodes.append(_node(letter, self.nodes[-1]))
        self.reversed = back


def _audit(signature: str, nodes: list[tuple[tuple[int, str], ...]]) -> str:
    """First edits along the nodes; ``nodes[k]`` is that of the last ``k`` letters."""
    state, left, out = _START, len(signature), []
    while True:
        edit = nodes[left][state][1]
        if not edit:
            return "".join(out)
        out.append(edit)
        if edit == "I":
            state = _NEXT[state]
            continue
        letter = signature[len(signature) - left]
        left -= 1
        if edit != "D":
            state = _NEXT[state] if edit == "R" else _kept(state, letter)


def audits(signatures: DataFrame) -> DataFrame:
    """``signatures`` (``signature``, ``salt``; distinct) with the ``cost`` and ``audit`` of each."""
    ordered = signatures.withColumn("reversed", F.reverse("signature")).repartitionByRange("reversed", "salt").sortWithinPartitions("reversed", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, audit = _Ends(), ""
        for batch in batches:
            costs, found = [], []
            for signature, back in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if back != ends.reversed:
                    ends.move(back)
                    audit = _audit(signature, ends.nodes)
                costs.append(ends.nodes[-1][_START][0]), found.append(audit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(found, pa.string())], names=["signature", "salt", "cost", "audit"])

    return ordered.select("signature", "salt", "reversed").mapInArrow(run, "signature string, salt int, cost bigint, audit string")


def _letter(role: Column, text: Column) -> Column:
    """Letter of a row that is no duplicate."""
    initial = F.when(role.startswith("s"), "s").when(role.startswith("u"), "u").when(role.startswith("a"), "a").otherwise("x")
    solid = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(solid == "", _MUST_GO).when(solid.isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def _rows(conversations: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``copies``, and ``digest``, which says which rows are equal."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("bigint").alias("copies"))
    return rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``signature``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``.

    Equal rows of a turn are counted before any shuffle, and the first place of a text is
    a grouped minimum, so no conversation is gathered but as a letter per row.
    """
    present = rows.filter("copies > 0").withColumn("letter", _letter(F.col("role"), F.col("text"))).withColumn("initial", F.substring("role", 1, 1))
    keys = ["conv", "turn", "role", "digest"]
    runs = checkpointed(present.groupBy(*keys, "initial", "letter").agg(F.sum("copies").alias("copies")))
    # turns rise from null on, so (has one, turn) orders them
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = runs.filter(F.col("letter") != _MUST_GO).groupBy("conv", "digest").agg(F.min(place).alias("p")).select(
        F.col("conv").alias("f_conv"), F.col("digest").alias("f_digest"), F.col("p.turn").alias("f_turn"), F.lit(True).alias("f"))
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")) & F.col("turn").eqNullSafe(F.col("f_turn"))
    marked = runs.join(first, same, "left").select(*keys, "initial", "letter", "copies", F.coalesce("f", F.lit(False)).alias("first"))
    # a conversation that has lost all rows is there without one
    alone = rows.select("conv").distinct().select("conv", *(F.lit(None).cast(t).alias(c) for c, t in marked.drop("conv").dtypes))
    kind = dict(rows.dtypes)["conv"]
    ordered = marked.unionByName(alone).repartition("conv").sortWithinPartitions(
        "conv", F.col("letter").isNotNull(), F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "turn", "initial", "letter", "copies", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def done() -> list:
            low, high, turns = state["turns"]
            return [state["conv"], "".join(state["letters"]), high - low + 1 - turns if turns else 0, *state["counts"]]

        out, names = [], ["conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
        for batch in batches:
            convs = batch.column(0)
            for conv, turn, initial, letter, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
                if letter is None:
                    if state:
                        out.append(done())
                    state = {"conv": conv, "letters": [], "turns": (0, 0, 0), "counts": [0, 0, 0, 0], "was": None}
                    continue
                if turn is not None:
                    low, high, turns = state["turns"]
                    state["turns"] = (low, turn, turns + (turn != high)) if turns else (turn, turn, 1)
                counts, legal = state["counts"], ("su", "ua", "au")
                if state["was"] is not None and state["was"] + initial not in legal:
                    counts[3] += 1
                counts[3] += copies - 1  # a row before its copy
                state["was"] = initial
                if letter == _MUST_GO:
                    counts[0] += copies
                    state["letters"].append(_MUST_GO * copies)
                else:
                    counts[1] += copies - first
                    counts[2] += first and letter.isupper()
                    state["letters"].append(letter * first + _MUST_GO * (copies - first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], convs.type), pa.array([r[1] for r in out], pa.string()),
                                                  *(pa.array([int(r[k]) for r in out], pa.int64()) for k in range(2, 7))], names=names)
                out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state["conv"]], convs.type), pa.array([done()[1]], pa.string()),
                                              *(pa.array([int(v)], pa.int64()) for v in done()[2:])], names=names)

    return ordered.mapInArrow(run, f"conv {kind}, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def audit(conversations: DataFrame, ways: int = 64) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``conversations`` has ``conv_id``, ``turn`` (a whole number), ``role``, ``text``, and
    may have ``copies``, how often the row stands there; a conversation of which all rows
    have 0 copies gets zeros and an empty audit. Null roles and texts count as one space.
    Rows come by turn, those without one first; rows of one turn by role and then by the
    digest of role and text. Only the first fault of a row counts: blank, duplicate (an
    earlier row has its role and text), truncated. A null ``conv_id`` is a conversation
    like any other. An empty table gives no rows; other columns play no part.

    ``gaps`` are turns missing between the first and the last. ``illegal`` counts
    neighbours whose initials are not su, ua or au. ``ways`` spreads a signature that
    many conversations have.
    """
    told = checkpointed(signatures(_rows(conversations)).withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(ways)).cast("int")))
    cheapest = audits(told.select("signature", "salt").distinct())
    return told.join(cheapest, ["signature", "salt"]).select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(conversations: DataFrame, audited: DataFrame) -> DataFrame:
    """The edits of each conversation in order: ``conv_id``, ``edit_no`` (from 0), ``edit``, ``role``, ``text``; a deleted row keeps what it was.

    ``audited`` is what :func:`audit` says of the same rows. Partitions hold whole
    conversations, their edits in order. A conversation without edits has no rows. The
    rows of one are read as they come, so that only its audit is held.
    """
    kind = dict(_rows(conversations).dtypes)
    rows = _rows(conversations).filter("copies > 0").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text", "copies")
    plans = audited.select(F.col("conv_id").alias("conv"), "audit", *(F.lit(None).cast(kind[c]).alias(c) for c in ("turn", "role", "digest", "text", "copies")))
    ordered = plans.unionByName(rows).repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "audit", "role", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at, state, conv, arrow = "", 0, _START, None, None
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state
            while at < len(plan) and plan[at] == "I":
                out.append((conv, at, "I", _ROLE[state], ""))
                at, state = at + 1, _NEXT[state]

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "edit_no", "edit", "role", "text"])

        for batch in batches:
            arrow = batch.column(0).type
            for c, new, role, text, copies in zip(*(x.to_pylist() for x in batch.columns)):
                if new is not None:
                    inserts()
                    plan, at, state, conv = new, 0, _START, c
                    continue
                for _ in range(copies):
                    inserts()
                    edit = plan[at]
                    out.append((conv, at, edit, _ROLE[state] if edit == "R" else role, text))
                    if edit != "D":
                        state = _NEXT[state] if edit == "R" else _kept(state, role[:1])
                    at += 1
                if len(out) >= 4096:
                    yield packed()
        inserts()
        if out:
            yield packed()

    return ordered.mapInArrow(run, f"conv_id {kind['conv']}, edit_no bigint, edit string, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256`` of the rows that :func:`repaired` leaves, as ``role:text`` joined by newlines; reads its partitions as they are."""
    kind = dict(edits.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some, arrow = None, None, False, None
        out: list[tuple] = []
        for batch in batches:
            arrow = batch.column(0).type
            for c, no, edit, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if no == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, some = c, hashlib.sha256(), False
                if edit != "D":
                    digest.update(f"{chr(10) * some}{role}:{text}".encode())
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], arrow), pa.array([x for _, x in out], pa.string())], names=["conv_id", "repaired_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return edits.select("conv_id", "edit_no", "edit", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` as the contract of the query damages them, by the checksum of ``conv_id:turn`` modulo 20: ``conv_id``, ``turn``, ``role``, ``text``, ``copies``."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair_report(conversations: DataFrame) -> DataFrame:
    """What :func:`audit` says of each conversation, and ``repaired_sha256`` of what its edits leave (of the empty string, if nothing)."""
    audited = checkpointed(audit(conversations))
    found = digests(repaired(conversations, audited)).withColumnRenamed("conv_id", "of")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return audited.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*audited.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))

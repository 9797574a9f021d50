"""Repair of conversation structure at the least cost, with an audit of every edit.

A repaired conversation has roles ``(system? (user assistant)+)?``. Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (the only
one for blank and repeated rows), Insert an empty user or assistant row 5; a truncated row that stays adds 5. Of the cheapest edit
lists the one whose initials (K, R, D, I) come first in ASCII order is taken.

Method: persistent audit DP. A row of a conversation moves four states (nothing yet, system, user, assistant); each state keeps its least
cost and a node of a tree of audits (:class:`Audits`). A node is one edit and a link to the edits before, so all states share their prefixes. Nodes carry
ancestors at distances 1, 2, 4, ... and a rolling hash of their audit. Equal costs are decided at the first difference, found by lifting both
nodes while hashes differ; what the hashes call equal is verified on the edits once and remembered.

Scale: rows are put in order by one range partitioning over conversation and turn, so a conversation with a third of all rows lies in many
partitions. It is cut into pieces of at most ``PIECE_ROWS`` rows. A piece gives the best audit for every state before and after it, pieces
of a conversation are joined in order by the same rule (audits only, no texts), and the chosen edits return to the rows by their
numbers. Memory is bounded by a piece and by one conversation's audits.

Defined results: a null role or text counts as one space; a null id is a conversation of its own; null turns come first; rows of one turn are
ordered by role, the first 64 characters of the text and a hash of it; repeated rows are duplicates but for one;
a role's initial is its first character, an empty role has none and may stay anywhere; an empty table gives empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import written

PIECE_ROWS = 4096
#: Space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant. Where a kept initial leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {q: q for q in range(4)}}
FINAL = (START, ASSISTANT)
#: Labels tell which role an edit gives: U and A rerole, u and a insert.
TO_AUDIT = str.maketrans("UAua", "RRII")


class Audits:
    """Edit lists as a tree of nodes; node 0 is the empty list."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 1_000_003):
        self.modulus, self.base = modulus, base
        self.letter, self.label, self.depth, self.hash = [""], [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self.like = [0]

    def add(self, node: int, letter: str, label: str) -> int:
        new = len(self.letter)
        self.letter.append(letter)
        self.label.append(label)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        self.like.append(new)
        above, step = [node], 0
        while step < len(self.up[above[-1]]):
            above.append(self.up[above[-1]][step])
            step += 1
        self.up.append(above)
        return new

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` that is ``depth`` edits long."""
        while (extra := self.depth[node] - depth) > 0:
            node = self.up[node][extra.bit_length() - 1]
        return node

    def _representative(self, node: int) -> int:
        while self.like[node] != node:
            self.like[node] = self.like[self.like[node]]
            node = self.like[node]
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two lists of one length are equal; hashes that agree are verified on the edits down to a known common prefix."""
        if self.hash[x] != self.hash[y]:
            return False
        pairs = []
        while self._representative(x) != self._representative(y):
            if self.letter[x] != self.letter[y]:
                return False
            pairs.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        for a, b in pairs:
            self.like[self._representative(a)] = self._representative(b)
        return True

    def _walk(self, x: int, y: int) -> int:
        """Order of two lists of one length that differ, edit by edit: for hash collisions."""
        order = 0
        while x != y:
            if self.letter[x] != self.letter[y]:
                order = -1 if self.letter[x] < self.letter[y] else 1
            x, y = self.up[x][0], self.up[y][0]
        return order

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the list ``a`` comes before, is or comes after ``b``."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, short), self.lift(b, short)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return (self.depth[a] > self.depth[b]) - (self.depth[a] < self.depth[b])
            return self._walk(x, y)
        for step in range(len(self.up[x]) - 1, -1, -1):
            # Jumps keep both nodes past the longest common prefix.
            if step < len(self.up[x]) and self.hash[self.up[x][step]] != self.hash[self.up[y][step]]:
                x, y = self.up[x][step], self.up[y][step]
        if not self.same(self.up[x][0], self.up[y][0]):
            return self._walk(x, y)
        return -1 if self.letter[x] < self.letter[y] else 1

    def labels(self, node: int) -> str:
        out = []
        while node:
            out.append(self.label[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def best_edits(rows: list[tuple[str, str]], before: int, modulus: int = (1 << 61) - 1) -> list[tuple[int, int, str]]:
    """(state after, cost, labels) of the best edits of (initial, fault) rows from the state ``before``."""
    audits = Audits(modulus)

    def offer(states: dict, state: int, cost: int, node: int, letter: str, label: str) -> None:
        old = states.get(state)
        if old is not None and cost > old[0]:
            return
        new = audits.add(node, letter, label)
        if old is None or cost < old[0] or audits.compare(new, old[1]) < 0:
            states[state] = (cost, new)

    def inserted(states: dict) -> dict:
        for state in (START, SYSTEM, ASSISTANT):
            if state in states:
                offer(states, USER, states[state][0] + INSERT, states[state][1], "I", "u")
        if USER in states:
            offer(states, ASSISTANT, states[USER][0] + INSERT, states[USER][1], "I", "a")
        return states

    states = inserted({before: (0, 0)})
    for initial, fault in rows:
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in states.items():
            offer(after, state, cost + DELETE, node, "D", "D")
            if fault in ("blank", "duplicate"):
                continue
            stays = cost + (TRUNCATED if fault == "truncated" else 0)
            if (kept := KEPT.get(initial, {}).get(state)) is not None:
                offer(after, kept, stays, node, "K", "K")
            if state == USER:
                offer(after, ASSISTANT, stays + REROLE, node, "R", "A")
            else:
                offer(after, USER, stays + REROLE, node, "R", "U")
        states = inserted(after)
    return [(state, cost, audits.labels(node)) for state, (cost, node) in states.items()]


# --- pieces --------------------------------------------------------------------------
PIECE = (
    "conv bigint, first_at bigint, n_rows int, min_turn bigint, max_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_initial string, last_initial string, edits array<struct<before: int, after: int, cost: bigint, labels: string>>"
)


def _piece(conv, rows: list[tuple], opens: bool, modulus: int) -> dict:
    """One piece from rows (at, turn, initial, fault); ``opens`` where the conversation surely begins here."""
    faults = [fault for _, _, _, fault in rows]
    turns = [turn for _, turn, _, _ in rows if turn is not None]
    initials = [initial for _, _, initial, _ in rows]
    own = [(initial, fault) for _, _, initial, fault in rows]
    return {
        "conv": conv,
        "first_at": rows[0][0],
        "n_rows": len(rows),
        "min_turn": turns[0] if turns else None,
        "max_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        **{fault: faults.count(fault) for fault in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "edits": [{"before": before, "after": after, "cost": cost, "labels": labels} for before in ((START,) if opens else range(4)) for after, cost, labels in best_edits(own, before, modulus)],
    }


def _batches(records, schema: pa.Schema, rows: int = 256):
    held = []
    for record in records:
        held.append(record)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(spark, faulty: DataFrame, piece_rows: int, modulus: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PIECE))

    def cut(batches):
        rows, conv, opens, seen = [], None, False, False
        for batch in batches:
            for at, own, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("at", "conv", "turn", "initial", "fault"))):
                # Rows of a piece have consecutive numbers.
                if rows and (own != conv or len(rows) == piece_rows or at != rows[-1][0] + 1):
                    yield _piece(conv, rows, opens, modulus)
                    rows = []
                if not rows:
                    opens, seen, conv = seen and own != conv, True, own
                rows.append((at, turn, initial, fault))
        if rows:
            yield _piece(conv, rows, opens, modulus)

    return faulty.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(lambda batches: _batches(cut(batches), schema), PIECE)


# --- whole conversations -------------------------------------------------------------
AUDIT = (
    "conv bigint, first_at bigint, labels string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)


class _Chain:
    """Labels of consecutive pieces, linked to what comes before."""

    __slots__ = ("before", "labels")

    def __init__(self, before, labels: str):
        self.before, self.labels = before, labels


def _earlier(a: _Chain, b: _Chain) -> bool:
    """Whether the audit of ``a`` comes before that of ``b``; both end at the same piece and share what lies before they part."""
    left, right = [], []
    while a is not b:
        left.append(a.labels)
        right.append(b.labels)
        a, b = a.before, b.before
    left, right = ("".join(reversed(parts)).translate(TO_AUDIT) for parts in (left, right))
    return left < right


def _joined(conv, pieces: list[dict]) -> list[dict]:
    """One record per piece with its chosen labels; the last one also has what holds for the conversation."""
    states: dict[int, tuple[int, _Chain | None]] = {START: (0, None)}
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    least = most = initial = None
    turns = 0
    for piece in pieces:
        after: dict[int, tuple[int, _Chain]] = {}
        for edit in piece["edits"]:
            if edit["before"] not in states:
                continue
            cost, chain = states[edit["before"]]
            cost, chain, old = cost + edit["cost"], _Chain(chain, edit["labels"]), after.get(edit["after"])
            if old is None or cost < old[0] or (cost == old[0] and _earlier(chain, old[1])):
                after[edit["after"]] = (cost, chain)
        states = after
        for name in total:
            total[name] += piece[name]
        if initial is not None:
            total["illegal"] += initial + piece["first_initial"] not in ("su", "ua", "au")
        initial = piece["last_initial"]
        turns += piece["turns"] - (most is not None and piece["min_turn"] == most)
        least = piece["min_turn"] if least is None else least
        most = piece["max_turn"] if piece["max_turn"] is not None else most
    final = [states[q] for q in FINAL if q in states]
    cost, chain = final[0]
    for other, link in final[1:]:
        if other < cost or (other == cost and _earlier(link, chain)):
            cost, chain = other, link
    labels = []
    while chain is not None:
        labels.append(chain.labels)
        chain = chain.before
    labels.reverse()
    records = [{"conv": conv, "first_at": p["first_at"], "labels": text} for p, text in zip(pieces, labels)]
    gaps = 0 if least is None else most - least + 1 - turns
    records[-1] |= total | {"gaps": gaps, "cost": cost, "audit": "".join(labels).translate(TO_AUDIT)}
    return records


def _audits(pieces: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(AUDIT))

    def join(batches):
        held, conv = [], None
        for batch in batches:
            for piece in batch.to_pylist():
                if held and piece["conv"] != conv:
                    yield from _joined(conv, held)
                    held = []
                conv = piece["conv"]
                held.append(piece)
        if held:
            yield from _joined(conv, held)

    return pieces.repartition("conv").sortWithinPartitions("conv", "first_at").mapInArrow(lambda batches: _batches(join(batches), schema), AUDIT)


# --- the operator --------------------------------------------------------------------
def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (at, conv, turn, role, text, fault, digest), written in order with ascending numbers ``at``; faults but for duplicates."""
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    line = ["conv", "turn", "role", "_head", "_hash", "_salt"]
    keyed = rows.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_salt": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*line).sortWithinPartitions(*line)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return written(ordered.select(F.monotonically_increasing_id().alias("at"), "conv", "turn", "role", "text", fault.alias("fault"), F.unhex(F.sha2("text", 256)).alias("digest")), "turns")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE_ROWS, modulus: int = (1 << 61) - 1) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) after repair.

    Conversations: conv, gaps, blank, duplicate, truncated, illegal (counts before repair), cost, audit. Rows: conv, at, pos, role, text, edit, in the order
    of (at, pos) within a conversation; edits are K, R and I.
    """
    spark = conversations.sparkSession
    space = F.lit(" ")
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    turns = _ordered(rows)
    narrow = turns.select("at", "conv", "turn", "role", "fault", "digest")
    first = narrow.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    repeated = F.when(F.col("_first").isNull() & ~F.col("fault").eqNullSafe("blank"), "duplicate").otherwise(F.col("fault"))
    faulty = narrow.join(first, "at", "left").select("at", "conv", "turn", F.substring("role", 1, 1).alias("initial"), repeated.alias("fault"))
    audits = written(_audits(_pieces(spark, faulty, piece_rows, modulus)), "audits")
    whole = audits.where(F.col("cost").isNotNull()).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # One token per row: the inserts before it, its own edit, and after the last row of a piece the inserts that follow.
    tokens = F.regexp_extract_all("labels", F.lit(r"[ua]*[KDUA](?:[ua]+\z)?"), F.lit(0))
    edits = audits.select("first_at", F.posexplode(tokens).alias("_pos", "token")).select((F.col("first_at") + F.col("_pos")).alias("at"), "token").where("token <> 'D'")
    none = F.array().cast("array<struct<role:string,text:string,edit:string>>")

    def inserts(part: Column) -> Column:
        row = lambda x: F.struct(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
        return F.when(part == "", none).otherwise(F.transform(F.split(part, ""), row))

    own = F.regexp_extract("token", "([KDUA])", 1)
    role = F.when(own == "K", F.col("role")).when(own == "U", ROLES["u"]).otherwise(ROLES["a"])
    stays = F.struct(role.alias("role"), F.col("text").alias("text"), F.when(own == "K", "K").otherwise("R").alias("edit"))
    made = F.concat(inserts(F.regexp_extract("token", "^([ua]*)", 1)), F.when(own == "D", none).otherwise(F.array(stays)), inserts(F.regexp_extract("token", "[KDUA]([ua]*)", 1)))
    repaired = turns.select("at", "conv", "role", "text").join(edits, "at").select("conv", "at", F.posexplode(made).alias("pos", "_made"))
    return whole, repaired.select("conv", "at", "pos", "_made.role", "_made.text", "_made.edit")


def digests(repaired: DataFrame) -> DataFrame:
    """Rows (conv, repaired_sha256): hash of a conversation's ``role:text`` lines in order, streamed line by line."""

    def hashed(batches):
        conv, digest, out = None, None, []
        for batch in batches:
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if digest is not None and own == conv:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256(line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv", "repaired_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return repaired.repartition("conv").sortWithinPartitions("conv", "at", "pos").mapInArrow(hashed, "conv bigint, repaired_sha256 string")


# --- the query -----------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with one of five faults in a quarter of them, chosen by the CRC-32 of id and turn."""
    space = F.lit(" ")
    known = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    known = known.withColumn("_fault", F.crc32(name) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    source = table(prepare(spark), sf_dir, "conversations")
    whole, rows = repair(damaged(source))
    every = source.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    hashed = digests(rows).withColumnRenamed("conv", "_hashed")
    found = every.join(whole, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    far = 10**12
    state = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 't': {3}}}"

    def add(s: str, cost: str, letter: str, role: str | None = None, text: str = "''") -> str:
        return state.format(s, cost, letter, f"{s}.t" if role is None else f"list_append({s}.t, {role} || ':' || {text})")

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def when(condition: str) -> str:
        return f"CASE WHEN gone OR NOT ({condition}) THEN {far} ELSE extra END"

    def keep(s: str, initial: str) -> str:
        return add(s, when(f"ini = '{initial}'"), "K", "role", "text")

    def rerole(s: str, role: str) -> str:
        return add(s, f"({when('true')}) + 1", "R", f"'{role}'", "text")

    delete = [add(f"s{q}", "2", "D") for q in range(4)]
    n0 = least(delete[0], keep("s0", ""))
    n1 = least(delete[1], keep("s0", "s"), keep("s1", ""))
    n2 = least(delete[2], keep("s2", ""), *[x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), rerole(s, "user"))])
    n3 = least(delete[3], keep("s3", ""), keep("s2", "a"), rerole("s2", "assistant"))
    user = least("n2", *[add(s, "5", "I", "'user'") for s in ("n0", "n1", "n3")])
    assistant = least("n3", add("m2", "5", "I", "'assistant'"))
    none = "{{'c': {0}::BIGINT, 'a': '', 't': []::VARCHAR[]}}"
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b: {byte}), 4294967295)"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT *, {crc} % 20 AS f FROM named),
hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE f <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM hurt),
faulty AS (
  SELECT conv_id, turn, role, text, r, role[1:1] AS ini, coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY r) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS illegal,
         CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN seen[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM numbered),
costed AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS r, {none.format(0)} AS s0, {none.format(far)} AS s1,
         {{'c': 5::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3
  FROM costed
  UNION ALL
  SELECT conv_id, r, n0, n1, m2, {assistant}
  FROM (SELECT *, {user} AS m2 FROM (
    SELECT c.conv_id, c.r, {n0} AS n0, {n1} AS n1, {n2} AS n2, {n3} AS n3
    FROM walk w JOIN costed c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.r = w.r + 1))),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM costed GROUP BY conv_id),
best AS (SELECT w.conv_id, list_min([s0, s3]) AS s FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.r = c.n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP13_SQL = _sql()

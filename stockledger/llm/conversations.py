"""Operator 11: conversation structure repair over a suffix-shared automaton.

Every row of a conversation is one letter: its role's initial (u, a, s or another) in lower case, in upper
case if its text is truncated, or x if it must be deleted (blank or duplicate).  A conversation's letters
are its signature; the cheapest repair depends on the signature alone.

1. ``facts``: one narrow row per conversation row (letter parts and a digest of role and text, no text),
   stored.  Duplicates: the first occurrence of each digest, partially aggregated, only for digests that
   occur again.
2. ``signatures``: narrow rows sorted per conversation and streamed; one row per conversation with its
   signature and counts.
3. ``audits``: the automaton.  A node is a distinct suffix of the distinct signatures: one letter and the node
   of the rest, so equal endings share their nodes across all conversations.  Distinct signatures are
   range-partitioned and sorted by their reversed letters: that order is a depth-first walk of the
   automaton from the end, so the nodes that a signature shares with its predecessor are the top of the
   path kept in ``Path``, and cost-to-go and best edit of a new node are computed once for each grammar
   state.  A task holds one path, not the automaton; only the path at a task's start is computed again.
   Ties: edits that leave one (node, state) differ in their initial, so the least initial among the
   cheapest edits gives the least audit; no strings are compared.
4. ``repair``: texts are exchanged once, by conversation and order, behind their conversation's audit, and
   hashed as they stream by.  A task holds one row and one audit, never a conversation's texts.

The final hash runs over a conversation's repaired rows in order, so one conversation is streamed by one
task; of it, a letter a row is held.  A conversation's signature must fit into a cell (2^31 rows).

Cases: a null role or text counts as one space; null ids form one conversation; null turns come first and
do not count for gaps; rows of one turn come by role, then by the digest of role and text, copies behind
their original; a conversation without rows after the damage has zeros, an empty audit and the hash of
the empty text; an empty table gives no rows; very long texts are streamed.  Only the four columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stockledger.llm.common import read, stored

# Fixed by the contract: costs of the edits, blanks and sentence ends.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# Grammar states of (s?(ua)+)?: nothing yet, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = (USER, USER, ASSISTANT, USER)        # state behind the user or assistant row that may come next
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FAR = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: (conv_id, turn, role, text, copy, gone).

    A dropped row stays as a mark (``gone``), so that no conversation is lost.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).cast("int")
    src = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), case.alias("case"))
    c = F.col("case")
    return src.select(
        "conv_id", "turn", F.when(c == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(c == 1, F.lit("")).when(c == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(c == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (c == 0).alias("gone"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damage``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _digest() -> Column:
    """SHA-256 of role and text; the role's length keeps the two apart."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


def facts(rows: DataFrame) -> DataFrame:
    """One narrow row per row: order, initial, blank, truncated, whether the digest was seen earlier."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = stored(rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), "copy", "gone", F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"), (~last.isin(*ENDS)).alias("truncated")), "conversation-facts")
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), F.col("copy").alias("copy"))
    again = narrow.where(~F.col("gone") & ~F.col("blank")).groupBy("conv_id", "digest") \
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1") \
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    return narrow.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left") \
        .select(*narrow.columns, F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))


def letter_of(initial: str, deleted: bool, truncated: bool) -> str:
    if deleted:
        return "x"
    letter = initial if initial in KEPT else "o"
    return letter.upper() if truncated else letter


ORDER = ("turn", "role", "digest", "copy")
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature): one row per conversation."""
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_COUNTS}, signature string"
    names = ("conv_id", "turn", "role", "digest", "copy", "gone", "initial", "blank", "truncated", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def fresh_state() -> dict:
            return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                    "before": None, "place": None, "letters": bytearray()}

        def done() -> None:
            if state is not None:
                gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
                out.append((key[0], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["letters"].decode()))

        for b in batches:
            for conv, turn, role, digest, copy, gone, initial, blank, truncated, later in zip(*(b.column(n).to_pylist() for n in names)):
                if state is None or key[0] != conv:
                    done()
                    key, state = (conv,), fresh_state()
                if gone:
                    continue
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["turns"] == 0 else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
                place = (turn, digest, copy)
                duplicate = not blank and (later or place == state["place"])
                state["place"] = place
                truncated = truncated and not blank and not duplicate
                for name, hit in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
                    state[name] += hit
                if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["before"] = initial
                state["letters"] += letter_of(initial, blank or duplicate, truncated).encode()
            yield batch(out)
            out = []
        done()
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 7
        types = [id_type, *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    return rows.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, kind)


def node(letter: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """(cost-to-go, best edit) for each grammar state of the node ``letter`` in front of ``rest``' costs."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    best = []
    for state in range(4):
        edits = [(DELETE + rest[state], "D")]
        if role != "x":
            edits.append((REROLE + extra + rest[EXPECTED[state]], "R"))
            if state in KEPT.get(role, {}):
                edits.append((extra + rest[KEPT[role][state]], "K"))
        best.append(min(edits))
    return _with_inserts(best)


def _with_inserts(best: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
    """Rows inserted in front: one changes the state as the row does, two in a row never pay twice."""
    out = list(best)
    for state in (USER, ASSISTANT):
        out[state] = min(best[state], (INSERT + best[EXPECTED[state]][0], "I"))
    for state in (START, SYSTEM):
        out[state] = min(best[state], (INSERT + out[EXPECTED[state]][0], "I"))
    return tuple(c for c, _ in out), "".join(e for _, e in out)


#: The end of every signature: done at the start and behind an assistant row, else rows are inserted.
END = _with_inserts([(0, "."), (_FAR, "."), (_FAR, "."), (0, ".")])


class Path:
    """The nodes of one signature's suffixes, shortest first; those shared with the signature before are kept."""

    def __init__(self):
        self.letters = ""                       # reversed
        self.costs = array("q", END[0])         # four a node, the end first
        self.edits = bytearray(END[1].encode())
        self.made = 0

    def move(self, reverse: str) -> None:
        """Go to another signature, given from its end; computes only nodes not on the path."""
        keep = common(self.letters, reverse)
        del self.costs[4 * (keep + 1):], self.edits[4 * (keep + 1):]
        rest = tuple(self.costs[-4:])
        for letter in reverse[keep:]:
            rest, edits = node(letter, rest)
            self.costs.extend(rest)
            self.edits += edits.encode()
            self.made += 1
        self.letters = reverse

    def audit(self) -> tuple[int, str]:
        """(cost, edits' initials) of the whole signature from the start state."""
        at, state, out = len(self.letters), START, bytearray()
        while True:
            edit = chr(self.edits[4 * at + state])
            if edit == ".":
                return self.costs[4 * len(self.letters) + START], out.decode()
            out += edit.encode()
            if edit in "IR":
                state = EXPECTED[state]
            elif edit == "K":
                state = KEPT[self.letters[at - 1].lower()][state]
            if edit != "I":
                at -= 1


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    words = signed.select("signature").distinct().withColumn("reverse", F.reverse("signature"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for b in batches:
            out = []
            for reverse in b.column("reverse").to_pylist():
                path.move(reverse)
                out.append(path.audit())
            cost, audit = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    return stored(words.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(run, "signature string, cost long, audit string"), "audits")


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of the repaired rows, for every conversation of ``rows`` (in the form of ``damage``)."""
    signed = stored(signatures(facts(rows)), "signatures")
    judged = signed.join(audits(signed), "signature").drop("signature")
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    head = judged.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("text"),
                         F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("judged"))
    body = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), "turn", "role", _digest().alias("digest"), "copy", "text",
                                             F.lit(None).cast(head.schema["judged"].dataType).alias("judged"))
    dealt = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER) \
        .select("conv_id", "part", "role", "text", "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, out = None, []
        for b in batches:
            for i, (part, role, text) in enumerate(zip(b.column("part").to_pylist(), b.column("role"), b.column("text"))):
                if part == 0:
                    if walk:
                        out.append(walk.done())
                    walk = Hashed(b.column("conv_id")[i].as_py(), b.column("judged")[i].as_py())
                else:
                    walk.row(role.as_py(), text.as_py())
            yield batch(out)
            out = []
        if walk:
            out.append(walk.done())
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], *[pa.array(c, pa.string()) for c in cols[7:]]],
            ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    return dealt.mapInArrow(run, f"conv_id {kind}, {_COUNTS}, cost long, audit string, repaired_sha256 string")


class Hashed:
    """Applies an audit to a conversation's rows as they come and hashes what it leaves."""

    def __init__(self, conv: object, judged: dict):
        self.conv, self.judged, self.audit = conv, judged, judged["audit"]
        self.at, self.state, self.sha, self.first = 0, START, hashlib.sha256(), True
        self._inserts()

    def _put(self, role: str, text: str) -> None:
        if not self.first:
            self.sha.update(b"\n")
        self.first = False
        self.sha.update(f"{role}:{text}".encode())

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = EXPECTED[self.state]
            self._put(ROLE_OF[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
            self._put(role, text)
        elif edit == "R":
            self.state = EXPECTED[self.state]
            self._put(ROLE_OF[self.state], text)
        self._inserts()

    def done(self) -> tuple:
        j = self.judged
        return (self.conv, *(j[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), self.audit, self.sha.hexdigest())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the contract's damage."""
    return repair(damage(read(spark, sf_dir, "conversations")))

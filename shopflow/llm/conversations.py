"""Repair of the structure of conversations at the least cost.

Every row of a conversation has at most one fault (blank, duplicate or
truncated), and the roles of a sound conversation are an optional system turn
and then turns of user and assistant, or nothing. ``signatures`` reduces a
conversation to a letter for each row: the role's initial and the fault.
``plans`` finds the cheapest edits of each different signature by a
suffix-shared automaton: a node is what is still to come of a signature, equal
ends are one node, and a node holds for each state of the grammar the cost to
go and the first edit of the best audit suffix. Signatures are sorted by their reverse, in
ranges, so what two neighbours share is a prefix of a stack and is computed
once. Nodes that differ by a constant cost are one class, so most nodes cost a
look into a small table. ``repair`` and ``digests`` then carry the edits out.

A tie between edits is decided by the first letter in which they differ. From one node
and state, edits that begin with one letter go on from the same node, so the
first letter is all that has to be kept, and memory is linear in the longest signature.

Scale. Texts move once, to their conversation, as a stream sorted by it: a
conversation's rows are never gathered, only its audit, a letter for each edit,
is one value. Signatures are made of hashes and flags. One pattern that most
conversations have is solved once; its join with the conversations is left to
adaptive splitting. Each range of signatures computes the nodes on its first path itself.

Edge cases. Rows are ordered by turn (null first), then role, then the text's SHA-256; equal rows are
rows of their own, all but the first duplicates. A null role or text is one
space. Initials other than s, u and a, and no initial, are never kept. A null
conv_id is a conversation of its own. No rows give no result; a conversation all of whose rows are marked ``absent`` has zeros, an
empty audit and the hash of an empty string. Other columns are ignored.
"""

import hashlib
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merkle import CRC_TABLE, crc_sql
from .shared import materialize

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a state takes, and what an edit writes in it.
TAKES, WRITES = ("su", "u", "a", "u"), "uuau"
AFTER, ROLES = {"s": 1, "u": 2, "a": 3}, {"u": "user", "a": "assistant"}
#: A letter of a signature: the role's initial or o, as a capital if the row is truncated; x for a blank or duplicate row.
GONE = "x"
#: Cost to go and first edit at the end of a conversation, by state.
END = ((0, 2 * INSERT, INSERT, 0), ".II.")


def damage(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent: rows dropped (absent), emptied, stripped of their ends, repeated or given to the user by a hash."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("absent"), F.explode(copies).alias("_copy")).drop("_copy")


def _rows(messages: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    absent = F.col("absent") if "absent" in messages.columns else F.lit(False)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), absent.alias("absent"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def signatures(messages: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature: a row for each conversation."""
    end = F.rtrim("text", F.lit(SPACE))
    flags = _rows(messages).select("conv_id", "absent", "turn", "role", "digest", (end == "").alias("is_blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("is_cut"))
    in_order = Window.partitionBy("conv_id").orderBy("absent", F.col("turn").asc_nulls_first(), "role", "digest")
    initial = F.substring("role", 1, 1)
    rows = flags.withColumns({"at": F.row_number().over(in_order), "turn_before": F.lag("turn").over(in_order), "before": F.lag(initial).over(in_order)})
    alike = Window.partitionBy("conv_id", "absent", "role", "digest").orderBy("at")
    fault = F.when(F.col("absent"), None).when(F.col("is_blank"), "blank").when(F.row_number().over(alike) > 1, "duplicate").when(F.col("is_cut"), "truncated").otherwise("none")
    rows = rows.withColumn("fault", fault)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    here = ~F.col("absent")
    turns = F.count_if(here & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))
    turn, kind = F.when(here, F.col("turn")), "decimal(20,0)"
    gaps = F.max(turn).cast(kind) - F.min(turn).cast(kind) + 1 - turns
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    pair = here & F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    letters = F.array_sort(F.collect_list(F.when(here, F.struct("at", letter.alias("letter")))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count_if(pair).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"),
    )


def node(letter: str, below: tuple) -> tuple[tuple, str]:
    """(costs to go, first edits) by state of a node whose row has this letter and is followed by a node of the costs ``below``."""
    late = TRUNCATED if letter.isupper() else 0
    edits = []
    for state in range(4):
        own = {"D": DELETE + below[state]}
        if letter != GONE:
            own["R"] = REROLE + late + below[AFTER[WRITES[state]]]
            if letter.lower() in TAKES[state]:
                own["K"] = late + below[AFTER[letter.lower()]]
        edits.append(own)
    # an insertion leads to another state before the same row; a second one from there would lead back
    before = [min(own.values()) for own in edits]
    cost = [0, 0, min(before[2], INSERT + before[3]), min(before[3], INSERT + before[2])]
    cost[0], cost[1] = min(before[0], INSERT + cost[2]), min(before[1], INSERT + cost[2])
    for state, own in enumerate(edits):
        own["I"] = INSERT + cost[AFTER[WRITES[state]]]
    best = [min((c, e) for e, c in own.items()) for own in edits]
    return tuple(c for c, _ in best), "".join(e for _, e in best)


class Automaton:
    """The path from the end of a conversation to a node; a signature after another keeps what both end in."""

    def __init__(self):
        self.reverse, self.costs, self.base, self.edits, self.classes, self.nodes = "", [END[0]], [0], [END[1]], {}, 1

    def read(self, reverse: str) -> None:
        same, most = 0, min(len(reverse), len(self.reverse))
        while same < most and reverse[same] == self.reverse[same]:
            same += 1
        for path in (self.costs, self.base, self.edits):
            del path[same + 1 :]
        for letter in reverse[same:]:
            key = letter, self.costs[-1]
            if key not in self.classes:
                cost, edits = node(*key)
                self.classes[key] = tuple(c - min(cost) for c in cost), min(cost), edits
            cost, more, edits = self.classes[key]
            self.costs.append(cost)
            self.base.append(self.base[-1] + more)
            self.edits.append(edits)
        self.nodes += len(reverse) - same
        self.reverse = reverse

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the signature read last."""
        out, state, left = [], 0, len(self.reverse)
        while (edit := self.edits[left][state]) != ".":
            out.append(edit)
            if edit == "K":
                state = AFTER[self.reverse[left - 1].lower()]
            elif edit != "D":
                state = AFTER[WRITES[state]]
            left -= edit != "I"
        return self.base[-1] + self.costs[-1][0], "".join(out)


def _solved(batches):
    found = Automaton()
    for t in batches:
        rows = []
        for reverse in t["reverse"]:
            before = found.nodes
            found.read(reverse)
            rows.append((reverse[::-1], *found.best(), found.nodes - before))
        yield pd.DataFrame(rows, columns=["signature", "cost", "audit", "nodes"])


def plans(found: DataFrame) -> DataFrame:
    """signature, cost, audit of each different signature, and nodes: how many nodes it adds to the automaton of its range."""
    reverse = found.groupBy("signature").agg(F.count("*").alias("n")).select(F.reverse("signature").alias("reverse"))
    return reverse.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInPandas(_solved, "signature string, cost long, audit string, nodes long")


class Edits:
    """Carries an audit out, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _written(self) -> str:
        letter = WRITES[self.state]
        self.state = AFTER[letter]
        return ROLES[letter]

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._written(), ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = AFTER[role[0]]
            yield role, text
        elif edit == "R":
            yield self._written(), text


def _walked(batches):
    """(conv_id, plan, turns) of sorted rows, plan at a conversation's first; a conversation may come in several parts. None after a batch."""
    conv, plan, edits = None, None, None
    for batch in batches:
        for c, p, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "plan", "role", "text")), strict=True):
            if p is not None:
                if edits is not None:
                    yield conv, plan, edits.inserted(), True
                conv, plan, edits = c, p, Edits(p["audit"])
            else:
                yield conv, plan, edits.row(role, text), False
        yield None
    if edits is not None:
        yield conv, plan, edits.inserted(), True
    yield None


def _repaired(batches, kind: pa.DataType):
    rows, n = [], 0
    for x in _walked(batches):
        if x is None:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.string(), pa.string()))], ["conv_id", "n", "role", "text"])
            rows = []
            continue
        for role, text in x[2]:
            rows.append((x[0], n, role, text))
            n += 1
        n = 0 if x[3] else n


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digested(batches, kind: pa.DataType):
    rows, own, empty = [], hashlib.sha256(), True
    for x in _walked(batches):
        if x is None:
            if rows:
                kinds = (kind, *(pa.int64() for _ in _COUNTS), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])
            rows = []
            continue
        conv, plan, turns, last = x
        for role, text in turns:
            own.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
            empty = False
        if last:
            rows.append((conv, *(plan[c] for c in _COUNTS), plan["audit"], own.hexdigest()))
            own, empty = hashlib.sha256(), True


def _ordered(messages: DataFrame) -> DataFrame:
    """The rows of each conversation in order, behind a row that holds its plan."""
    rows = _rows(messages).filter(~F.col("absent"))
    found = materialize(signatures(messages), "signatures")
    planned = found.join(plans(found.select("signature")), "signature")
    heads = planned.select("conv_id", F.struct(*_COUNTS, "audit").alias("plan"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = heads.select("conv_id", "plan", F.lit(0).alias("_kind"), *(none(c) for c in ("turn", "role", "text", "digest")))
    rows = rows.select("conv_id", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"), F.lit(1).alias("_kind"), "turn", "role", "text", "digest")
    both = heads.unionByName(rows).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "plan", "role", "text")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return pa.from_numpy_dtype("int64") if df.schema[column].dataType.simpleString() == "bigint" else pa.string()


def repair(messages: DataFrame) -> DataFrame:
    """conv_id, n, role, text: the turns of repaired conversations (conv_id, turn, role, text; conv_id long or string), numbered from 0."""
    ordered = _ordered(messages)
    return ordered.mapInArrow(partial(_repaired, kind=_arrow(messages, "conv_id")), f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, n long, role string, text string")


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of the repaired turns as lines ``role:text``."""
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    kind = messages.schema["conv_id"].dataType.simpleString()
    return _ordered(messages).mapInArrow(partial(_digested, kind=_arrow(messages, "conv_id")), f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def _best_sql(state: int) -> str:
    """The best of keeping, giving another role to and deleting a row in a state."""
    after, role = AFTER[WRITES[state]], ROLES[WRITES[state]]
    taken = ", ".join(f"'{c}'" for c in TAKES[state])
    kept = "CASE letter WHEN 's' THEN s1 WHEN 'u' THEN s2 ELSE s3 END"
    option = lambda cost, to, edit, lines: f"{{'c': {cost} + ({to}).c, 'e': '{edit}' || ({to}).e, 't': {lines}}}"
    keep = option("late", kept, "K", f"list_prepend(role || ':' || text, ({kept}).t)")
    change = option(f"{REROLE} + late", f"s{after}", "R", f"list_prepend('{role}:' || text, s{after}.t)")
    delete = option(DELETE, f"s{state}", "D", f"s{state}.t")
    return f"list_min([{delete}, CASE WHEN NOT gone THEN {change} END, CASE WHEN NOT gone AND letter IN ({taken}) THEN {keep} END])"


def _insert_sql(to: str, state: int) -> str:
    return f"{{'c': {INSERT} + ({to}).c, 'e': 'I' || ({to}).e, 't': list_prepend('{ROLES[WRITES[state]]}:', ({to}).t)}}"


_KEY = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
_END_SQL = "{'c': CAST(0 AS BIGINT), 'e': '', 't': CAST([] AS VARCHAR[])}"

SQL = f"""
WITH RECURSIVE {CRC_TABLE}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(_KEY)} % 20 AS k FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS cut FROM damaged),
faults AS (
  SELECT *, cut = '' AS blank, cut <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, role[1] AS letter FROM placed
), signed AS (
  SELECT *, blank OR duplicate AS gone, NOT (blank OR duplicate) AND right(cut, 1) NOT IN ('.', '!', '?') AS truncated FROM faults
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM signed GROUP BY conv_id
), best AS (
  SELECT conv_id, n + 1 AS i, {_END_SQL} AS s0, {_insert_sql(_insert_sql(_END_SQL, 2), 1)} AS s1, {_insert_sql(_END_SQL, 2)} AS s2, {_END_SQL} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, list_min([b0, {_insert_sql("c2", 0)}]), list_min([b1, {_insert_sql("c2", 1)}]), c2, c3 FROM (
    SELECT *, list_min([b2, {_insert_sql("b3", 2)}]) AS c2, list_min([b3, {_insert_sql("b2", 3)}]) AS c3 FROM (
      SELECT conv_id, i, {", ".join(f"{_best_sql(k)} AS b{k}" for k in range(4))} FROM (
        SELECT r.*, CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END AS late, b.s0, b.s1, b.s2, b.s3 FROM best b JOIN signed r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)))
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.e, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""

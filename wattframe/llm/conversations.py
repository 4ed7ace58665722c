"""Conversation structure repair: cheapest edits over an automaton of all conversations' endings.

A row is one letter, its role and whether it may stay, so a conversation is a word. The words of
all conversations share their endings: a node of the automaton is a letter and the node of the
rest, and has, for each state of the grammar, the cheapest edits of everything from there on,
worked out once for all conversations that end alike. Long conversations are words in pieces;
a node then keeps the cheapest edits for each state at the end of its piece too, and the
pieces are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm.staging import stage
from wattframe.llm.words import slices

BLANK = " \t\n\x0b\x0c\r"
PIECE_ROWS = 64
PIECE_BYTES = 1 << 20

#: States of the grammar (s?(ua)+)?: nothing yet, after system, after user, after assistant.
STATES = range(4)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after the role that may be given to a row or an inserted row, and that role.
GIVEN = [2, 2, 3, 2]
ROLES = {2: "user", 3: "assistant"}
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows inserted after the last one, by state.
LAST = [0, 2, 1, 0]

Edits = tuple[int, str] | None
Node = tuple[Edits, ...]
#: No row left: from a state to itself at no cost; place 4 * state before + state after.
END: Node = tuple((0, "") if a == b else None for a in STATES for b in STATES)


def letter(role: str, blank_or_repeated: bool, truncated: bool) -> str:
    """x must go; others are their role's initial, o if it is no known one, upper-case if truncated."""
    if blank_or_repeated:
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def before(symbol: str, rest: Node) -> Node:
    """The node of a letter and the rest: the least (cost, audit) from each state to each state.

    Rows are inserted before rows only, so no audit is the beginning of another.
    """
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out: list[Edits] = [None] * 16
    for start in STATES:
        state = start
        for inserted in range(3):
            edits = [(DELETE, "D", state)]
            if initial != "x":
                edits.append((RENAME + extra, "R", GIVEN[state]))
                if (state, initial) in KEPT:
                    edits.append((extra, "K", KEPT[state, initial]))
            for cost, edit, after in edits:
                for end in STATES:
                    if (tail := rest[4 * after + end]) is not None:
                        now = (INSERT * inserted + cost + tail[0], "I" * inserted + edit + tail[1])
                        if out[4 * start + end] is None or now < out[4 * start + end]:
                            out[4 * start + end] = now
            state = GIVEN[state]
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the query plants by crc32 of id and turn."""
    space = F.lit(" ")
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault = F.crc32(place) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_"),
    ).drop("_")


_PIECES = (
    "conv_id long, task int, piece long, word string, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, least long, most long, turns long, roles array<string>, texts array<string>"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


class _Piece:
    """Consecutive rows of a conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.word, self.roles, self.texts, self.size = conv_id, [], [], [], 0
        self.counts = {"x": 0, "=": 0, "t": 0, "illegal": 0}
        self.least = self.most = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        body = text.rstrip(BLANK)
        truncated = bool(body) and not repeated and body[-1] not in ".!?"
        self.counts["x"] += not body
        self.counts["="] += bool(body) and repeated
        self.counts["t"] += truncated
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        self.word.append(letter(role, not body or repeated, truncated))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def row(self, task: int, number: int) -> tuple:
        head, tail = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return (
            self.conv_id, task, number, "".join(self.word), *self.counts.values(),
            head, tail, self.least, self.most, self.turns, self.roles, self.texts,
        )


def _pieces(piece_rows: int):
    """Pieces of conversations from rows in order, each repeated row right after its marker."""
    schema = _arrow(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, piece, previous, marked = TaskContext.get().partitionId(), 0, None, None, None
        for part in slices(batches, "text"):
            out = []
            for conv_id, turn, role, text, mark, marker in zip(*(c.to_pylist() for c in part.columns)):
                key = (conv_id, turn, role, mark)
                if marker:
                    marked = key
                    continue
                full = piece is not None and (len(piece.roles) >= piece_rows or piece.size >= PIECE_BYTES)
                if piece is None or piece.conv_id != conv_id or full:
                    if piece is not None:
                        out.append(piece.row(task, number))
                        number += 1
                    piece = _Piece(conv_id)
                piece.add(turn, role, text, key in (previous, marked))
                previous = key
            yield _batch(out, schema)
        if piece is not None:
            yield _batch([piece.row(task, number)], schema)

    return run


_NODES = "word string, costs array<int>, ranks array<int>, audits array<string>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node of each word, from words in order of their reverse: an ending is worked out once."""
    schema = _arrow(_NODES)
    ending, path = "", [END]  # path[k] is the node of the last k letters
    for batch in batches:
        rows = []
        for word in batch.column(0).to_pylist():
            turned = word[::-1]
            same = 0
            while same < min(len(ending), len(turned)) and ending[same] == turned[same]:
                same += 1
            del path[same + 1 :]
            for symbol in turned[same:]:
                path.append(before(symbol, path[-1]))
            ending, node = turned, path[-1]
            ranks = []
            for start in STATES:
                own = sorted(e[1] for e in node[4 * start : 4 * start + 4] if e is not None)
                ranks += [-1 if e is None else own.index(e[1]) for e in node[4 * start : 4 * start + 4]]
            costs = [-1 if e is None else e[0] for e in node]
            rows.append((word, costs, ranks, ["" if e is None else e[1] for e in node]))
        yield _batch(rows, schema)


_CHOICES = "conv_id long, task int, piece long, exits array<int>, parts array<string>"


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each piece leaves for each state that it enters, from the last piece back."""
    schema = _arrow(_CHOICES)
    none = object()
    conv, ahead = none, []
    for batch in batches:
        rows = []
        for conv_id, task, piece, costs, ranks, audits in zip(*(c.to_pylist() for c in batch.columns)):
            if conv is none or conv_id != conv:
                conv, ahead = conv_id, [INSERT * n for n in LAST]
            best = [
                min((costs[4 * a + b] + ahead[b], ranks[4 * a + b], b) for b in STATES if costs[4 * a + b] >= 0)
                for a in STATES
            ]
            ahead = [cost for cost, _, _ in best]
            exits = [b for _, _, b in best]
            rows.append((conv_id, task, piece, exits, [audits[4 * a + b] for a, b in enumerate(exits)]))
        yield _batch(rows, schema)


_REPAIRS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_ROWS = "conv_id long, place long, edit string, role string, text string"


class _Repair:
    """A conversation as its pieces come in."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.audit, self.cost, self.place = conv_id, 0, [], 0, 0
        self.counts = [0, 0, 0, 0]
        self.least = self.most = self.tail = None
        self.turns = 0
        self.digest = hashlib.sha256()

    def _line(self, edit: str, role: str, text: str) -> tuple:
        if self.place:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode())
        self.place += 1
        return self.conv_id, self.place, edit, role, text

    def _edited(self, audit: str, word: str, roles: list[str], texts: list[str]) -> list[tuple]:
        out, row = [], 0
        for edit in audit:
            if edit == "I":
                self.cost += INSERT
                self.state = GIVEN[self.state]
                out.append(self._line(edit, ROLES[self.state], ""))
                continue
            symbol, role, text = word[row], roles[row], texts[row]
            row += 1
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += (RENAME if edit == "R" else 0) + (TRUNCATED if symbol.isupper() else 0)
            self.state = GIVEN[self.state] if edit == "R" else KEPT[self.state, symbol.lower()]
            out.append(self._line(edit, ROLES[self.state] if edit == "R" else role, text))
        return out

    def add(self, exits: list[int], parts: list[str], piece: dict) -> list[tuple]:
        audit = parts[self.state]
        self.audit.append(audit)
        self.counts = [a + piece[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"))]
        if self.tail is not None and piece["head"] is not None:
            self.counts[3] += self.tail + piece["head"] not in ("su", "ua", "au")
        self.tail = piece["tail"] if piece["tail"] is not None else self.tail
        if piece["least"] is not None:
            self.turns += piece["turns"] - (piece["least"] == self.most)
            self.least = piece["least"] if self.least is None else self.least
            self.most = piece["most"]
        return self._edited(audit, piece["word"], piece["roles"], piece["texts"])

    def close(self) -> tuple[tuple, list[tuple]]:
        audit = "I" * LAST[self.state]
        rows = self._edited(audit, "", [], [])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        whole = "".join([*self.audit, audit])
        return (self.conv_id, gaps, *self.counts, self.cost, whole, self.digest.hexdigest()), rows


def _repairs(want_rows: bool):
    """Conversations from their pieces in order, each right after its choice."""
    schema = _arrow(_ROWS if want_rows else _REPAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, choice = None, None
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(part, 256).to_pylist():
                    if now is None or now.conv_id != row["conv_id"]:
                        if now is not None:
                            end, rows = now.close()
                            out += rows if want_rows else [end]
                        now = _Repair(row["conv_id"])
                    if row["exits"] is not None:
                        choice = row["exits"], row["parts"]
                    elif row["word"] is not None:
                        rows = now.add(*choice, row)
                        out += rows if want_rows else []
                yield _batch(out, schema)
        if now is not None:
            end, rows = now.close()
            yield _batch(rows if want_rows else [end], schema)

    return run


def repaired(rows: DataFrame, ids: DataFrame | None = None, want_rows: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Each conversation's faults and cheapest repair, or with ``want_rows`` its repaired rows.

    ``rows`` has conv_id, turn, role, text. Rows go by turn (NULL first), equal turns by role and
    a digest of the text. A row is blank, a duplicate (role and text seen before) or truncated
    (last character that isn't blank is none of ``.!?``), in this order. Keeping a row costs 0,
    renaming its role 1, deleting it 2 (blank and duplicate rows must go), inserting an empty one
    5, keeping or renaming a truncated one 5 more; roles must then begin like ``(s?(ua)+)?``.
    ``audit`` has the edits' initials, the least string of the cheapest. Columns else: gaps
    (turns missing between least and greatest), blank, duplicate, truncated, illegal (pairs of
    neighbours before the repair other than su, ua, au), cost, repaired_sha256 (of the lines
    ``role:text``). Repaired rows have conv_id, place, edit (K, R or I), role, text.

    Rows are ranged over tasks by conversation and turn, so a conversation may span many tasks;
    pieces of up to ``piece_rows`` rows are chained one by one, and the digest of a conversation,
    which no two tasks can share, is fed piece by piece. One audit must fit a task.

    NULL roles and texts count as one space, NULL ids are one conversation, very long texts are
    taken whole, equal rows are duplicates, other columns are ignored. A conversation of ``ids``
    (conv_id) without rows has zeros, an empty audit and the digest of nothing; empty tables
    give no rows.
    """
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("mark", F.unhex(F.md5(named)))
    turns = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "turn", "role", "mark")
    first = turns.groupBy("mark").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.isnull("turn")).alias("unknown")
    )
    first = first.where("first < last or unknown and last is not null")
    marker = stage(
        turns.join(first, "mark").where("turn > first or unknown and turn is not null")
        .select("conv_id", "turn", "role", F.lit("").alias("text"), "mark", F.lit(1).alias("marker")).distinct(),
        "repeated",
    )
    place = ["conv_id", "turn", "role", "mark"]
    pieces = stage(
        rows.withColumn("marker", F.lit(0)).unionByName(marker)
        .repartitionByRange(*place)
        .sortWithinPartitions(*place, F.desc("marker"))
        .mapInArrow(_pieces(piece_rows), _PIECES),
        "pieces",
    )
    words = pieces.select("word").distinct()
    nodes = words.select("word", F.reverse("word").alias("turned")).repartitionByRange("turned").sortWithinPartitions("turned")
    nodes = nodes.select("word").mapInArrow(_nodes, _NODES)
    choices = (
        pieces.select("conv_id", "task", "piece", "word")
        .join(nodes, "word")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("task"), F.desc("piece"))
        .select("conv_id", "task", "piece", "costs", "ranks", "audits")
        .mapInArrow(_choices, _CHOICES)
    )
    parts = choices.unionByName(pieces, allowMissingColumns=True)
    if ids is not None:
        known = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        parts = parts.unionByName(known, allowMissingColumns=True)
    order = ["conv_id", "task", "piece", F.isnull("exits")]
    return parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _repairs(want_rows), _ROWS if want_rows else _REPAIRS
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repair of every conversation after the planted damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(damaged(conversations), conversations)


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))),
sums AS (
  SELECT conversations.*, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
  FROM conversations, steps),
hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM sums),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS j
  FROM placed),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen),
tallies AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (k > 1 AND j || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ways(conv_id, k, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}
  FROM placed WHERE k = 1
  UNION ALL
  SELECT conv_id, k,
    list_min([e0, {'c': e2.c + 5, 'a': 'I' || e2.a}, {'c': e3.c + 10, 'a': 'II' || e3.a}]),
    list_min([e1, {'c': e2.c + 5, 'a': 'I' || e2.a}, {'c': e3.c + 10, 'a': 'II' || e3.a}]),
    list_min([e2, {'c': e3.c + 5, 'a': 'I' || e3.a}]),
    list_min([e3, {'c': e2.c + 5, 'a': 'I' || e2.a}])
  FROM (
    SELECT w.conv_id, r.k, CASE r.fault WHEN 't' THEN 5 ELSE 0 END AS t, r.fault IN ('b', 'd') AS x,
      list_min([{'c': v0.c + 2, 'a': 'D' || v0.a}, CASE WHEN NOT x THEN {'c': v2.c + 1 + t, 'a': 'R' || v2.a} END,
        CASE WHEN NOT x AND i = 's' THEN {'c': v1.c + t, 'a': 'K' || v1.a}
             WHEN NOT x AND i = 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} END]) AS e0,
      list_min([{'c': v1.c + 2, 'a': 'D' || v1.a}, CASE WHEN NOT x THEN {'c': v2.c + 1 + t, 'a': 'R' || v2.a} END,
        CASE WHEN NOT x AND i = 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} END]) AS e1,
      list_min([{'c': v2.c + 2, 'a': 'D' || v2.a}, CASE WHEN NOT x THEN {'c': v3.c + 1 + t, 'a': 'R' || v3.a} END,
        CASE WHEN NOT x AND i = 'a' THEN {'c': v3.c + t, 'a': 'K' || v3.a} END]) AS e2,
      list_min([{'c': v3.c + 2, 'a': 'D' || v3.a}, CASE WHEN NOT x THEN {'c': v2.c + 1 + t, 'a': 'R' || v2.a} END,
        CASE WHEN NOT x AND i = 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} END]) AS e3
    FROM ways w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k - 1)),
audits AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM ways WHERE k = 1),
walks(conv_id, audit, p, k, state, line) AS (
  SELECT conv_id, audit, 0, 0::BIGINT, 0, NULL::VARCHAR FROM audits
  UNION ALL
  SELECT w.conv_id, audit, p + 1, w.k + (e <> 'I')::INT,
    CASE WHEN e = 'D' THEN state WHEN e = 'K' AND i = 's' THEN 1 WHEN e = 'K' AND i = 'u' THEN 2 WHEN e = 'K' THEN 3
         WHEN state = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text
      ELSE CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walks WHERE p < length(audit)) w
  LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1 AND e <> 'I'),
lines AS (SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY p), '') AS lines FROM walks GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN tallies t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""

import functools
import hashlib
import random
import re
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import types as T

from wattframe.llm import conversations as C
from wattframe.tables import local_table

ROWS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("role", "text", "word", "audit")]
)
INK = re.compile(r"[^\x20\x09-\x0D]")
GIVEN = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def table(spark, rows):
    return local_table(spark, [(*r, "x", "y") for r in rows], ROWS)


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def order(row):
    conv, turn, role, text = row
    mark = hashlib.md5(f"{'' if conv is None else conv}:{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role, mark)


def cheapest(rows, kinds):
    """The least (cost, audit), by trying every edit at every place."""

    @functools.cache
    def best(k, state):
        # state: letters so far that matter: "" or the last one
        ways = []
        if k == len(rows):
            ways.append({"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}[state])
            return min(ways)
        for inserts in range(3):
            now = state
            for _ in range(inserts):
                now = GIVEN[now][0]
            head = (5 * inserts, "I" * inserts)
            add = lambda cost, edit, rest: (head[0] + cost + rest[0], head[1] + edit + rest[1])
            ways.append(add(2, "D", best(k + 1, now)))
            if kinds[k] not in ("blank", "duplicate"):
                extra, initial = 5 * (kinds[k] == "truncated"), rows[k][2][:1]
                ways.append(add(1 + extra, "R", best(k + 1, GIVEN[now][0])))
                if initial and now + initial in ("s", "u", "su", "ua", "au"):
                    ways.append(add(extra, "K", best(k + 1, initial)))
        return min(ways)

    return best(0, "")


def brute(rows, ids):
    out = {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(rows, key=key), key):
        own = sorted(group, key=order)
        kinds, seen = [], set()
        for _, _, role, text in own:
            ink = INK.findall(text)
            kind = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            kinds.append(kind)
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(own, tuple(kinds))
        lines, state, k = [], "", 0
        for edit in audit:
            if edit == "I":
                lines.append(f"{GIVEN[state]}:")
            elif edit == "R":
                lines.append(f"{GIVEN[state]}:{own[k][3]}")
            elif edit == "K":
                lines.append(f"{own[k][2]}:{own[k][3]}")
            k += edit != "I"
            state = lines[-1][0] if edit != "D" else state
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out[own[0][0]] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(kinds.count(x) for x in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def some(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"])
            text = rng.choice(["Yes.", "No!", "Well", "Well", "Is it? ", "", " \t\n", None, "a.\x0b", "é", f"{turn}."])
            rows.append((conv, rng.choice([turn, turn + 3, 2]) if rng.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, 64])
def test_agrees_with_brute_force(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = some(rng, 60, 12)
    own = hurt(rows)
    ids = {r[0] for r in rows} | {1000}
    got = found(C.repaired(table(spark, own).repartition(5), table(spark, [(i, 0, "", "") for i in ids]), piece_rows=piece_rows))
    assert got == brute(own, ids)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["One.", "Two", f"{t}."])) for t in range(900)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(C.repaired(table(spark, rows))) == brute(rows, [])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_planted_damage(spark):
    rows = some(random.Random(3), 80, 7) + [(None, 1, "user", "Hi."), (None, None, None, None), (5, None, "user", "Hi.")]
    got = sorted(map(tuple, C.damaged(table(spark, rows)).collect()), key=str)
    assert got == sorted(hurt(rows), key=str)


def test_missing_ids_turns_and_repeated_rows(spark):
    rows = [(None, None, "user", "A."), (None, None, "user", "A."), (None, 3, "user", "A."), (None, 4, "assistant", "B.")]
    rows += [(1, None, "assistant", "x" * 300000 + "."), (1, 9, "assistant", "x" * 300000 + "."), (2, None, " ", " ")]
    assert found(C.repaired(table(spark, rows * 2))) == brute(rows * 2, [])


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Yes."), (1, 2, "user", " "), (2, 0, "user", "Why?")]
    got = C.repaired(table(spark, rows), want_rows=True).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "R", "user", "Hello."), (1, 2, "K", "assistant", "Yes."), (2, 1, "K", "user", "Why?"), (2, 2, "I", "assistant", "")
    ] or brute(rows, [])[2][6] != "KI"  # deleting the lone row is cheaper than answering it


def test_empty_tables(spark):
    none = table(spark, [])
    assert C.repaired(none).collect() == [] and C.repaired(none, none).collect() == []
    nothing = found(C.repaired(none, table(spark, [(4, 0, "", "")])))
    assert nothing == brute([], [4])


def test_an_ending_is_worked_out_once(monkeypatch):
    import pyarrow as pa

    made = []
    plain = C.before
    monkeypatch.setattr(C, "before", lambda symbol, rest: made.append(symbol) or plain(symbol, rest))
    words = ["uaua", "ua", "xua", "suaua", "", "A", "oua"]
    batch = pa.record_batch([pa.array(sorted(words, key=lambda w: w[::-1]))], names=["word"])
    list(C._nodes(iter([batch])))
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})


def test_checksums_in_sql_are_those_of_crc32():
    own = duckdb.connect()
    own.sql("CREATE TABLE conversations AS SELECT * FROM (VALUES (12, 3, 'user', 'A'), (-5, NULL, 'user', 'A'), (NULL, 7, 'x', 'B')) t(conv_id, turn, role, text)")
    sums = C.OP13_SQL[: C.OP13_SQL.index("hurt AS (")].rstrip().rstrip(",")
    got = own.sql(sums + " SELECT conv_id, turn, f FROM sums").fetchall()
    part = lambda x: " " if x is None else str(x)
    assert all(f == zlib.crc32(f"{part(c)}:{part(t)}".encode()) % 20 for c, t, f in got) and len(got) == 3

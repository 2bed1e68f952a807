"""Repair of the structure of conversations: the cheapest edits that turn a sequence of
roles into ``(s?(ua)+)?`` (an optional system turn, then user and assistant in turn).

A grammar state is what has been written so far: nothing, s, ...u, ...a. Every turn has
a few moves from state to state (inserts, then one of keep, rerole, delete), with a cost
and an audit string. A DuckDB recursive query advances all conversations of a
hash-partitioned batch by one turn at a time and keeps, for each state, the least cost
and of that the least audit. Since a start state and an audit determine the path, the
least of each state is all that later turns need.

A conversation is cut into segments of bounded length, which are solved for every start
state; then the segments are turns themselves, with moves from start to end, and the
same query joins them, level by level. So no batch grows with a conversation. The edits
are carried out on the sorted stream of a conversation's turns, one at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import groupby, islice
from operator import itemgetter

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from channelweave.llm.shared import slices, write_table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a segment, and turns (or segments) of a batch on average.
SEGMENT, BATCH = 256, 20_000
BLANK = " \t\n\v\f\r"
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts lead from a state to a state; the fewest are enough, more would cost more.
INSERTS = [(q, q, 0) for q in range(4)] + [(NOTHING, USER, 1), (SYSTEM, USER, 1), (USER, ASSISTANT, 1), (ASSISTANT, USER, 1), (NOTHING, ASSISTANT, 2), (SYSTEM, ASSISTANT, 2)]
#: State before a written turn -> state after it, by its role's initial.
WRITES = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
INITIALS = list(WRITES)
#: Kinds of turns: 0 must go; then one for each initial (any other last), whole; then
#: one for each initial, truncated.
MUST_GO = 0
SOLVED = "conv_id {id}, segment long, start int, state int, cost long, audit string"


def moves() -> pa.Table:
    """(kind, f, t, cost, audit): all ways of a turn from state f to state t."""
    rows = []
    for kind in range(1 + 2 * len(INITIALS)):
        extra = TRUNCATED * (kind > len(INITIALS))
        initial = INITIALS[(kind - 1) % len(INITIALS)]
        for f, q, n in INSERTS:
            rows.append((kind, f, q, INSERT * n + DELETE, "I" * n + "D"))
            if kind != MUST_GO:
                rows += [(kind, f, t, INSERT * n + extra, "I" * n + "K") for p, t in WRITES[initial].items() if p == q]
                rows += [(kind, f, t, INSERT * n + extra + REROLE, "I" * n + "R") for x in "ua" for p, t in WRITES[x].items() if p == q]
    return pa.table(dict(zip(("kind", "f", "t", "cost", "audit"), map(list, zip(*rows, strict=True)), strict=True)))


#: One recursion a turn: ``steps`` (key, first, n, kind) and ``moves`` of each kind.
ADVANCE = """
WITH RECURSIVE reached(key, start, state, n, best) USING KEY (key, start, state) AS (
  SELECT DISTINCT key, q, q, 0::BIGINT, {'cost': 0::BIGINT, 'audit': ''} FROM steps, (SELECT unnest([0, 1, 2, 3])::INTEGER AS q) WHERE NOT first OR q = 0
  UNION
  SELECT r.key, r.start, m.t, r.n + 1, min({'cost': r.best.cost + m.cost, 'audit': r.best.audit || m.audit})
  FROM reached r JOIN steps s ON s.key = r.key AND s.n = r.n + 1 JOIN moves m ON m.kind = s.kind AND m.f = r.state GROUP BY ALL)
SELECT g.conv_id, g.segment, r.start, r.state, r.best.cost AS cost, r.best.audit AS audit
FROM reached r JOIN (SELECT key, any_value(conv_id) AS conv_id, any_value(segment) AS segment, max(n) AS n FROM steps GROUP BY 1) g ON g.key = r.key AND g.n = r.n
"""
STEPS = "CREATE TEMP TABLE steps AS SELECT dense_rank() OVER (ORDER BY conv_id, segment) AS key, conv_id, segment, segment = 0 AS first, n, kind FROM "


def solve(steps: str, tables: dict[str, pa.Table]) -> pa.Table:
    """Run the recursion over a batch; ``steps`` selects (conv_id, segment, n, kind)."""
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as con:
        for name, table in tables.items():
            con.register(name, table)
        con.execute(STEPS + f"({steps})")
        found = con.sql(ADVANCE).to_arrow_table()
    return found.set_column(2, "start", found["start"].cast(pa.int32())).set_column(3, "state", found["state"].cast(pa.int32()))


def solve_turns(batch: pa.Table, length: int) -> pa.Table:
    """(conv_id, segment, pos, kind) of whole segments: their least costs and audits."""
    return solve(f"SELECT conv_id, segment, 1 + pos % {length} AS n, kind FROM turns", {"turns": batch, "moves": moves()})


def join_segments(batch: pa.Table, length: int) -> pa.Table:
    """Solved segments, (conv_id, upper, segment, start, state, cost, audit): those of an
    upper segment joined; each is a kind of its own."""
    parts = "SELECT dense_rank() OVER (ORDER BY conv_id, segment) AS kind, * FROM solved"
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as con:
        con.register("solved", batch)
        known = con.sql(parts).to_arrow_table()
    ways = known.select(["kind", "start", "state", "cost", "audit"]).rename_columns(["kind", "f", "t", "cost", "audit"])
    return solve(f"SELECT DISTINCT conv_id, upper AS segment, 1 + segment % {length} AS n, kind FROM known", {"known": known, "moves": ways})


def in_batches(rows: DataFrame, segment: str, run: Callable[[pa.Table], pa.Table], total: int) -> DataFrame:
    """``run`` on batches of whole segments, dealt by hash; ids keep their type."""
    bucket = F.pmod(F.xxhash64("conv_id", segment), F.lit(max(1, -(-total // BATCH))))

    def batch(table: pa.Table) -> pa.Table:
        return run(table)

    schema = SOLVED.format(id=rows.schema["conv_id"].dataType.simpleString())
    return rows.groupBy(bucket.alias("bucket")).applyInArrow(batch, schema)


def faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, pos, fault, kind): a conversation's turns from 0 on, by
    turn with nulls first (equal turns by role and text), and each one's first fault."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    kept = F.rtrim("text", F.lit(BLANK))
    fault = F.when(kept == "", "blank").when(again, "duplicate").when(~F.right(kept, F.lit(1)).isin(*".!?"), "truncated")
    initial = F.substring("role", 1, 1)
    at = F.array_position(F.array(*map(F.lit, INITIALS[:3])), initial)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(F.when(at == 0, len(INITIALS)).otherwise(at) + F.when(F.col("fault") == "truncated", len(INITIALS)).otherwise(0))
    return rows.withColumn("fault", fault).withColumn("kind", kind.cast("long"))


def measures(rows: DataFrame) -> DataFrame:
    """Per conversation of ``faults``: gaps, blank, duplicate, truncated, illegal."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    tagged = rows.select("conv_id", "turn", "fault", fresh.cast("long").alias("fresh"), (F.col("pos").cast("boolean") & ~pair.isin("su", "ua", "au")).cast("long").alias("illegal"))
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("fresh"), F.lit(0)).cast("long")
    return tagged.groupBy("conv_id").agg(gaps.alias("gaps"), *counts, F.sum("illegal").alias("illegal"))


def cheapest_edits(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(conv_id, cost, audit) for each conversation of ``faults``, in segments of so many
    turns."""
    above = lambda c: F.floor(F.col(c) / length).cast("long")
    total, last = rows.agg(F.count("*"), F.max("pos")).first()
    solved = in_batches(rows.select("conv_id", above("pos").alias("segment"), "pos", "kind"), "segment", partial(solve_turns, length=length), total)
    parts = (last or 0) // length + 1
    while parts > 1:  # segments are the turns of the next level
        solved = write_table(solved.withColumn("upper", above("segment")), "segments")
        solved = in_batches(solved.select("conv_id", "upper", "segment", "start", "state", "cost", "audit"), "upper", partial(join_segments, length=length), total // length)
        parts = -(-parts // length)
    tail = {SYSTEM: 2, USER: 1}  # inserts that end a sequence
    more = reduce(lambda c, x: c.when(F.col("state") == x[0], x[1]), tail.items(), F).otherwise(0)
    best = F.min(F.struct((F.col("cost") + INSERT * more).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), more)).alias("audit"))).alias("best")
    return solved.groupBy("conv_id").agg(best).select("conv_id", "best.*")


def edited(rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what is written of one conversation: the first row holds
    the audit as its text, the others are the turns in order."""
    audit, at, written, first = next(rows)["text"], 0, 0, ""

    def role_of(own: str | None) -> str:
        nonlocal written, first
        if not written:
            first = (own or "user")[:1]
        written += 1
        return own or ("user" if (written - (first == "s")) % 2 else "assistant")

    def inserts() -> Iterator[tuple[str, str, str]]:
        nonlocal at
        while audit[at : at + 1] == "I":
            yield "I", role_of(None), ""
            at += 1

    for row in rows:
        yield from inserts()
        edit, at = audit[at], at + 1
        if edit != "D":
            yield edit, role_of(row["role"] if edit == "K" else None), row["text"]
    yield from inserts()


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations of sorted batches, each with an iterator of its rows."""
    yield from groupby((r for part in slices(batches) for r in part.to_pylist()), key=itemgetter("conv_id"))


def packed(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(held, schema)


def write_turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The repaired conversations' turns."""
    turns = ({"conv_id": c, "n": n, "edit": edit, "role": role, "text": text} for c, rows in streams(batches) for n, (edit, role, text) in enumerate(edited(rows)))
    return packed(turns, schema, 64)


def write_digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A digest of each repaired conversation; no more than a slice of texts is held."""

    def digest(rows: Iterator[dict]) -> str:
        found = hashlib.sha256()
        for n, (_, role, text) in enumerate(edited(rows)):
            found.update(f"{chr(10) * bool(n)}{role}:{text}".encode())
        return found.hexdigest()

    return packed(({"conv_id": c, "repaired_sha256": digest(rows)} for c, rows in streams(batches)), schema)


def carry_out(rows: DataFrame, edits: DataFrame, write: Callable, schema: str) -> DataFrame:
    """The edits applied to the turns of ``faults``, through a sorted stream in which a
    conversation's audit goes ahead of its turns. ``schema`` follows the id."""
    heads = edits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = rows.select("conv_id", "pos", "role", "text").unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    out = StructType([rows.schema["conv_id"], *StructType.fromDDL(schema).fields])
    return stream.mapInArrow(partial(write, schema=to_arrow_schema(out)), out)


def repair_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation, and its repaired turns (conv_id, n from 0, edit, role, text).

    Null roles and texts read as one space; null ids are one conversation. Equal turns
    go by role and text, rows that repeat are duplicates. Roles count by their first
    character; an empty or other role can only be reroled or deleted. A conversation of
    any length is solved in segments. Other columns are left out. Empty in, empty out.
    The turns are written to the shared folder once."""
    rows = write_table(faults(turns, conv_id, turn, role, text), "turns")
    edits = write_table(cheapest_edits(rows), "edits")
    found = one_row(rows.select("conv_id").distinct(), measures(rows), edits)
    return found, carry_out(rows, edits, write_turns, "n long, edit string, role string, text string")


def one_row(ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """Parts with at most one row an id as one row for each id, null ids too: one
    shuffle, and no join."""
    names = [c for p in parts for c in p.columns if c != "conv_id"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, ids)
    return rows.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in names))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after the damage of the contract, told by a checksum of id and turn."""
    told = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(told) % 20).alias("k")).where("k <> 0")
    text: Column = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def op13_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says, with their cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = write_table(faults(damaged(turns)), "turns")
    edits = write_table(cheapest_edits(rows), "edits")
    digests = carry_out(rows, edits, write_digests, "repaired_sha256 string")
    found = one_row(turns.select("conv_id").distinct(), measures(rows), edits, digests)
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})


_BITS = "list_reduce(range(0, 8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), {0})"
_CRC = f"xor(list_reduce(list_transform(range(1, length(told) + 1), lambda i: ascii(told[i])::BIGINT), lambda c, b: {_BITS.format('xor(c, b)')}, 4294967295::BIGINT), 4294967295)"
OP13_SQL = f"""
WITH RECURSIVE
a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS told FROM conversations),
b AS (SELECT *, {_CRC} % 20 AS k FROM a),
c AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM b WHERE k <> 0),
d AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
e AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM d),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate,
             count_if(fault = 't')::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(n) AS last FROM e GROUP BY 1),
ins(f, q, cost, audit, made) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
    (3, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
w(i, f, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
op AS (SELECT conv_id, n, q AS f, q AS t, 4 AS cost, 'D' AS audit, '' AS made FROM e, (SELECT unnest([0, 1, 2, 3]) AS q)
       UNION ALL SELECT conv_id, n, f, t, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM e JOIN w USING (i) WHERE fault IN ('', 't')
       UNION ALL SELECT conv_id, n, f, t, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || CASE w.i WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM e, w WHERE fault IN ('', 't') AND w.i <> 's'),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS q, {{'cost': 0, 'audit': '', 'made': ''}} AS best FROM e
      UNION ALL
      SELECT r.conv_id, r.n + 1, op.t, min({{'cost': best.cost + ins.cost + op.cost, 'audit': best.audit || ins.audit || op.audit, 'made': best.made || ins.made || op.made}})
      FROM r JOIN ins ON ins.f = r.q JOIN op ON op.conv_id IS NOT DISTINCT FROM r.conv_id AND op.n = r.n + 1 AND op.f = ins.q GROUP BY ALL),
z AS (SELECT r.conv_id, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit, 'made': best.made || ins.made}}) AS best
      FROM r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.last = r.n JOIN ins ON ins.f = r.q AND (ins.q = 3 OR ins.q = 0 AND ins.f = 0) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""

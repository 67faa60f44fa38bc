"""Conversation repair: the cheapest edits that make a conversation's roles follow the grammar.

Role initials are to read ``(s?(ua)+)?``.  A row is kept (K, 0), given the role user or assistant
(R, 1) or deleted (D, 2); an empty row of user or assistant may be inserted anywhere (I, 5).  Blank
rows and repeats are deleted in any case; a truncated row that is not deleted costs 5 more.

Cost layers: for c = 0, 1, 2, ... and each row a bitset tells from which states of the grammar the
rest of the conversation can be repaired at cost c, worked out from the bitsets of lower costs.  The
first layer whose bitset at the first row holds the start gives the cost; following the bits from
there, the least letter first, gives the least of the cheapest audits.  Long conversations are cut
into segments of ``SEGMENT`` rows: walking from the last, the first layers of a segment's four
states are the costs that the segment before it starts from, so work and memory grow with the rows.

Faults, the first that holds: blank (no character outside ``[\\x20\\x09-\\x0D]``), duplicate (role
and text occur earlier in the conversation), truncated (the last such character is none of
``.!?``).  Rows are in order of turn, nulls first, then role and the text's sha256.  Null roles and
texts count as one space, a null conversation id is a conversation; a role that begins with no
letter of the grammar can't be kept.  An empty table gives an empty result; other columns are not
read.

A conversation of very many rows: faults, the search for repeats and the work before it are dealt
by row; one task then sees it as one byte a row, and streams its texts in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import saved, small, table

SEGMENT = 64
#: Costs: insert, delete, rerole, and for a truncated row that stays.
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: States of the grammar: nothing yet, after s, after u, after a; roles and faults as numbers.
START, S, U, A = range(4)
OTHER = 0
FINE, BLANK, DUPLICATE, CUT = range(4)
#: State after a role (s, u, a) from each state; None if the grammar forbids it.
AFTER = {1: (S, None, None, None), 2: (U, U, None, U), 3: (None, None, A, None)}
#: The role that an inserted or reroled row gets in each state, and the state after it.
GIVEN = ((2, U), (2, U), (3, A), (2, U))
NAMES = {2: "user", 3: "assistant"}
#: What is left to pay in each state when no row is left: pairs are completed by insertions.
LEFT = (0, 2 * INSERT, INSERT, 0)
SPACES = " \t\n\x0b\x0c\r"


def _before(role: int) -> bytes:
    """For each set of states: those from which the role leads into it."""
    return bytes(sum(1 << s for s, to in enumerate(AFTER[role]) if to is not None and x >> to & 1) for x in range(16))


_KEPT = {OTHER: bytes(16)} | {r: _before(r) for r in AFTER}
_GIVEN = bytes(a | b for a, b in zip(_KEPT[2], _KEPT[3], strict=True))


def layers(codes: bytes, left: tuple[int, ...], states: int = 0b1111) -> list[bytearray]:
    """Bitsets by cost and row; ``left``: what each state costs after the last row.

    Goes on until each of ``states`` has its first layer.  A code is a fault times 4 plus a role.
    """
    n, out, found = len(codes), [], 0
    none = bytearray(n + 1)
    for c in count():
        new = bytearray(n + 1)
        new[n] = sum(1 << s for s in range(4) if left[s] == c)
        paid = lambda d: out[c - d] if c >= d else none  # noqa: B023, E731
        deleted, inserted, given, cut, cut_given = paid(DELETE), paid(INSERT), paid(REROLE), paid(TRUNCATED), paid(TRUNCATED + REROLE)
        for i in range(n - 1, -1, -1):
            x = deleted[i + 1] | _GIVEN[inserted[i]]
            fault, role = codes[i] >> 2, codes[i] & 3
            if fault == FINE:
                x |= _KEPT[role][new[i + 1]] | _GIVEN[given[i + 1]]
            elif fault == CUT:
                x |= _KEPT[role][cut[i + 1]] | _GIVEN[cut_given[i + 1]]
            new[i] = x
        out.append(new)
        found |= new[0]
        if found & states == states:
            return out


def first_layers(found: list[bytearray]) -> tuple[int, ...]:
    return tuple(next(c for c, x in enumerate(found) if x[0] >> s & 1) for s in range(4))


def trace(codes: bytes, found: list[bytearray], state: int, cost: int) -> tuple[str, int]:
    """The least audit of a segment from a state at a cost, and the state after it."""
    out, i = [], 0
    while i < len(codes):
        fault, role = codes[i] >> 2, codes[i] & 3
        stays = {FINE: 0, CUT: TRUNCATED}.get(fault)
        given = GIVEN[state][1]
        moves = [("D", DELETE, 1, state), ("I", INSERT, 0, given)]
        if stays is not None:
            moves += [("K", stays, 1, AFTER[role][state] if role else None), ("R", REROLE + stays, 1, given)]
        for letter, price, step, to in moves:
            if to is not None and cost >= price and found[cost - price][i + step] >> to & 1:
                out.append(letter)
                cost, i, state = cost - price, i + step, to
                break
        else:
            raise AssertionError("the layers do not lead to an end")
    return "".join(out), state


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation."""
    parts = [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)]
    if len(parts) <= 1:
        found = layers(codes, LEFT, 1 << START)
        audit, state = trace(codes, found, START, len(found) - 1)
        return len(found) - 1, audit + "I" * (LEFT[state] // INSERT)
    base, left, after = 0, LEFT, []
    for part in reversed(parts):
        after.append(left)
        left = first_layers(layers(part, left))
        low = min(left)
        base, left = base + low, tuple(x - low for x in left)
    cost, out, state = base + left[START], [], START
    for part, left in zip(parts, reversed(after), strict=True):
        found = layers(part, left, 1 << state)
        audit, state = trace(part, found, state, len(found) - 1)
        out.append(audit)
    return cost, "".join(out) + "I" * (LEFT[state] // INSERT)


# ---------------------------------------------------------------- Spark

def _full(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha), null roles and texts as a space."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))


def _order() -> list:
    return ["conv_id", F.col("turn").asc_nulls_first(), "role", "sha"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, sha, row, code), one row for each row; the code is the fault times 4 plus the role's number.

    Only rows whose role and text repeat are looked up, so a text that fills a third of the table
    is one row a task before it is shuffled.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(OTHER)
    d = _full(rows).select("conv_id", "turn", "role", "sha", role.alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("row"))
    d = saved(d, "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "row")
    same = d.where("NOT blank").groupBy("conv_id", "role", "sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    same = saved(same.select(F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("sha").alias("of_sha"), F.col("first.row").alias("first_row")), "conversation-repeats")
    d = d.join(small(same, 96), d["conv_id"].eqNullSafe(same["of_conv"]) & (d["role"] == same["of_role"]) & (d["sha"] == same["of_sha"]), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row")), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    return d.select("conv_id", "turn", "role", "sha", "row", (fault * 4 + F.col("initial")).cast("int").alias("code"))


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    """The type of the id, for Spark and for Arrow."""
    return dict(rows.dtypes)["conv_id"], to_arrow_type(rows.schema["conv_id"].dataType)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of one first column, each to be read to its end before the next."""
    return groupby(rows, key=itemgetter(0))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation."""
    kind, arrow = _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow)] + [pa.array(c, pa.int64()) for c in cols[1:-1]] + [pa.array(cols[-1], pa.string())], names)

        for conv, own in _grouped(_rows(batches)):
            codes, low, last, turns = bytearray(), None, None, 0
            for _, turn, code in own:
                codes.append(code)
                if turn is not None and turn != last:
                    low, last, turns = turn if low is None else low, turn, turns + 1
            cost, audit = cheapest(bytes(codes))
            n = [sum(c >> 2 == f for c in codes) for f in (BLANK, DUPLICATE, CUT)]
            illegal = sum((a & 3, b & 3) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(codes[:-1], codes[1:], strict=True))
            out.append((conv, 0 if low is None else last - low + 1 - turns, *n, illegal, cost, audit))
            if len(out) == 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    d = faults(rows).repartition("conv_id").sortWithinPartitions(*_order(), "row").select("conv_id", "turn", "code")
    return d.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows after the edits of ``audits``, places from 0.

    A conversation's rows lie in one partition, in order; its audit comes before its rows, so texts stream.
    """
    kind, arrow = _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            conv, place, edit, role, text = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, arrow), pa.array(place, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "edit", "role", "text"])

        for conv, own in _grouped(_rows(batches)):
            audit, at, state, place = next(own)[3], 0, START, 0
            for _, role, text, _ in own:
                while audit[at] == "I":
                    given, state = GIVEN[state]
                    out.append((conv, place, "I", NAMES[given], ""))
                    at, place = at + 1, place + 1
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = AFTER[" sua".index(role[0])][state]
                elif edit == "R":
                    given, state = GIVEN[state]
                    role = NAMES[given]
                if edit != "D":
                    out.append((conv, place, edit, role, text))
                    place, size = place + 1, size + len(text)
                if len(out) >= 1000 or size > 1 << 20:
                    yield batch()
                    out, size = [], 0
            while at < len(audit):
                given, state = GIVEN[state]
                out.append((conv, place, "I", NAMES[given], ""))
                at, place = at + 1, place + 1
        if out:
            yield batch()

    none = F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("sha"), none.cast("string").alias("text"), "audit")
    body = _full(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "sha", "text", none.cast("string").alias("audit"))
    first, *others = _order()
    d = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(first, "kind", *others)
    return d.select("conv_id", "role", "text", "audit").mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows: sha256 of their ``role:text`` lines."""
    kind, arrow = _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            conv, digest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, arrow), pa.array(digest)], ["conv_id", "repaired_sha256"])

        for conv, own in _grouped(_rows(batches)):
            h = hashlib.sha256()
            for i, (_, role, text) in enumerate(own):
                h.update(("\n" * (i > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            out.append((conv, h.hexdigest()))
            if len(out) == 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults that the checksum of id and turn says."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), key.alias("key")).where("key <> 0")
    text = F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "key")
    return d.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations")
    rows = damage(every)
    found = saved(audits(rows), "conversation-audits")
    ids = every.select(F.col("conv_id").alias("id")).distinct()
    d = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    sums = digests(repaired(rows, found))
    d = d.join(sums, d["id"].eqNullSafe(sums["conv_id"]), "left")
    counted = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select(F.col("id").alias("conv_id"), *counted, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
summed AS MATERIALIZED (SELECT * EXCLUDE (key), xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM keyed, bytes),
d0 AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed WHERE k <> 0),
d1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM d1),
d AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM d2),
rows AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, * FROM d),
sizes AS (SELECT c, max(i) AS n FROM rows GROUP BY c),
-- the cheapest (cost, audit) with which the first i rows end in each state; 1000000 stands for none
walk AS (
  SELECT c, n, 0::BIGINT AS i, {'cost': 0, 'audit': ''} AS z, {'cost': 1000000, 'audit': ''} AS s, {'cost': 1000000, 'audit': ''} AS u, {'cost': 1000000, 'audit': ''} AS a FROM sizes
  UNION ALL
  SELECT c, n, i,
    {'cost': z.cost + 2, 'audit': z.audit || 'D'},
    list_sort([{'cost': s.cost + 2, 'audit': s.audit || 'D'}, {'cost': z.cost + CASE WHEN r = 's' THEN stay ELSE 1000000 END, 'audit': z.audit || 'K'}])[1],
    list_sort([{'cost': u1.cost + 2, 'audit': u1.audit || 'D'}] || list_transform([z, s, a1], lambda x: {'cost': x.cost + CASE WHEN r = 'u' THEN stay ELSE 1000000 END, 'audit': x.audit || 'K'})
      || list_transform([z, s, a1], lambda x: {'cost': x.cost + 1 + stay, 'audit': x.audit || 'R'}))[1],
    list_sort([{'cost': a1.cost + 2, 'audit': a1.audit || 'D'}, {'cost': u1.cost + CASE WHEN r = 'a' THEN stay ELSE 1000000 END, 'audit': u1.audit || 'K'}, {'cost': u1.cost + 1 + stay, 'audit': u1.audit || 'R'}])[1]
  FROM (SELECT w.c, n, w.i + 1 AS i, z, s, r, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS stay,
      list_sort([u] || list_transform([z, s, a], lambda x: {'cost': x.cost + 5, 'audit': x.audit || 'I'}))[1] AS u1, list_sort([a, {'cost': u.cost + 5, 'audit': u.audit || 'I'}])[1] AS a1
    FROM walk w JOIN rows ON rows.c = w.c AND rows.i = w.i + 1)
), best AS MATERIALIZED (SELECT c, list_sort([z, a, {'cost': u.cost + 5, 'audit': u.audit || 'I'}, {'cost': s.cost + 10, 'audit': s.audit || 'II'}])[1] AS b FROM walk WHERE i = n),
-- the edits one by one, to write the repaired rows
steps AS (
  SELECT c, b.audit AS audit, 0::BIGINT AS done, 0::BIGINT AS i, 'z' AS state, NULL::VARCHAR AS line FROM best
  UNION ALL
  SELECT c, audit, done + 1, i, CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN r WHEN state = 'u' THEN 'a' ELSE 'u' END,
    CASE e WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END END
  FROM (SELECT s.*, rows.r, role, text, substr(audit, done + 1, 1) AS e FROM (SELECT * EXCLUDE (i), i + (substr(audit, done + 1, 1) <> 'I')::INT AS i FROM steps WHERE done < length(audit)) s LEFT JOIN rows ON rows.c = s.c AND rows.i = s.i)
), written AS (SELECT c, sha256(coalesce(string_agg(line, chr(10) ORDER BY done), '')) AS sha FROM steps GROUP BY c),
counted AS (SELECT c, any_value(conv_id) AS id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND before || '-' || r NOT IN ('s-u', 'u-a', 'a-u')) AS illegal FROM rows GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (SELECT * FROM counted JOIN best USING (c) JOIN written USING (c)) f ON o.conv_id IS NOT DISTINCT FROM f.id
"""

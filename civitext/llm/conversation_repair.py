"""Repair of the turn structure of conversations by a streamed dynamic programme.

Rows are dealt by conversation once and sorted within their partition. Two
passes of ``mapInPandas`` then read the sorted rows as a stream that may cut a
conversation anywhere, and carry the state of the programme from one Arrow batch
to the next:

1. backwards, the cheapest cost to finish from each of the four states. It adds
   one byte to a row: the edit to choose there in each state, two bits each;
2. forwards, following those edits from the start.

Spark's sort between the passes keeps rows and their compact choices, on disk
where they outgrow memory. A conversation of any length therefore needs no more
memory in Python than a batch; only its audit, which is one value of the result,
grows with it. Choosing the first letter among the cheapest edits at every step
gives the least of the cheapest audits, as all their rest costs the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space, and the ends of a finished sentence.
SPACE, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; the role that must follow and the state it leads to.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: What is still to pay after the last row.
_END = (0, 2 * INSERT, INSERT, 0)
#: Letters of edits in ASCII order, as the two bits of a choice.
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
#: A row's code is three times its initial (s, u, a, other) plus its condition.
_FINE, _CUT, _LOST = range(3)
FAULTS = (None, "truncated", "blank", "duplicate")
_INPUT = "conv string, turn string, role string, text string, copy long, fault int, code int"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of ``conv_id:turn``; nulls in that key, roles and texts become one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """``fault`` (a place in ``FAULTS``) and ``code`` of each row, dealt by conversation."""
    stripped = F.rtrim("text", F.lit(SPACE))
    alike = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    # the window's keys begin with the conversation, so it needs no shuffle of its own
    dealt = rows.repartition("conv_id").withColumn("copy", F.row_number().over(alike).cast("long"))
    fault = F.when(stripped == "", 2).when(F.col("copy") > 1, 3).when(~F.substring(stripped, -1, 1).isin(*ENDS), 1).otherwise(0)
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when(initial == 0, 3).otherwise(initial - 1)
    return dealt.withColumn("fault", fault).withColumn("code", (kind * 3 + F.least("fault", F.lit(2))).cast("int"))


@cache
def _step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The costs before a row from those after it, both above their smallest, and the choices at the row."""
    initial, condition = divmod(code, 3)
    late = TRUNCATED if condition == _CUT else 0
    options = []
    for state in range(4):
        own = {_D: DELETE + after[state]}
        if condition != _LOST:
            own[_R] = RETYPE + late + after[_NEXT[state]]
            if initial == _NEXT[state] - 1:
                own[_K] = late + after[_NEXT[state]]
            elif initial == 0 and state == _START:
                own[_K] = late + after[_SYSTEM]
        options.append(own)
    edited = [min(own.values()) for own in options]
    once, twice = ([edited[s] for s in reach] for reach in (_NEXT, [_NEXT[s] for s in _NEXT]))
    before = [min(a, INSERT + b, 2 * INSERT + c) for a, b, c in zip(edited, once, twice)]
    choices = 0
    for state, own in enumerate(options):
        own[_I] = INSERT + before[_NEXT[state]]
        choices |= min(k for k, cost in own.items() if cost == before[state]) << 2 * state
    least = min(before)
    return tuple(b - least for b in before), choices


def _backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, costs = object(), _END
    for batch in batches:
        choices = []
        for its, code in zip(batch["conv"], batch["code"]):
            if its != conv:
                conv, costs = its, _END
            costs, chosen = _step(costs, code)
            choices.append(chosen)
        yield batch.assign(choices=choices)


def _forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state, place = None, _START, 0
    columns = ["conv", "place", "edit", "turn", "role", "text", "was", "fault"]

    def finish(out: list) -> None:
        nonlocal state, place
        while state in (_SYSTEM, _USER):
            state = _NEXT[state]
            out.append((conv, place, "I", None, _ROLE[state], "", None, None))
            place += 1

    fields = ("conv", "turn", "role", "text", "fault", "choices")
    for batch in batches:
        out: list[tuple] = []
        for its, turn, role, text, fault, choices in zip(*(batch[c] for c in fields)):
            if its != conv:
                finish(out)
                conv, state, place = its, _START, 0
            while (choice := choices >> 2 * state & 3) == _I:
                state = _NEXT[state]
                out.append((its, place, "I", None, _ROLE[state], "", None, None))
                place += 1
            now = role
            if choice == _R:
                now = _ROLE[_NEXT[state]]
            if choice != _D:
                state = _SYSTEM if choice == _K and role[:1] == "s" else _NEXT[state]
            out.append((its, place, LETTERS[choice], turn, now, text, role, FAULTS[fault]))
            place += 1
        yield pd.DataFrame(out, columns=columns)
    out = []
    finish(out)
    yield pd.DataFrame(out, columns=columns)


_EDITS = "conv string, place long, edit string, turn string, role string, text string, was string, fault string"


def _edits(turns: DataFrame) -> DataFrame:
    """The edits of all conversations, each conversation's in order in one partition."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _faults(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text")))
    rows = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "copy", "fault", "code")
    turn = F.col("turn").cast("long")
    back = rows.sortWithinPartitions("conv", turn.desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("copy"))
    chosen = back.mapInPandas(_backwards, f"{_INPUT}, choices int")
    forth = chosen.sortWithinPartitions("conv", turn.asc_nulls_first(), "role", "text", "copy")
    return forth.mapInPandas(_forwards, _EDITS)


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits that make each conversation an optional system turn and pairs of user and assistant.

    Returns ``conv_id, place, edit, turn, role, text, was, fault``: one row for each
    edit in order, from place 0. ``K`` keeps a row, ``R`` gives it the role that
    must stand there, ``D`` deletes it, ``I`` is a new turn without text;
    ``was`` is the role before. The repaired conversation is the rows that are
    not ``D``. Of edits that cost the same, the least string of letters wins.

    Rows are taken by ``turn`` (null first), equal turns by role and text. Null
    roles and texts count as one space. Only the first letter of a role counts;
    a row of another or an empty role is given one or deleted. A row without
    text, or with role and text of an earlier row, is deleted; repeated rows
    therefore leave one. Rows without a ``conv_id`` are one conversation. A
    conversation is emptied where that is cheapest. An empty table gives an
    empty result. Other columns are not used.
    """
    kind = turns.schema["conv_id"].dataType
    return _edits(turns).select(F.col("conv").cast(kind).alias("conv_id"), "place", "edit", F.col("turn").cast("long").alias("turn"), "role", "text", "was", "fault")


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation from its edits in order."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv, figures = None, None

    def new() -> dict:
        return {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "initial": None, "audit": [], "digest": hashlib.sha256(), "empty": True}

    def row() -> tuple:
        gaps = 0 if figures["last"] is None else figures["last"] - figures["first"] + 1 - figures["turns"]
        counts = [figures[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return conv, min(gaps, (1 << 63) - 1), *counts, "".join(figures["audit"]), figures["digest"].hexdigest()

    for batch in batches:
        out = []
        for its, edit, turn, role, text, was, fault in zip(*(batch[c] for c in ("conv", "edit", "turn", "role", "text", "was", "fault"))):
            if figures is None or its != conv:
                if figures is not None:
                    out.append(row())
                conv, figures = its, new()
            figures["audit"].append(edit)
            figures["cost"] += {"D": DELETE, "I": INSERT, "R": RETYPE, "K": 0}[edit]
            if edit != "I":
                if fault is not None:
                    figures[fault] += 1
                    figures["cost"] += TRUNCATED * (fault == "truncated" and edit != "D")
                figures["illegal"] += figures["initial"] is not None and figures["initial"] + was[:1] not in ("su", "ua", "au")
                figures["initial"] = was[:1]
                if turn is not None and int(turn) != figures["last"]:
                    figures["last"] = int(turn)
                    figures["first"] = figures["last"] if figures["first"] is None else figures["first"]
                    figures["turns"] += 1
            if edit != "D":
                figures["digest"].update(("" if figures["empty"] else "\n").encode() + f"{role}:{text}".encode())
                figures["empty"] = False
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([row()] if figures is not None else [], columns=names)


def report(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, and the cost, letters and digest of its repair.

    ``gaps`` counts turn numbers that are missing between the smallest and the
    largest (at most 2**63 - 1), ``illegal`` neighbours whose initials are not
    su, ua or au. Rows and edge cases are those of :func:`repair`, which it
    reads as a stream.
    """
    kind = turns.schema["conv_id"].dataType
    schema = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    done = _edits(turns).mapInPandas(_summaries, schema)
    return done.select(F.col("conv").cast(kind).alias("conv_id"), *done.columns[1:])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = report(damage(conversations)).withColumnRenamed("conv_id", "its_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("its_id")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), none.get(name, F.lit(0).cast("long"))).alias(name)

    return joined.select("conv_id", *map(filled, found.columns[1:]))


#: The same repair by a forward programme over one row for each conversation, row and state. CRC-32 is folded byte by byte.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), roles(state, role, next) AS (
  VALUES ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'a'), ('a', 'user', 'u')
), inserted AS (
  SELECT state, '' AS letters, state AS reached, []::VARCHAR[] AS added FROM roles
  UNION ALL SELECT state, 'I', next, [role || ':'] FROM roles
  UNION ALL SELECT a.state, 'II', b.next, [a.role || ':', b.role || ':'] FROM roles a JOIN roles b ON b.state = a.next
), ways AS (
  SELECT p.state, p.letters, p.added, p.reached, r.role, r.next, 3 * length(p.letters) AS paid FROM inserted p JOIN roles r ON r.state = p.reached
), path(conv_id, i, state, cost, audit, turns) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM figures
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.turns FROM (
    SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'turns': turns}) AS best FROM (
      SELECT p.conv_id, f.i, e.state, p.cost + w.paid + e.price AS cost, p.audit || w.letters || e.letter AS audit, list_concat(p.turns, w.added, e.added) AS turns
      FROM path p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ways w ON w.state = p.state,
        LATERAL (
          SELECT 'D' AS letter, 4 AS price, w.reached AS state, []::VARCHAR[] AS added
          UNION ALL SELECT 'R', CASE WHEN f.fault = 'truncated' THEN 6 ELSE 3 END, w.next, [w.role || ':' || f.text] WHERE f.fault IN ('', 'truncated')
          UNION ALL SELECT 'K', CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, f.initial, [f.role || ':' || f.text]
            WHERE f.fault IN ('', 'truncated') AND (f.initial = w.next OR f.initial = 's' AND w.reached = '')
        ) e
    ) GROUP BY conv_id, i, state
  )
), ended AS (
  SELECT p.conv_id, min({'cost': p.cost + w.paid, 'audit': p.audit || w.letters, 'turns': list_concat(p.turns, w.added)}) AS best
  FROM path p JOIN figures f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.i JOIN ways w ON w.state = p.state WHERE w.reached IN ('', 'a') GROUP BY p.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

"""Conversation structure repair by iterative-deepening A*.

A conversation's rows become a string of turns, a character each: what the turn's role begins with and what is wrong
with it. A repair keeps, reroles and deletes turns and inserts empty ones so that the roles' initials read
``(s?(ua)+)?``; the cheapest repair is sought, of equally cheap ones the first in ASCII order of its edits' initials
(``D`` delete, ``I`` insert, ``K`` keep, ``R`` rerole). Under a cost bound, edits are tried depth first in that order; the bound
is the cost so far plus what the turns ahead must cost at least (every faulty one is deleted or costs more), and
rises to the least value that exceeded it until a path is accepted. States that failed are kept with the
budget that they failed with, and aren't entered again with as little. The first accepting path is the
answer: under the first bound that any path meets, all accepted paths cost the same, and are met in ASCII order.

A long conversation is cut into stretches of ``STRETCH`` turns; the search gives each one's best edits for every
pair of states at its ends, and the best sequence of pairs is chosen from the end backwards, so that time grows with the
number of turns, not with its square. Of equally cheap edits of the same turns none begins another (it would hold more
insertions at the same cost), so the ASCII order of whole edits is settled where they first differ.

Spark damages, orders and describes the turns with window functions, and puts the repaired ones together; Python tasks
see a character a turn, never texts. All turns of a conversation are one row in the end, since its digest is one.

Defined cases: a null role or text is one space, null ids and turns are spaces in the damage's key; a null
conversation id is a conversation of its own; turns sort by turn (nulls first), then role and text, so ties and
repeated rows have one order (and the later ones are duplicates); a conversation without any row left has zeros, no
edits and the digest of an empty string; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import table

#: Costs of edits; a kept or reroled turn that is truncated costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Turns that are searched at once.
STRETCH = 16

#: State -> role initial -> next state: at the start, behind s, behind u, behind a. Accepted: the start, behind a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)

SPACES = "\\x20\\x09-\\x0D"

#: A turn is a digit: what its role begins with (0 other, 1 s, 2 u, 3 a), and 4 more if it is truncated; or ``x``, to be deleted.
INITIALS = " sua"

Edits = list[tuple[str, str]]  #: (edit, role initial of the turn that it leaves, or "")


@cache
def moves(state: int, turn: str) -> list[tuple[str, str, int, int, int]]:
    """(edit, initial, next state, cost, turns taken) from a state in the edits' ASCII order; turn is "" at the end."""
    out = [("D", "", state, DELETE, 1)] if turn else []
    roles = [r for r in "ua" if r in NEXT[state]]
    out += [("I", r, NEXT[state][r], INSERT, 0) for r in roles]
    if turn and turn != "x":
        own, more = INITIALS[int(turn) % 4], TRUNCATED * (int(turn) >= 4)
        if own in NEXT[state]:
            out.append(("K", own, NEXT[state][own], KEEP + more, 1))
        out += [("R", r, NEXT[state][r], REROLE + more, 1) for r in roles]
    return out


def reached(start: int, to: int, turns: str) -> bool:
    """Whether any edits lead from a state to another: none lead back to the start, and behind s leads only an s."""
    return to >= 2 or start == to or (start, to) == (0, 1) and ("1" in turns or "5" in turns)


def least_costs(turns: str) -> list[int]:
    """What the turns from each one on cost at least: a faulty one is deleted or costs more, one of no known role is
    reroled or more, and so is one of two neighbours that both are u or both a, by the cheapest remedy."""
    ahead = [0] * (len(turns) + 2)
    for i in range(len(turns) - 1, -1, -1):
        t = turns[i]
        ahead[i] = ahead[i + 1] + (DELETE if t in "x4567" else REROLE if t == "0" else 0)
        if t in "23" and turns[i + 1 : i + 2] == t:
            ahead[i] = max(ahead[i], ahead[i + 2] + REROLE)
    return ahead


def repair(turns: str, start: int, goals: tuple[int, ...]) -> tuple[int, Edits] | None:
    """The cheapest edits, first in ASCII order, that lead from a state over all turns to one of the goals."""
    if not any(reached(start, to, turns) for to in goals):
        return None
    ahead = least_costs(turns)
    bound = ahead[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        over = None
        path: Edits = []
        stack = [(0, start, 0, iter(moves(start, turns[:1])))]
        if not turns and start in goals:
            return 0, []
        while stack:
            at, state, cost, todo = stack[-1]
            for edit, initial, to, price, taken in todo:
                n, paid = at + taken, cost + price
                if paid + ahead[n] > bound:
                    over = paid + ahead[n] if over is None else min(over, paid + ahead[n])
                    continue
                if failed.get((n, to), -1) >= bound - paid:
                    continue
                path.append((edit, initial))
                if n == len(turns) and to in goals:
                    return paid, path
                stack.append((n, to, paid, iter(moves(to, turns[n : n + 1]))))
                break
            else:
                stack.pop()
                failed[at, state] = max(failed.get((at, state), -1), bound - cost)
                if path:
                    path.pop()
        bound = over  # a goal that is reached at all is reached by some bound


def before(a: Iterator[str], b: Iterator[str]) -> bool:
    return next((x < y for x, y in zip(a, b, strict=False) if x != y), False)


def best_repair(turns: str, stretch: int = STRETCH) -> tuple[int, Edits]:
    """(cost, edits) of all turns, stretch by stretch from the end."""
    if len(turns) <= stretch:
        return repair(turns, 0, ACCEPTED)
    parts = [turns[i : i + stretch] for i in range(0, len(turns), stretch)]
    known = cache(repair)  # equal stretches are searched once
    best: list[dict[int, tuple[int, Edits, int | None]]] = [{} for _ in parts]  # state -> (cost to the end, own edits, next state)

    def edits(at: int, found: tuple[int, Edits, int | None]) -> Iterator[Edits]:
        while True:
            yield found[1]
            if found[2] is None:
                return
            at, found = at + 1, best[at + 1][found[2]]

    letters = lambda at, found: (e[0] for e in chain.from_iterable(edits(at, found)))
    for at in range(len(parts) - 1, -1, -1):
        for state in range(len(NEXT)) if at else (0,):
            for to in (None,) if at == len(parts) - 1 else range(len(NEXT)):
                own = known(parts[at], state, ACCEPTED if to is None else (to,))
                if own is None or (to is not None and to not in best[at + 1]):
                    continue
                found = (own[0] + (best[at + 1][to][0] if to is not None else 0), own[1], to)
                old = best[at].get(state)
                if old is None or found[0] < old[0] or (found[0] == old[0] and before(letters(at, found), letters(at, old))):
                    best[at][state] = found
    return best[0][0][0], list(chain.from_iterable(edits(0, best[0][0])))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with null roles and texts as spaces -> the same with ``gone`` and ``copy``: by a checksum of
    id and turn, rows are dropped (kept here as gone), emptied, truncated, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies)


def described(rows: DataFrame) -> DataFrame:
    """rows with their place in the conversation, ``code`` as above, and which faults they have."""
    order = ["turn", "role", "text", "copy"]
    in_order = Window.partitionBy("conv_id", "gone").orderBy(*order)
    same = Window.partitionBy("conv_id", "gone", "role", "told").orderBy(*order)
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")
    initial = F.substring("role", 1, 1)
    # Equal texts are told by their digest, so that no sort carries a text as a key twice.
    rows = rows.withColumn("told", F.sha2("text", 256)).withColumns({"place": F.row_number().over(in_order), "again": F.row_number().over(same) > 1, "last": F.lag(initial).over(in_order)})
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut, "truncated")
    digit = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    rows = rows.withColumn("fault", fault)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise((digit + F.when(F.col("fault") == "truncated", 4).otherwise(0)).cast("string"))
    wrong = F.col("last").isNotNull() & ~F.concat("last", initial).isin("su", "ua", "au")
    return rows.withColumns({"code": code, "wrong": wrong}).drop("told", "again", "last", "copy")


FIX = "cost long, audit string, turns array<struct<place: int, role: string>>"


def repaired(codes: pd.Series) -> pd.DataFrame:
    """A conversation's codes -> its repair; turns: those that are left by their place, with a new role where it changes."""
    names, out = {"u": "user", "a": "assistant"}, []
    for turns in codes:
        cost, edits = best_repair(turns)
        left, place = [], 0
        for edit, initial in edits:
            place += edit != "I"
            if edit != "D":
                left.append({"place": 0 if edit == "I" else place, "role": None if edit == "K" else names[initial]})
        out.append((cost, "".join(e for e, _ in edits), left))
    return pd.DataFrame(out, columns=["cost", "audit", "turns"])


def repair_conversations(rows: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired:
    array of role:text)."""
    rows = rows.select("conv_id", "turn", "role", "text")
    if damage:
        rows = damaged(rows)
    else:
        rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))
    here = ~F.col("gone")
    count = lambda c: F.count(F.when(here & c, 1))
    turn = F.when(here, F.col("turn"))
    kept = F.collect_list(F.when(here, F.struct("place", "code", "role", "text")))
    # Turns that differ are counted in the window's order, where a distinct aggregate would shuffle once more.
    steps = F.lag("turn").over(Window.partitionBy("conv_id", "gone").orderBy("place"))
    each = described(rows).withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(steps))
    whole = each.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("wrong")).alias("illegal"), F.array_sort(kept).alias("rows"),
    )
    whole = whole.withColumn("codes", F.array_join(F.transform("rows", lambda r: r["code"]), "")).withColumn("fix", F.pandas_udf(repaired, FIX)("codes"))
    row = lambda t: F.get("rows", t["place"] - 1)
    texts = F.transform("fix.turns", lambda t: F.concat(F.coalesce(t["role"], row(t)["role"]), F.lit(":"), F.when(t["place"] > 0, row(t)["text"]).otherwise("")))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "fix.cost", "fix.audit", texts.alias("repaired"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))


def _sql() -> str:
    """The cheapest edits by dynamic programming: for each state the least (cost, edits, roles and places) so far, as one
    string with the cost in front; insertions are tried before each turn and at the end."""
    width = 9

    def step(state: int, cost: str, edit: str, turn: str) -> str:
        s = f"s[{state + 1}]"
        return f"{{'k': lpad(({s}.k[:{width}]::BIGINT + {cost})::VARCHAR, {width}, '0') || {s}.k[{width + 1}:] || '{edit}', 't': list_concat({s}.t, {turn})}}"

    def least(options: list[str]) -> str:
        # Structs compare by k first; states that aren't reached have a k that starts with 9.
        return f"list_min([{', '.join(options)}])"

    def inserted() -> str:
        u = [f"s[{q + 1}]" for q in range(4)]
        u[2] = least([u[2], *(step(q, str(INSERT), "I", "['user:']") for q in (0, 1, 3))])
        return f"[{', '.join(u)}]"

    def inserted_a() -> str:
        return f"[s[1], s[2], s[3], {least(['s[4]', step(2, str(INSERT), 'I', '[' + repr('assistant:') + ']')])}]"

    def taken() -> str:
        more = f"CASE WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
        own = "[r.role || ':' || r.text]"
        out = []
        for to, initial, name in ((0, None, None), (1, "s", None), (2, "u", "user"), (3, "a", "assistant")):
            options = [step(to, str(DELETE), "D", "[]::VARCHAR[]")]
            for q in range(4):
                if initial in NEXT[q]:
                    bad = "r.fault IN ('blank', 'duplicate')"
                    options.append(f"CASE WHEN {bad} OR r.role[:1] <> '{initial}' THEN {{'k': '9', 't': []::VARCHAR[]}} ELSE {step(q, more, 'K', own)} END")
                    if name:
                        options.append(f"CASE WHEN {bad} THEN {{'k': '9', 't': []::VARCHAR[]}} ELSE {step(q, f'{REROLE} + ' + more, 'R', f'[{name + chr(58)!r} || r.text]')} END")
            out.append(least(options))
        return f"[{', '.join(out)}]"

    far = "{'k': '900000000', 't': []::VARCHAR[]}"
    start = f"[{{'k': '{'0' * width}', 't': []::VARCHAR[]}}, {far}, {far}, {far}]"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b: xor(c // 256, crc.t[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM hurt),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
  lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY place) || role[:1] AS pair FROM placed),
whole AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'fault': fault}} ORDER BY place) AS rows FROM faulty GROUP BY conv_id),
run AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, rows, 1 AS pos, {start} AS s FROM whole
  UNION ALL SELECT conv_id, gaps, blank, duplicate, truncated, illegal, rows, pos + 1, {taken()} FROM (SELECT * REPLACE ({inserted_a()} AS s) FROM (SELECT *, rows[pos] AS r FROM (SELECT * REPLACE ({inserted()} AS s) FROM run WHERE pos <= len(rows))))),
ended AS (SELECT *, list_min([s[1], s[4]]) AS won FROM (SELECT * REPLACE ({inserted_a()} AS s) FROM (SELECT * REPLACE ({inserted()} AS s) FROM run WHERE pos > len(rows)))),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(won.k[:{width}]::BIGINT, 0) AS cost, coalesce(won.k[{width + 1}:], '') AS audit, sha256(coalesce(array_to_string(won.t, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN ended ON every.conv_id IS NOT DISTINCT FROM ended.conv_id"""


SQL = _sql()

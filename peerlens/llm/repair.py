"""Repair of conversation structure by depth-first branch-and-bound.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Edits have costs; the cheapest sequence is searched, the
ASCII-least one of equal cost. Everything but the search are DataFrame operations; the search sees one letter
for each row, and a pattern of letters that many conversations share is solved once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import durable, table
from peerlens.llm.merkle import CRC_TABLE, crc_sql

# Blanks, sentence ends and the costs of the edits.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept role, by (state, letter); what may follow a state by Rerole or Insert.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = (None, None, "user", "assistant")
MOST = 1 << 60


def suffix_bounds(pattern: str) -> list[tuple[int, int, int, int]]:
    """For each row and state the least cost of what is left, with no regard to audits. Never above the true cost."""
    after = (0, 2 * INSERT, INSERT, 0)
    bounds = [after]
    for letter in reversed(pattern):
        kind, more = letter.lower(), TRUNCATED if letter.isupper() else 0
        least = []
        for state in range(4):
            best = DELETE + after[state]
            if kind != "x":
                if (state, kind) in KEEPS:
                    best = min(best, more + after[KEEPS[state, kind]])
                best = min(best, REROLE + more + after[NEXT[state]])
            least.append(best)
        user = min(least[USER], INSERT + least[ASSISTANT])
        after = (min(least[START], INSERT + user), min(least[SYSTEM], INSERT + user), user, min(least[ASSISTANT], INSERT + least[USER]))
        bounds.append(after)
    bounds.reverse()
    return bounds


def cheapest(pattern: str) -> tuple[int, str, list[tuple[int, str | None]]]:
    """(cost, audit, repaired) of a pattern: one letter a row, s u a o by the initial (o: any other), capital if truncated, x if
    the row must go. ``repaired`` lists (row or -1, new role or None).

    The stack holds open prefixes as links to their parents. A prefix is cut if its cost and suffix bound exceed the incumbent, or
    if a prefix as good stood at its row and state before. Children go by bound, then letter, so of equal costs the
    ASCII-least audit is met first and no later tie replaces it; the search ends when the stack is empty."""
    bounds = suffix_bounds(pattern)
    n = len(pattern)
    best, found = MOST, -1
    seen: list[list[int]] = [[MOST] * 4 for _ in range(n + 1)]
    # prefixes: cost, row, state, letter, new role, parent
    nodes: list[tuple[int, int, int, str, str | None, int]] = [(0, 0, START, "", None, -1)]
    stack = [0]
    while stack:
        at = stack.pop()
        cost, row, state = nodes[at][:3]
        if cost + bounds[row][state] >= best or cost >= seen[row][state]:
            continue
        seen[row][state] = cost
        if row == n and state in (START, ASSISTANT):
            best, found = cost, at
            continue
        to = NEXT[state]
        children = [(cost + INSERT, row, to, "I", ROLE[to], at)]
        if row < n:
            kind, more = pattern[row].lower(), TRUNCATED if pattern[row].isupper() else 0
            children.append((cost + DELETE, row + 1, state, "D", None, at))
            if kind != "x":
                if (state, kind) in KEEPS:
                    children.append((cost + more, row + 1, KEEPS[state, kind], "K", None, at))
                children.append((cost + REROLE + more, row + 1, to, "R", ROLE[to], at))
        children.sort(key=lambda c: (c[0] + bounds[c[1]][c[2]], c[3]), reverse=True)
        for child in children:
            if child[0] + bounds[child[1]][child[2]] < best and child[0] < seen[child[1]][child[2]]:
                stack.append(len(nodes))
                nodes.append(child)
    audit, repaired = [], []
    while found > 0:
        _, row, _, letter, role, found = nodes[found]
        audit.append(letter)
        if letter != "D":
            repaired.append((-1 if letter == "I" else row - 1, role))
    return best, "".join(reversed(audit)), repaired[::-1]


PLACED = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            patterns = b.column("pattern").slice(i, 256)
            got = [cheapest(p) for p in patterns.to_pylist()]
            plans = [[{"at": at, "role": role} for at, role in plan] for _, _, plan in got]
            cols = [patterns, pa.array([c for c, _, _ in got], pa.int64()), pa.array([a for _, a, _ in got], pa.string()), pa.array(plans, PLACED)]
            yield pa.RecordBatch.from_arrays(cols, ["pattern", "cost", "audit", "plan"])


def filled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    return turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage by the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20: 0 drops the row, 1 empties the text,
    2 removes its sentence ends, 3 repeats the row, 4 makes the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(key) % 20
    text, role = F.col("text"), F.col("role")
    return (
        filled(turns).withColumn("code", code).where("code <> 0")
        .withColumn("times", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select(
            "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        )
    )


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role and text in order).

    Rows go by turn (null first), then role and text; rows alike in all stay repeated, and all but the first are
    duplicates. A null conv_id is a conversation of its own, null roles and texts are one space, an empty role counts
    as any other role that is not s, u or a. ``gaps`` is null where it does not fit a long. A conversation is
    one output value, so its rows meet in one task; other columns are ignored; an empty table gives no rows."""
    rows = filled(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("no")  # needs no exchange of its own
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    pair = F.concat(F.lag(_initial(F.col("role"))).over(order), _initial(F.col("role")))
    marked = (
        rows.withColumn("no", F.row_number().over(order))
        .withColumn("new_turn", ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
        .withColumn("illegal", ~pair.isin("su", "ua", "au"))
        .withColumn("again", F.row_number().over(alike) > 1)
        .withColumn("fault", F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(*ENDS), "truncated").otherwise(""))
    )
    kind = F.when(_initial(F.col("role")).isin("s", "u", "a"), _initial(F.col("role"))).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
    whole = marked.withColumn("letter", letter).groupBy("conv_id").agg(
        F.coalesce((span - F.count_if(F.col("new_turn") & F.col("turn").isNotNull())).cast("string").try_cast("long"), F.when(F.max("turn").isNull(), 0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("no", "letter", "role", "text"))).alias("held"),
    )
    whole = durable(whole.withColumn("pattern", F.array_join(F.transform("held", lambda h: h["letter"]), "")))
    solved = whole.select("pattern").distinct().mapInArrow(_solve, "pattern string, cost bigint, audit string, plan array<struct<at: int, role: string>>")
    new = F.transform(
        "plan",
        lambda p: F.struct(
            F.coalesce(p["role"], F.get(F.col("held"), p["at"])["role"]).alias("role"),
            F.when(p["at"] < 0, "").otherwise(F.get(F.col("held"), p["at"])["text"]).alias("text"),
        ),
    )
    return whole.join(solved, "pattern").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", new.alias("repaired"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    mended = repair(damaged(turns))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    joined = ids.join(mended, ids["id"].eqNullSafe(mended["conv_id"]), "left")
    zero = [F.coalesce(c, F.when(F.col("audit").isNull(), 0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256")
    )


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(letter: str, cost: str, state: str) -> str:
    return f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a}}"


_OUT = "{'c': 1000000000, 'a': '~'}"


def _row_options(state: int) -> str:
    """The cheapest suffix that begins with an edit of the row itself (SQL of the check: from the last row to the first)."""
    keeps = [f"WHEN low = '{k}' THEN {_edit('K', 'more', f'v{to}')}" for (s, k), to in KEEPS.items() if s == state]
    keep = f"CASE {' '.join(keeps)} ELSE {_OUT} END" if keeps else _OUT
    rerole = f"CASE WHEN low = 'x' THEN {_OUT} ELSE {_edit('R', f'{REROLE} + more', f'v{NEXT[state]}')} END"
    return f"{_least(_edit('D', str(DELETE), f'v{state}'), keep, rerole)} AS w{state}"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
SQL = f"""
WITH RECURSIVE {CRC_TABLE}, coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql('key')} % 20 AS code
  FROM (SELECT *, {_KEY} AS key FROM conversations), crc_table
), broken AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) FROM coded WHERE code <> 0)
), ids AS (
  SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT id, turn, role, text, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS no
  FROM broken b JOIN ids i ON b.conv_id IS NOT DISTINCT FROM i.conv_id
), marked AS (
  SELECT *, substr(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), -1, 1) AS last,
         row_number() OVER (PARTITION BY id, role, text ORDER BY no) > 1 AS again,
         lag(substr(role, 1, 1)) OVER (PARTITION BY id ORDER BY no) || substr(role, 1, 1) AS pair
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked
), ready AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS low,
         CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more
  FROM faulty
), counted AS (
  SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM ready GROUP BY id
), suffix AS (
  SELECT id, n + 1 AS no, {{'c': 0, 'a': ''}} AS v0, {{'c': {2 * INSERT}, 'a': 'II'}} AS v1, {{'c': {INSERT}, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM counted
  UNION ALL
  SELECT id, no, {_least('w0', _edit('I', str(INSERT), 'x2'))}, {_least('w1', _edit('I', str(INSERT), 'x2'))}, x2, {_least('w3', _edit('I', str(INSERT), 'w2'))}
  FROM (
    SELECT *, {_least('w2', _edit('I', str(INSERT), 'w3'))} AS x2 FROM (
      SELECT r.id, r.no, {', '.join(_row_options(s) for s in range(4))} FROM suffix s JOIN ready r ON r.id = s.id AND r.no = s.no - 1))
), solved AS (
  SELECT id, v0.c AS cost, v0.a AS audit FROM suffix WHERE no = 1
), made AS (
  SELECT id, 1 AS k, 1 AS no, 0 AS state, audit, CAST([] AS VARCHAR[]) AS lines FROM solved
  UNION ALL
  SELECT m.id, k + 1, CASE WHEN edit = 'I' THEN m.no ELSE m.no + 1 END,
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND r.low = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END, audit,
         CASE WHEN edit = 'D' THEN lines WHEN edit = 'K' THEN list_append(lines, r.role || ':' || r.text)
              ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'I' THEN '' ELSE r.text END) END
  FROM (SELECT *, substr(audit, k, 1) AS edit FROM made WHERE k <= length(audit)) m LEFT JOIN ready r ON r.id = m.id AND r.no = m.no
)
SELECT i.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))},
       coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN counted USING (id) LEFT JOIN solved s USING (id) LEFT JOIN made m ON m.id = i.id AND m.k = length(m.audit) + 1
"""

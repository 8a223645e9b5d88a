"""Conversation structure repair by a fold in Spark's higher-order functions.

Windows mark each turn's first fault (blank, duplicate, truncated).  The turns of a conversation are collected, in order, and
``aggregate()`` carries four structs of (cost, audit) through them: the cheapest edits so far that leave nothing, a system, a user or
an assistant turn last.  Of equal costs the audit that is least in ASCII wins, so ``least`` over the structs decides both.

Long conversations are split: turns are collected by ranges of ``CHUNK`` turn numbers, each range is folded from each of the four
states it may be entered in, and a second fold puts the ranges together.  Two audits of one cost that cover the same turns are never
a prefix of one another, so the least whole is made of the least parts.

Inside, an audit has letters of its own for an inserted or rewritten assistant turn (``J``, ``S`` after ``I``, ``R``), which keep
the order and tell the roles; they are folded back into ``I`` and ``R`` at the end.

Defined results: a null role or text is one space, null turns come first, rows of one turn go by role, then text, and rows without a
conversation id are one conversation with a null id; a conversation of which nothing is left has zeros, an empty audit and no
turns; an empty table gives an empty result; further columns are not looked at.  A repaired conversation is one value, so
its text must stay under 2 GB, as its digest needs it whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import table

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turn numbers of a range are those with equal bits above these (512 of them).
CHUNK_BITS = 9
BLANKS = " \t\n\x0b\f\r"
STATES = "nsua"
ITEM = "struct<cost:bigint,audit:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edited(state: Column, cost: int | Column, letter: str | Column) -> Column:
    cost, letter = (F.lit(x) if isinstance(x, (int, str)) else x for x in (cost, letter))
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def states(n: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(n.alias("n"), s.alias("s"), u.alias("u"), a.alias("a"))


def filled(x: Column) -> Column:
    """The states with turns inserted where that is cheaper; more than two in a row never are."""
    user = F.least(x["u"], *[edited(x[k], INSERT, "I") for k in "nsa"])
    return let(user, lambda u: states(x["n"], x["s"], u, F.least(x["a"], edited(u, INSERT, "J"))))


def stepped(x: Column, row: Column) -> Column:
    """The states after a row."""
    initial, stays = F.substring(row["role"], 1, 1), ~row["fault"].isin(1, 2)
    late = F.when(row["fault"] == 3, TRUNCATED).otherwise(0)
    kept = lambda states, letter, other: [F.when(stays, edited(k, late + F.when(initial == letter, 0).otherwise(REROLE), F.when(initial == letter, "K").otherwise(other))) for k in states]
    gone = lambda state: edited(state, DELETE, "D")
    system = F.when(stays & (initial == "s"), edited(x["n"], late, "K"))
    new = lambda y: states(gone(y["n"]), F.least(gone(y["s"]), system), F.least(gone(y["u"]), *kept([y["n"], y["s"], y["a"]], "u", "R")), F.least(gone(y["a"]), *kept([y["u"]], "a", "S")))
    return let(filled(x), new)


def entered(state: str) -> Column:
    start, none = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")), F.lit(None).cast(ITEM)
    return states(*[start.cast(ITEM) if k == state else none for k in STATES])


def joined(x: Column, part: Column) -> Column:
    """The states after a range of turns; a comma ends its part of the audit."""
    ways = lambda k: [F.when(x[y].isNotNull() & part[i][k].isNotNull(), F.struct((x[y]["cost"] + part[i][k]["cost"]).alias("cost"), F.concat(x[y]["audit"], part[i][k]["audit"], F.lit(",")).alias("audit"))) for i, y in enumerate(STATES)]
    return states(*[F.least(*ways(k)) for k in STATES])


def faults(turns: DataFrame, kept: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, kept, n, fault``: 1 blank, 2 duplicate, 3 truncated, 0 none; ``n`` counts equal rows of a conversation."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), (F.lit(True) if kept is None else kept).alias("kept"))
    equal = Window.partitionBy("conv_id", "kept", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("n", F.row_number().over(equal))
    return rows.withColumn("fault", F.when(bare == "", 1).when(F.col("n") > 1, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))


def illegal(initials: Column) -> Column:
    """Neighbours in a list of role initials that may not follow one another."""
    rest = F.greatest(F.size(initials) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(initials, F.lit(1), rest), F.slice(initials, F.lit(2), rest), lambda x, y: F.concat(x, y))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def ranges(rows: DataFrame) -> DataFrame:
    """``conv_id, part`` for each range of turns: its rows in order, its counts, and the states it leads to from each state."""
    row = F.when(F.col("kept"), F.struct("turn", "role", "text", "n", "fault"))
    # a conversation of which nothing is left still has ranges, with no rows
    parts = rows.groupBy("conv_id", F.shiftright("turn", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    parts = parts.withColumns({"initials": F.transform("rows", lambda r: F.substring(r["role"], 1, 1)), "known": F.array_compact(F.transform("rows", lambda r: r["turn"]))})
    count = lambda k: F.size(F.filter("rows", lambda r: r["fault"] == k)).cast("long")
    told = {
        "first": F.get("initials", F.lit(0)),
        "last": F.get("initials", F.size("initials") - 1),
        "illegal": illegal(F.col("initials")),
        "low": F.array_min("known"),
        "high": F.array_max("known"),
        "turns": F.size(F.array_distinct("known")).cast("long"),
        "blank": count(1),
        "duplicate": count(2),
        "truncated": count(3),
        "ways": F.transform(F.array(*[entered(k) for k in STATES]), lambda start: F.aggregate("rows", start, stepped)),
    }
    return parts.select("conv_id", F.struct("chunk", "rows", *[v.alias(k) for k, v in told.items()]).alias("part"))


def written(row: Column, op: Column) -> Column:
    """The turns that a row's letters leave, in order."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    user, assistant = F.lit("user"), F.lit("assistant")

    def one(letter: Column) -> Column:
        found = F.when(letter == "I", turn(user, F.lit(""))).when(letter == "J", turn(assistant, F.lit("")))
        return found if row is None else found.when(letter == "K", turn(row["role"], row["text"])).when(letter == "R", turn(user, row["text"])).when(letter == "S", turn(assistant, row["text"]))

    return F.array_compact(F.transform(F.split(op, ""), one))


def repaired(turns: DataFrame, kept: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv_id``, counts of faults, ``cost`` and ``audit`` of its cheapest repair, and its turns after it.

    ``turns`` has ``conv_id, turn, role, text``; rows that ``kept`` excludes only name their conversation.  ``repaired`` is an array
    of (role, text).
    """
    whole = ranges(faults(turns, kept)).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    total = lambda name: F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p[name])
    within = lambda name: F.transform("parts", lambda p: p[name])
    edges = F.flatten(F.transform("parts", lambda p: F.when(p["first"].isNotNull(), F.array(p["first"], p["last"])).otherwise(F.array().cast("array<string>"))))
    # the edges of the ranges alternate, so every second pair of neighbours is one of two ranges
    seams = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("edges") - 3, F.lit(0))), lambda i: F.when((i % 2 == 1), F.concat(F.get("edges", i), F.get("edges", i + 1)))), lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))
    ends = filled(F.aggregate("parts", entered("n"), lambda x, p: joined(x, p["ways"])))
    best = let(ends, lambda x: F.least(x["n"], x["a"]))
    found = whole.withColumns({"edges": edges, "best": best, "span": F.array_max(within("high")) - F.array_min(within("low")) + 1})
    letters = F.split(F.col("best")["audit"], ",")
    # the last piece, after the last comma, has what is inserted at the end
    ops = lambda k: F.regexp_extract_all(F.get(letters, k), F.lit("([IJ]*[DKRS])"), 1)
    lines = F.flatten(F.transform("parts", lambda p, k: F.flatten(F.zip_with(p["rows"], ops(k), written))))
    return found.select(
        "conv_id",
        F.coalesce(F.col("span") - total("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[total(name).alias(name) for name in ("blank", "duplicate", "truncated")],
        (total("illegal") + F.size(seams)).cast("long").alias("illegal"),
        F.col("best")["cost"].alias("cost"),
        F.translate(F.regexp_replace(F.col("best")["audit"], ",", ""), "JS", "IR").alias("audit"),
        F.concat(lines, written(None, F.get(letters, F.size(letters) - 1))).alias("repaired"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kept`` after the faults that the query plants, by the CRC of ``conv_id:turn``."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("old", ".!?", "")).otherwise(F.col("old"))
    rows = turns.select("conv_id", "turn", F.when(code == 4, "user").otherwise(given("role")).alias("role"), given("text").alias("old"), code.alias("code"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", text.alias("text"), (F.col("code") != 0).alias("kept"), times.alias("time")).drop("time")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(table(spark, sf_dir, "conversations")), F.col("kept"))
    digest = F.sha2(F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary"), 256)
    return found.withColumn("repaired_sha256", digest).drop("repaired")


def repair_sql() -> str:
    """The same result in DuckDB's SQL; a state is one string: its cost in 8 digits, its audit, a mark, its lines."""
    edit = lambda x, cost, letter, line: f"lpad(CAST(CAST(substr({x}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr(split_part({x}, chr(1), 1), 9) || '{letter}' || chr(1) || split_part({x}, chr(1), 2) || {line}"
    late = f"(CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END)"
    own = "role || ':' || text || chr(10)"
    inserted = lambda x, role: edit(x, INSERT, "I" if role == "user" else "J", f"'{role}:' || chr(10)")

    def kept(x: str, role: str, letter: str) -> str:
        keep = f"CASE WHEN c = '{role[0]}' THEN {edit(x, late, 'K', own)} ELSE {edit(x, f'{late} + {REROLE}', letter, f"'{role}:' || text || chr(10)")} END"
        return f"CASE WHEN fault NOT IN (1, 2) THEN {keep} END"

    gone = lambda x: edit(x, DELETE, "D", "''")
    users = f"least(u, {inserted('n', 'user')}, {inserted('s', 'user')}, {inserted('a', 'user')})"
    return f"""
    WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    coded AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], list_transform(range(length(name)), lambda i: CAST(ascii(substr(name, i + 1, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]))) % 20 AS code FROM given, tab),
    damage AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM coded, range(2) AS k(k) WHERE code <> 0 AND (k = 0 OR code = 3)),
    seen AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS n FROM damage),
    marked AS (SELECT *, substr(role, 1, 1) AS c, CASE WHEN bare = '' THEN 1 WHEN n > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
    placed AS MATERIALIZED (SELECT *, row_number() OVER w AS i, lag(c) OVER w AS before FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n)),
    counts AS (SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    fold AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, lpad('0', 8, '0') || chr(1) AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM ids
        UNION ALL
        SELECT conv_id, i, {gone('n')}, least({gone('s')}, CASE WHEN c = 's' AND fault NOT IN (1, 2) THEN {edit('n', late, 'K', own)} END),
            least({gone('u')}, {kept('n', 'user', 'R')}, {kept('s', 'user', 'R')}, {kept('a', 'user', 'R')}), least({gone('a')}, {kept('u', 'assistant', 'S')})
        FROM (SELECT conv_id, i, n, s, u, least(a, {inserted('u', 'assistant')}) AS a, role, text, c, fault
            FROM (SELECT f.conv_id, p.i, n, s, {users} AS u, a, role, text, p.c, fault FROM (SELECT conv_id, i AS at, n, s, u, a FROM fold) f JOIN (SELECT conv_id AS id, i, role, text, c, fault FROM placed) p ON p.id IS NOT DISTINCT FROM f.conv_id AND p.i = f.at + 1))),
    ended AS (SELECT conv_id, least(n, a, {inserted(f'({users})', 'assistant')}) AS best FROM fold JOIN (SELECT ids.conv_id AS id, coalesce(size, 0) AS size FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id) x ON x.id IS NOT DISTINCT FROM conv_id AND i = size)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(substr(best, 1, 8) AS BIGINT) AS cost, translate(substr(split_part(best, chr(1), 1), 9), 'JS', 'IR') AS audit, sha256(left(split_part(best, chr(1), 2), greatest(length(split_part(best, chr(1), 2)) - 1, 0))) AS repaired_sha256
    FROM ended e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id"""

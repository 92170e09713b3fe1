"""Operator 13, conversation structure repair: the cheapest edits that make a conversation's roles alternate, by lazy weighted determinisation.

A finished conversation has roles `(s?(ua)+)?` (system, user, assistant). Edits are arcs of a weighted automaton over its four states: keep a row,
give it another role, delete it, insert an empty one. The vector of the cheapest costs from each state to the end, less its least, is a state of a deterministic
automaton; there are few of them, and they are made when they are met and kept in a transition table. A scan of the table from a conversation's last row to its
first gives its cost. A trace against the scan follows the tight arcs, whose costs the vectors allow, and takes the least letter at each step: the audit.

Defined cases: rows are ordered by turn, nulls first, then by role and text; null roles and texts count as one space, as do null parts of what damage hashes; a role that begins with none of the
three letters can't be kept; rows with a null conv_id are one conversation; a conversation without rows costs nothing; equal rows are duplicates; an empty table gives an empty
result; other columns are ignored. A conversation's rows are sorted and streamed through one task, which holds a byte for each of them, as its digest has an order; no task holds its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.llm.common import WHITE, map_batches, saved, short_batches

#: Costs of edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# States: nothing yet, after system, after user, after assistant. Where a role leads from each; none: not allowed.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_GIVEN = {0: (2, "u"), 1: (2, "u"), 3: (2, "u"), 2: (3, "a")}  # what a row with a role of choice, or an inserted one, has to be
_FAR = 1 << 40
#: A row's symbol: a bit for each initial in this order, whether it must go, and whether it is truncated.
INITIALS = "sua"
MUST_GO, CUT = 8, 16


class Repairs:
    """The deterministic automaton, made as far as it was needed: vectors, transitions and traced steps."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps: dict[tuple[int, int, int], tuple[str, str, str, int]] = {}
        self.last = self._state(self._closed([0, _FAR, _FAR, 0]))[0]

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs where rows may be inserted first."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[_GIVEN[q][0]]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def arcs(symbol: int, q: int) -> Iterator[tuple[str, int, int, str]]:
        """Letter, cost, next state and given role of each way to take a row in state q."""
        yield "D", DELETE, q, ""
        if symbol & MUST_GO:
            return
        more = TRUNCATED if symbol & CUT else 0
        for k, initial in enumerate(INITIALS):
            if symbol >> k & 1 and q in _NEXT[initial]:
                yield "K", more, _NEXT[initial][q], ""
        to, role = _GIVEN[q]
        yield "R", REROLE + more, to, role

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row, and the cost that the vectors' normalisation took away."""
        key = (state, symbol)
        if key not in self.table:
            vector = self.vectors[state]
            self.table[key] = self._state(self._closed([min(c + vector[to] for _, c, to, _ in self.arcs(symbol, q)) for q in range(4)]))
        return self.table[key]

    def step(self, state: int, symbol: int, tight: int) -> tuple[str, str, str, int]:
        """Roles inserted before a row, the row's letter and given role, and the tight states after it; tight: those before, as bits. Symbol -1: the end."""
        key = (state, symbol, tight)
        if key not in self.steps:
            own, weight = (state, 0) if symbol < 0 else self.before(state, symbol)
            here, there = self.vectors[own], self.vectors[state]
            now, inserted = {q for q in range(4) if tight >> q & 1}, ""
            while True:
                found: dict[str, set[tuple[int, str]]] = {}
                for q in now:
                    to, role = _GIVEN[q]
                    if here[q] == INSERT + here[to]:
                        found.setdefault("I", set()).add((to, role))
                    for letter, cost, after, given in self.arcs(symbol, q) if symbol >= 0 else ():
                        if here[q] + weight == cost + there[after]:
                            found.setdefault(letter, set()).add((after, given))
                if not found:
                    letter, ways = "", set()
                    break
                letter = min(found)
                ways = found[letter]
                if letter != "I":
                    break
                inserted += min(ways)[1]
                now = {to for to, _ in ways}
            role = min((r for _, r in ways), default="")
            self.steps[key] = (inserted, letter, role, sum({1 << to for to, _ in ways}))
        return self.steps[key]

    def repair(self, symbols: bytes) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost of a conversation, and for each row and the end: roles inserted before, letter, given role."""
        if not symbols:
            return 0, [("", "", "")]
        states, cost, state = [self.last], 0, self.last
        for symbol in reversed(symbols):
            state, weight = self.before(state, symbol)
            states.append(state)
            cost += weight
        states.reverse()
        cost += self.vectors[state][0]
        tight, out = 1, []
        for symbol, after in zip(symbols, states[1:]):
            *edit, tight = self.step(after, symbol, tight)
            out.append(tuple(edit))
        out.append(self.step(self.last, -1, tight)[:3])
        return cost, out


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place, fault, symbol, new_turn and illegal of each row of rows(conv_id, turn, role, text)."""
    space = F.lit(" ")
    clean = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    placed = clean.select(
        "*", F.row_number().over(order).cast("bigint").alias("place"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
    )
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    stripped = F.regexp_replace("text", f"[{WHITE}]+$", "")
    fault = F.when(stripped == "", "blank").when(earlier, "duplicate").when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated")
    bits = F.coalesce(*(F.when(initial == c, F.lit(1 << k)) for k, c in enumerate(INITIALS)), F.lit(0))
    extra = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT).otherwise(0)
    return placed.withColumn("fault", fault).withColumn("symbol", (bits + extra).cast("int"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of batches with one conv_id each, and whether it is another than that before."""
    last: object = object()
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        at = 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[at]:
                yield at > 0 or ids[at] != last, batch.slice(at, k - at)
                at = k
        if ids:
            last = ids[-1]


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, place, inserted, letter, given and cost of the rows of marked() and of each conversation's end, whose cost is the conversation's."""

    def run(batches: Iterator[pa.RecordBatch]):
        repairs, symbols, who = Repairs(), bytearray(), None

        def told():
            cost, found = repairs.repair(bytes(symbols))
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                end = at + len(part) == len(found)
                columns = [pa.array([who] * len(part), pa.int64()), pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), *(pa.array([e[k] for e in part], pa.string()) for k in range(3)), pa.array([0] * (len(part) - 1) + [cost if end else 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "inserted", "letter", "given", "cost"])

        for new, part in _runs(batches):
            if new and symbols:
                yield from told()
                symbols.clear()
            who = part.column("conv_id")[0].as_py()
            symbols += bytes(part.column("symbol").to_pylist())
        if symbols:
            yield from told()

    sorted_rows = rows.select("conv_id", "place", "symbol").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return map_batches(sorted_rows, run, "conv_id bigint, place bigint, inserted string, letter string, given string, cost bigint")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, k, role, text of the repaired rows of marked() under edits(): k counts inserted rows before the row itself."""
    texts = rows.select("conv_id", "place", "role", "text")
    given = F.when(F.col("given") == "u", ROLES["u"]).when(F.col("given") == "a", ROLES["a"])
    inserted = F.transform(F.filter(F.split("inserted", ""), lambda c: c != ""), lambda c: F.when(c == "u", ROLES["u"]).otherwise(ROLES["a"]))
    new = found.where("inserted <> ''").select("conv_id", "place", F.posexplode(inserted).alias("k", "role"), F.lit("").alias("text"))
    # Where an edit and its row meet: one group of two rows.
    both = texts.select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("letter"), F.lit(None).cast("string").alias("given")).union(
        found.where("letter <> ''").select("conv_id", "place", F.lit(None).cast("string"), F.lit(None).cast("string"), "letter", given)
    )
    met = both.groupBy("conv_id", "place").agg(F.max("role").alias("role"), F.max("text").alias("text"), F.max("letter").alias("letter"), F.max("given").alias("given"))
    own = met.where("letter <> 'D'").select("conv_id", "place", F.lit(1 << 20).alias("k"), F.coalesce("given", "role").alias("role"), "text")
    return new.union(own)


def _digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the rows of repaired()."""

    def run(batches: Iterator[pa.RecordBatch]):
        who, digest = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([who], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "sha"])
        for new, part in _runs(batches):
            if new and digest:
                yield told()
            joined = "\n".join(f"{r}:{t}" for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist()))
            if new or not digest:
                who, digest = part.column("conv_id")[0].as_py(), hashlib.sha256(joined.encode("utf-8", "surrogatepass"))
            else:
                digest.update(b"\n" + joined.encode("utf-8", "surrogatepass"))
        if digest:
            yield told()

    return map_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "k").select("conv_id", "role", "text"), run, "conv_id bigint, sha string")


def _audits(found: DataFrame) -> DataFrame:
    """conv_id, cost and audit of edits(); the letters of a conversation's 4,000 rows are joined before a conversation's."""
    letters = F.concat(F.repeat(F.lit("I"), F.length("inserted")), "letter")
    part = F.floor(F.col("place") / 4000)
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    parts = found.select("conv_id", "place", "cost", letters.alias("letters")).groupBy("conv_id", part.alias("part")).agg(F.sum("cost").alias("cost"), ordered("place", "letters").alias("letters"))
    return parts.groupBy("conv_id").agg(F.sum("cost").alias("cost"), ordered("part", "letters").alias("audit"))


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and digest of each conversation of rows(conv_id, turn, role, text), and of those that only ids(conv_id) has."""
    short_batches(rows.sparkSession)
    known = saved(marked(rows), "marked")
    found = saved(edits(known), "edits")
    count = lambda c: F.count_if(c).cast("bigint")
    faults = known.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"),
    )
    numbers, texts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    parts = [faults, _audits(found), _digests(repaired(known, found)).withColumnRenamed("sha", "repaired_sha256")]
    if ids is not None:
        parts.append(ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    none = hashlib.sha256(b"").hexdigest()
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias(n) for n in numbers), *(F.coalesce(F.max(t), F.lit("" if t == "audit" else none)).alias(t) for t in texts)
    )


def damaged(rows: DataFrame, fold: Column | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults: by a hash of conv_id and turn a row goes, loses its text or its stops, comes twice or becomes the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20 if fold is None else fold
    known = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, ROLES["u"]).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows)


def _crc32_sql(text: str) -> str:
    """DuckDB SQL of crc32 over an ASCII string, four bits at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(str(k))
    half = lambda x: f"xor(({x}) >> 4, [{', '.join(table)}][(({x}) & 15) + 1])"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda crc, b: {half(half('xor(crc, b)'))}), 4294967295)"


def _oracle() -> str:
    """A fold over each conversation's rows that keeps the cheapest (cost, audit, rows) of each state, from the first row to the last."""
    way = lambda q, cost, letter, row="''": f"CASE WHEN v[{q + 1}] IS NULL THEN NULL ELSE {{'c': v[{q + 1}].c + {cost}, 'a': v[{q + 1}].a || '{letter}', 'r': v[{q + 1}].r || {row}}} END"
    line = lambda role: f"'{role}:' || x.t || chr(10)"
    keep = lambda q, initial: f"CASE WHEN x.i = '{initial}' AND x.f < 2 THEN {way(q, 'x.f', 'K', 'x.o || chr(58) || x.t || chr(10)')} END"
    rerole = lambda q, role: f"CASE WHEN x.f < 2 THEN {way(q, f'{REROLE} + x.f', 'R', line(role))} END"
    insert = lambda q, role: way(q, INSERT, "I", f"'{role}:' || chr(10)")
    drop = lambda q: way(q, DELETE, "D")
    some = lambda ways: f"list_sort(list_filter([{', '.join(ways)}], lambda y: y IS NOT NULL))[1]"
    step = [
        some([drop(0)]), some([drop(1), keep(0, "s")]),
        some([drop(2), *(f(q, x) for q in (0, 1, 3) for f, x in ((keep, "u"), (rerole, "user")))]), some([drop(3), keep(2, "a"), rerole(2, "assistant")]),
    ]
    own = [f"v[{k + 1}]" for k in range(4)]
    closed = [own[0], own[1], some([own[2], *(insert(q, "user") for q in (0, 1, 3))]), some([own[3], insert(2, "assistant")])]
    again = lambda inner, exprs: f"(SELECT [{', '.join(exprs)}] AS v FROM ({inner}))"
    close = lambda inner: again(again(again(inner, closed), closed), closed)
    start = "SELECT [{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}, NULL, NULL, NULL] AS v"
    white = "[\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(0, CASE WHEN how = 0 THEN 0 WHEN how = 3 THEN 2 ELSE 1 END)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
m AS (SELECT *, regexp_replace(text, '{white}+$', '') AS bare, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS was,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen FROM p),
f AS (SELECT *, CASE WHEN bare = '' THEN 2 WHEN seen > 1 THEN 3 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM m),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (was || i NOT IN ('su', 'ua', 'au')) AS illegal, list({{'o': role, 't': text, 'i': i, 'f': fault}} ORDER BY place) AS rows FROM f GROUP BY conv_id),
walk AS (SELECT conv_id, 0 AS k, rows, (SELECT v FROM {close(start)}) AS v FROM n
  UNION ALL SELECT conv_id, k + 1, rows, (SELECT v FROM {close(again("SELECT w.v, w.rows[w.k + 1] AS x", step))}) FROM walk w WHERE k < len(rows)),
e AS (SELECT conv_id, {some(["v[1]", "v[4]"])} AS b FROM walk WHERE k = len(rows)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.r, length(b.r) - 1), '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id"""


ORACLE_SQL = _oracle()

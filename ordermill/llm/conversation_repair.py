"""Cheapest repair of damaged conversations: rank-convergence parallel Viterbi.

A conversation's role initials shall read ``(s?(ua)+)?``. Its rows are edited in order: Keep (0),
Rerole to user or assistant (1), Delete (2; blank and repeated rows must go), Insert an empty
turn of user or assistant anywhere (5); a truncated row that stays adds 5. Of the cheapest edits
those whose initials are least in ASCII are taken. Four states (nothing yet, after system, after
user, after assistant) make this a Viterbi recursion over vectors of four costs-to-go.

1. Rows are placed within their conversation by one range sort (``positions``), so a conversation
   of any length spreads over many tasks, and shrink to one symbol each (role initial and fault).
   Repeats are found by the smallest place of each (conversation, role, text).
2. Chunks of CHUNK symbols run backwards side by side, the last chunk of a conversation from the true
   costs, all others from a speculative vector of zeros. A vector is kept with its minimum taken
   off, so vectors that differ by a constant are equal; the constants are added up apart.
3. Fix-up passes: a chunk whose successor begins with another vector than it assumed runs again from
   that one, beside its old run, and stops where the two are equal: from there on only the
   constant changes. Passes go on until no chunk assumes a wrong vector.
4. One stream per conversation stitches the chunks: forward through each chunk's costs it picks
   the least edit that keeps the optimum, and hashes the repaired rows as they pass. It holds one
   chunk and the audit so far. SHA-256 of a whole conversation is a sequential sum, so its
   rows do meet in one task there, one after the other, sorted by Spark and never collected.

Defined cases: a null role, text, or part of the damaged key counts as one space; the rows
without a conv_id are one conversation; null turns come first and have no part in gaps. Rows of the
same turn are ordered by role, then text. A role that begins with neither s, u nor a (an empty
one included) fits nowhere and makes a pair with its neighbours illegal; initials are
case-sensitive, a kept role stays as it is spelled. Repeated rows of the input are faults like
any other. An empty table has no conversations. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.positions import positions
from ordermill.llm.rows import stored

CHUNK = 16_384
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua"
# where an inserted or rerole turn leads from each state
NEXT = (USER, USER, ASSISTANT, USER)
Vector = tuple[int, int, int, int]
FINAL: Vector = (0, 2 * INSERT, INSERT, 0)
GUESS: Vector = (0, 0, 0, 0)
_NEVER = 1 << 40


def symbol(initial: str, fault: int) -> int:
    """One byte for a row; fault: 0 none, 1 truncated, 2 has to go."""
    role = ROLES.find(initial) if initial else -1
    return 4 * fault + (role if role >= 0 else 3)


def kept_state(state: int, role: int) -> int | None:
    """Where a kept row of this role leads, if it fits."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


class Steps:
    """Costs and choices of one row, remembered per (costs after it, symbol)."""

    def __init__(self) -> None:
        self.costs: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.choices: dict[tuple[Vector, int, int], tuple[str, int]] = {}

    @staticmethod
    def _raw(after: Vector, code: int) -> Vector:
        fault, role = divmod(code, 4)
        extra = TRUNCATED if fault == 1 else 0
        base = []
        for state in range(4):
            cost = DELETE + after[state]
            if fault < 2:
                cost = min(cost, REROLE + extra + after[NEXT[state]])
                to = kept_state(state, role)
                if to is not None:
                    cost = min(cost, extra + after[to])
            base.append(cost)
        user = min(base[USER], INSERT + base[ASSISTANT])
        assistant = min(base[ASSISTANT], INSERT + base[USER])
        return (
            min(base[START], INSERT + user),
            min(base[SYSTEM], INSERT + user),
            user,
            assistant,
        )

    def before(self, after: Vector, code: int) -> tuple[Vector, int]:
        """Costs before the row, their minimum taken off, and that minimum."""
        known = self.costs.get((after, code))
        if known is None:
            raw = self._raw(after, code)
            least = min(raw)
            known = self.costs[after, code] = (tuple(c - least for c in raw), least)
        return known

    def choice(self, after: Vector, code: int, state: int) -> tuple[str, int]:
        """Least edits through the row from a state, inserts before it included; next state."""
        known = self.choices.get((after, code, state))
        if known is None:
            raw, (fault, role) = self._raw(after, code), divmod(code, 4)
            extra = TRUNCATED if fault == 1 else 0
            edits, at = "", state
            while True:
                to = kept_state(at, role)
                if raw[at] == DELETE + after[at]:
                    edits += "D"
                    break
                if raw[at] == INSERT + raw[NEXT[at]]:
                    edits, at = edits + "I", NEXT[at]
                    continue
                if fault < 2 and to is not None and raw[at] == extra + after[to]:
                    edits, at = edits + "K", to
                    break
                edits, at = edits + "R", NEXT[at]
                break
            known = self.choices[after, code, state] = (edits, at)
        return known


def run_back(steps: Steps, codes: bytes, end: Vector) -> tuple[Vector, int]:
    """Costs before the first row, and the sum of the constants taken off."""
    total = 0
    for code in reversed(codes):
        end, least = steps.before(end, code)
        total += least
    return end, total


def fix_up(
    steps: Steps, codes: bytes, old: Vector, new: Vector, start: Vector, total: int
) -> tuple[Vector, int]:
    """Result of ``run_back`` from ``new``, given that from ``old``: it stops where both meet."""
    was = now = 0
    for code in reversed(codes):
        if old == new:
            return start, total + now - was
        old, least = steps.before(old, code)
        was += least
        new, least = steps.before(new, code)
        now += least
    return new, now


def trace(steps: Steps, codes: bytes, end: Vector, state: int) -> tuple[list[str], int]:
    """The edits of each row, and the state after the last."""
    after = []
    for code in reversed(codes):
        after.append(end)
        end = steps.before(end, code)[0]
    edits = []
    for code, costs in zip(codes, reversed(after), strict=True):
        piece, state = steps.choice(costs, code, state)
        edits.append(piece)
    return edits, state


def damage(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text of the rows that are left; crc32(``conv_id:turn``) % 20 decides."""
    blank = F.lit(" ")
    told = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    text = F.coalesce("text", blank)
    return (
        conversations.select(
            _key().alias("key"),
            F.col("turn").cast("bigint").alias("turn"),
            F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
            F.when(kind == 1, "")
            .when(kind == 2, F.translate(text, ENDINGS, ""))
            .otherwise(text)
            .alias("text"),
            kind.alias("kind"),
        )
        .filter("kind <> 0")
        .withColumn("copy", F.explode(F.expr("sequence(0, IF(kind = 3, 1, 0))")))
        .drop("kind", "copy")
    )


def _key():
    """A conversation's id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def marked(placed: DataFrame) -> DataFrame:
    """key, pos, turn, initial, blank, repeated, truncated: each row's faults."""
    text, role = F.col("text"), F.col("role")
    bare = F.rtrim(text, F.lit(BLANKS))
    size = F.octet_length(role).cast("string")
    rows = placed.select(
        "key",
        "pos",
        "turn",
        F.substring(role, 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDINGS)).alias("cut"),
        F.unhex(F.sha2(F.concat("key", F.lit("/"), size, F.lit(":"), role, text), 256)).alias("print"),
    )
    firsts = rows.groupBy("print").agg(F.min("pos").alias("first"))
    repeated = ~F.col("blank") & (F.col("pos") > F.col("first"))
    return rows.join(firsts, "print").select(
        "key",
        "pos",
        "turn",
        "initial",
        "blank",
        repeated.alias("repeated"),
        (F.col("cut") & ~F.col("blank") & ~repeated).alias("truncated"),
    )


_COUNTS = ("blank", "repeated", "truncated", "illegal", "turns")
_CHUNK_FIELDS = [
    ("key", pa.string()),
    ("chunk", pa.int64()),
    ("codes", pa.binary()),
    *((c, pa.int64()) for c in _COUNTS),
    ("first_turn", pa.int64()),
    ("last_turn", pa.int64()),
    ("first_initial", pa.string()),
    ("last_initial", pa.string()),
]
_CHUNKS = pa.schema(_CHUNK_FIELDS)
_CHUNK_TYPES = (
    "key string, chunk long, codes binary, blank long, repeated long, truncated long, "
    "illegal long, turns long, first_turn long, last_turn long, first_initial string, "
    "last_initial string"
)


def is_legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _chunk(key: str, chunk: int, rows: list[tuple]) -> tuple:
    """rows: turn, initial, blank, repeated, truncated, in order."""
    turns, initials, blank, repeated, truncated = zip(*rows, strict=True)
    known = [t for t in turns if t is not None]
    codes = bytes(
        symbol(r, 2 if b or d else int(t))
        for r, b, d, t in zip(initials, blank, repeated, truncated, strict=True)
    )
    illegal = sum(not is_legal(x, y) for x, y in zip(initials, initials[1:]))
    return (
        *(key, chunk, codes, sum(blank), sum(repeated), sum(truncated), illegal),
        len(set(known)),
        *((known[0], known[-1]) if known else (None, None)),
        *(initials[0], initials[-1]),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _build(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "pos", "turn", "initial", "blank", "repeated", "truncated")
        at, rows, out = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in names)
            for key, pos, *row in zip(*columns, strict=True):
                if at != (key, pos // size):
                    if rows:
                        out.append(_chunk(*at, rows))
                    if len(out) == 64:
                        yield _batch(out, _CHUNKS)
                        out = []
                    at, rows = (key, pos // size), []
                rows.append(row)
        if rows:
            out.append(_chunk(*at, rows))
        if out:
            yield _batch(out, _CHUNKS)

    return run


def chunks(rows: DataFrame, size: int) -> DataFrame:
    return (
        rows.withColumn("chunk", F.expr(f"pos DIV {size}"))
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "pos")
        .drop("chunk")
        .mapInArrow(_build(size), _CHUNK_TYPES)
    )


_COST_TYPES = "key string, chunk long, end array<long>, start array<long>, total long"
_COSTS = pa.schema(
    [
        ("key", pa.string()),
        ("chunk", pa.int64()),
        ("end", pa.list_(pa.int64())),
        ("start", pa.list_(pa.int64())),
        ("total", pa.int64()),
    ]
)


def _run_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, chunk, codes, end and, for another run, the run before: assumed, start, total."""
    steps = Steps()
    for batch in batches:
        out = []
        names = ("key", "chunk", "codes", "end", "assumed", "start", "total")
        columns = (batch.column(c).to_pylist() for c in names)
        for key, chunk, codes, end, assumed, start, total in zip(*columns, strict=True):
            new = tuple(end)
            if assumed is None:
                begin, total = run_back(steps, codes, new)
            else:
                begin, total = fix_up(steps, codes, tuple(assumed), new, tuple(start), total)
            out.append((key, chunk, new, begin, total))
        if out:
            yield _batch(out, _COSTS)


def _vector(values: Vector):
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def solve(cut: DataFrame) -> DataFrame:
    """key, chunk, end, start, total: true costs behind and before every chunk, constants apart."""
    none = F.lit(None).cast("array<bigint>")
    follows = cut.select("key", (F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("more"))
    costs = (
        cut.select("key", "chunk", "codes")
        .join(follows, ["key", "chunk"], "left")
        .select(
            "key",
            "chunk",
            "codes",
            F.when(F.col("more"), _vector(GUESS)).otherwise(_vector(FINAL)).alias("end"),
            none.alias("assumed"),
            none.alias("start"),
            F.lit(None).cast("bigint").alias("total"),
        )
        .mapInArrow(_run_chunks, _COST_TYPES)
    )
    costs = stored(costs, "costs")
    while True:
        behind = costs.select("key", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("true_end"))
        wrong = (
            costs.join(behind, ["key", "chunk"])
            .filter("end <> true_end")
            .select(
                "key",
                "chunk",
                F.col("true_end").alias("end"),
                F.col("end").alias("assumed"),
                "start",
                "total",
            )
        )
        again = wrong.join(cut.select("key", "chunk", "codes"), ["key", "chunk"])
        fixed = stored(again.mapInArrow(_run_chunks, _COST_TYPES), "fixed")
        if fixed.isEmpty():
            return costs
        costs = stored(costs.join(fixed, ["key", "chunk"], "left_anti").union(fixed), "costs")


_RESULT = pa.schema(
    [
        ("conv_id", pa.int64()),
        *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)


class Conversation:
    """What the stream keeps of the conversation that is passing."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.cost, self.state = 0, START
        self.audit: list[str] = []
        self.rows: Iterator[str] = iter(())
        self.digest, self.empty = sha256(), True

    def chunk(self, steps: Steps, info: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += info[c]
        if self.last_initial is not None:
            self.counts["illegal"] += not is_legal(self.last_initial, info["first_initial"])
        else:
            self.cost += info["start"][START]
        self.last_initial = info["last_initial"]
        if info["first_turn"] is not None:
            # the turn that a chunk ends with may open the next one
            self.counts["turns"] -= self.last_turn == info["first_turn"]
            if self.first_turn is None:
                self.first_turn = info["first_turn"]
            self.last_turn = info["last_turn"]
        self.cost += info["total"]
        self.before = self.state
        edits, self.state = trace(steps, info["codes"], tuple(info["end"]), self.state)
        self.audit.append("".join(edits))
        self.rows = iter(edits)

    def emit(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def turn(self) -> str:
        """The role that an inserted or rerole turn gets."""
        self.before = NEXT[self.before]
        return "assistant" if self.before == ASSISTANT else "user"

    def row(self, role: str, text: str) -> None:
        for edit in next(self.rows):
            if edit == "I":
                self.emit(self.turn(), "")
            elif edit == "R":
                self.emit(self.turn(), text)
            elif edit == "K":
                self.before = kept_state(self.before, ROLES.find(role[0]))
                self.emit(role, text)

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.before = self.state
            self.emit(self.turn(), "")
            self.audit.append("I")
            self.state = self.before
        n, gaps = self.counts, 0
        if self.first_turn is not None:
            gaps = self.last_turn - self.first_turn + 1 - n["turns"]
        faults = (n["blank"], n["repeated"], n["truncated"], n["illegal"])
        audit, digest = "".join(self.audit), self.digest.hexdigest()
        return (self.conv_id, gaps, *faults, self.cost, audit, digest)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation: its id, then for each chunk its costs and its texts."""
    steps, current, key, out = Steps(), None, None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            columns = (part.column(c).to_pylist() for c in ("key", "chunk", "conv_id", "role", "text", "info"))
            for name, chunk, conv_id, role, text, info in zip(*columns, strict=True):
                if chunk < 0:
                    if current:
                        out.append(current.result())
                    current, key = Conversation(conv_id), name
                elif name != key:
                    raise ValueError(f"rows of {name} without their conversation")
                elif info is not None:
                    current.chunk(steps, info)
                else:
                    current.row(role, text)
            if out:
                yield _batch(out, _RESULT)
                out = []
    if current:
        yield _batch([current.result()], _RESULT)


def repair(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    placed = positions(damage(conversations), "key", ["turn", "role", "text"])
    cut = chunks(marked(placed), size).checkpoint()
    stats = [name for name, _ in _CHUNK_FIELDS[2:]]
    info = cut.join(solve(cut), ["key", "chunk"]).select(
        "key", "chunk", F.struct(*stats, "end", "start", "total").alias("info")
    )
    kind = info.schema["info"].dataType
    nothing, nobody = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    number = F.col("conv_id").cast("bigint").alias("conv_id")
    heads = conversations.select(_key().alias("key"), number).distinct().select(
        "key", F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("pos"), "conv_id",
        nothing.alias("role"), nothing.alias("text"), F.lit(None).cast(kind).alias("info"),
    )
    bodies = info.select(
        "key", "chunk", F.lit(-1).cast("bigint").alias("pos"), nobody.alias("conv_id"),
        nothing.alias("role"), nothing.alias("text"), "info",
    )
    texts = placed.select(
        "key", F.expr(f"pos DIV {size}").alias("chunk"), "pos", nobody.alias("conv_id"),
        "role", "text", F.lit(None).cast(kind).alias("info"),
    )
    return (
        heads.union(bodies)
        .union(texts)
        .repartition("key")
        .sortWithinPartitions("key", "chunk", "pos")
        .mapInArrow(
            _stitch,
            "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
            "cost long, audit string, repaired_sha256 string",
        )
    )


def _plus(path: str, cost: int, edit: str) -> str:
    """SQL: a path (nine digits of cost, then edits) with one more edit."""
    return (
        f"lpad((left({path}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{edit}'"
    )


def _extra(path: str, cost: int, edit: str) -> str:
    return f"CASE WHEN cut THEN {_plus(path, cost + TRUNCATED, edit)} ELSE {_plus(path, cost, edit)} END"


def _if(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 20 AS kind
  FROM conversations
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM d)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows
), f AS (
  SELECT *, left(role, 1) AS i, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS following
  FROM placed
), r AS (
  SELECT *, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, NOT blank AND NOT again AS may
  FROM f
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' AS q, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, q, s, u, least(a, {_plus("u", INSERT, "I")}) FROM (
    SELECT conv_id, pos, q, s, a, least(u, {_plus("q", INSERT, "I")}, {_plus("s", INSERT, "I")},
      {_plus("a", INSERT, "I")}) AS u
    FROM (
      SELECT dp.conv_id, r.pos, {_plus("q", DELETE, "D")} AS q,
        least({_plus("s", DELETE, "D")}, {_if("may AND i = 's'", _extra("q", 0, "K"))}) AS s,
        least({_plus("u", DELETE, "D")},
          {", ".join(_if("may AND i = 'u'", _extra(x, 0, "K")) for x in "qsa")},
          {", ".join(_if("may", _extra(x, REROLE, "R")) for x in "qsa")}) AS u,
        least({_plus("a", DELETE, "D")}, {_if("may AND i = 'a'", _extra("u", 0, "K"))},
          {_if("may", _extra("u", REROLE, "R"))}) AS a
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1))
), best AS (
  SELECT conv_id, left(least(q, a), 9)::BIGINT AS cost, substr(least(q, a), 10) AS audit FROM dp
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), edits AS (
  SELECT conv_id, e, k, count(*) FILTER (e <> 'I') OVER w AS pos, count(*) FILTER (e <> 'D') OVER w AS nth
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS k
    FROM best WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), turns AS (
  SELECT e.conv_id, e.k, e.e, e.nth, r.role, r.text,
    max(e.nth = 1 AND e.e = 'K' AND r.i = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN r ON e.e <> 'I' AND r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos
  WHERE e.e <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - led::INT) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM turns GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (following IS NOT NULL AND i || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
)
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, b.cost, b.audit,
  sha256(coalesce(p.whole, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM b.conv_id
"""

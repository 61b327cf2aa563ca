"""Repair of the structure of conversations at least cost.

A conversation's rows, by turn (null first), then role and the SHA-256 of
role and text, are to become turns whose
roles are nothing, or perhaps a system turn and then pairs of user and assistant: the
initials match `(s?(ua)+)?`. Edits and their costs: Keep a row 0, Rerole it to user or
assistant 2, Delete it 3, Insert a user or assistant turn without text 2. A row's first
fault counts: blank (no character but white space), duplicate (role and text of an earlier
row) or truncated (its last such character is none of `.!?`). Blank and duplicate rows have
to go; a truncated row that stays costs 1 more. The audit is the string of the initials of
the cheapest edits, the least in ASCII order among equally cheap ones; the edits determine
the turns that result.

Rank-convergence parallel Viterbi. The costs from a row to the end are a vector over the
states (start, after system, after user, after assistant); a row takes the vector behind it
to the one before it. A conversation is cut into chunks of CHUNK rows. Each starts from
speculative vectors, one for each state, of which any true vector is a combination. Where
these differ by constants only, the chunk's rank has converged, and whatever follows it
changes nothing but a constant. Fix-up passes extend every other chunk by the chunks behind
it, twice as many in each pass, until its vectors differ by constants or the end is reached:
two passes for usual rows, the logarithm of the number of chunks at worst. Stitched, these
give each chunk the true vector behind it; its costs go back from there, and the least
audit is traced forwards, the state in which a chunk is entered being found by the same
passes over the traces from all four states. Costs add up over chunks, as each chunk's
vector is brought to a minimum of 0.

Rows get their places by ranges (`ranks`), first occurrences of texts are found by their
SHA-256 in a group that combines before the shuffle, and only symbols and digests go through
the passes, so a conversation with any share of all rows is spread. Texts move when the
edits are known: to their digest, then to their place, where neighbours are joined; what a
task has whole is hashed there. A conversation in several tasks is put together from one
piece for each, and as one SHA-256 has to see it whole, one task reads its pieces in order.

Nulls in any column are one space; a null conv_id stays a conversation of its own and comes
back as null. Rows with equal turns follow as said; equal rows are duplicates of
the first. Empty texts are blank; texts of any length are read whole. A conversation without
rows has an empty audit and no cost. Columns other than the four are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.ranks import ranked, row_number
from tillwise.llm.staging import Stages
from tillwise.llm.text import arrow, batch_of

CHUNK = 4096

# Costs of the edits, and what blank and truncated mean.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
SOLID = r"[^\x20\x09-\x0D]"
UNENDED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

#: States: nothing yet, after system, after user, after assistant. FOLLOWS has what a turn
#: added by hand leads to, and TURNS which initial it takes; only START may take a system.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
TURNS = "uuau"
#: The costs where no row follows.
END = (0, 2 * INSERT, INSERT, 0)
#: SPREAD[t][s] bounds by how much more it can cost to go on from state s than from t,
#: whatever follows: START can do what any state after a whole pair can, that one what SYSTEM
#: can; a turn can be added by hand; and the one system turn that only START keeps can go.
SPREAD = ((0, 7, 5, 3), (0, 0, 2, 0), (2, 2, 0, 2), (0, 4, 2, 0))

Vector = tuple[int, int, int, int]


def damaged(rows: DataFrame) -> DataFrame:
    """The check's damage by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's."""
    spoken = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    spoken = spoken.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return spoken.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def _digest() -> Column:
    """Of role and text: equal for equal ones only."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _before(role: str, state: str, after: Vector) -> Vector:
    """The costs before a row, given those behind it. `state` is - for a sound row, t for a
    truncated one, x for one that has to go."""
    if state == "x":
        return tuple(v + DELETE for v in after)
    more = CUT if state == "t" else 0
    costs = [min(v + DELETE, after[FOLLOWS[s]] + more + (0 if role == TURNS[s] else REROLE)) for s, v in enumerate(after)]
    if role == "s":
        costs[START] = min(costs[START], after[SYSTEM] + more)
    user, assistant = costs[USER], costs[ASSISTANT]
    costs[USER], costs[ASSISTANT] = min(user, assistant + INSERT), min(assistant, user + INSERT)
    costs[START], costs[SYSTEM] = min(costs[START], costs[USER] + INSERT), min(costs[SYSTEM], costs[USER] + INSERT)
    return tuple(costs)


def _levelled(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least for x in v), least


def _mapped(df: DataFrame, function, ddl: str) -> DataFrame:
    schema = arrow(ddl)
    return df.mapInArrow(lambda batches: function(schema, batches), ddl)


class Chunk:
    """Costs and traces of a chunk's rows. Levelled vectors are few, so a step is looked up
    once it has been made."""

    steps: dict[tuple[str, str, Vector], tuple[Vector, int]] = {}

    def __init__(self, roles: str, states: str, behind: Vector) -> None:
        self.roles, self.states = roles, states
        n, steps = len(roles), self.steps
        costs, self.least = [behind] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            at = roles[i], states[i], behind
            if at not in steps:
                steps[at] = _levelled(_before(*at))
            behind, self.least[i] = steps[at]
            costs[i] = behind
        self.costs = costs

    def trace(self, state: int, last: bool) -> tuple[list[str], list[str], int]:
        """For each row the edits up to and with it, and the initials of the turns they make
        (K for the row's own), then the same for what comes behind the last row; the state
        behind them."""
        edits, turns = [], []
        for i, (role, kind) in enumerate(zip(self.roles, self.states)):
            here, after, least = self.costs[i], self.costs[i + 1], self.least[i]
            edit = turn = ""
            while True:
                cost, follows = here[state] + least, FOLLOWS[state]
                if cost == after[state] + DELETE:
                    edit += "D"
                    break
                if cost == here[follows] + least + INSERT:
                    edit, turn, state = edit + "I", turn + TURNS[state], follows
                    continue
                more = CUT if kind == "t" else 0
                if role == "s" and state == START and cost == after[SYSTEM] + more:
                    edit, turn, state = edit + "K", turn + "K", SYSTEM
                elif role == TURNS[state] and cost == after[follows] + more:
                    edit, turn, state = edit + "K", turn + "K", follows
                else:
                    edit, turn, state = edit + "R", turn + TURNS[state].upper(), follows
                break
            edits.append(edit)
            turns.append(turn)
        edit = turn = ""
        while last and END[state]:
            edit, turn, state = edit + "I", turn + TURNS[state], FOLLOWS[state]
        return [*edits, edit], [*turns, turn], state


def _speculated(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's vectors from the four of SPREAD, of which any vector behind it is the
    least after adding constants: place 4 * s + t has the cost of state s from vector t."""
    for batch in batches:
        costs = []
        for roles, states in zip(batch.column("roles").to_pylist(), batch.column("states").to_pylist()):
            done = [Chunk(roles, states, behind) for behind in SPREAD]
            totals = [sum(chunk.least) for chunk in done]
            costs.append([chunk.costs[0][s] + total for s in range(4) for chunk, total in zip(done, totals)])
        yield batch_of(schema, key=batch.column("key"), chunk=batch.column("chunk"), cost=costs)


def _traced(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's state behind it for each state before it, given the vector behind it."""
    for batch in batches:
        leads = []
        for roles, states, behind in zip(*(batch.column(c).to_pylist() for c in ("roles", "states", "behind"))):
            done = Chunk(roles, states, tuple(behind))
            leads.append([done.trace(s, False)[2] for s in range(4)])
        yield batch_of(schema, key=batch.column("key"), chunk=batch.column("chunk"), leads=leads)


EDITED = """key string, chunk long, cost long, illegal long, audit string,
turns array<struct<pos: long, turns: string>>"""
PAIRS = ("su", "ua", "au")


def _edited(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each chunk: its cost, its illegal pairs, its part of the audit and the
    turns it makes. The first chunk marks the start with place -1 and the last one the end."""
    names = ("roles", "states", "behind", "entered", "chunk", "last", "first_pos", "ahead")
    for batch in batches:
        costs, illegal, audits, made = [], [], [], []
        for roles, states, behind, entered, chunk, last, first, ahead in zip(*(batch.column(c).to_pylist() for c in names)):
            done = Chunk(roles, states, tuple(behind))
            edits, turns, _ = done.trace(entered, last)
            costs.append(sum(done.least) + (done.costs[0][START] if chunk == 0 else 0))
            told = ahead + roles
            illegal.append(sum(told[i : i + 2] not in PAIRS for i in range(len(told) - 1)))
            audits.append("".join(edits))
            rows = [{"pos": -1, "turns": ""}] if chunk == 0 else []
            rows += [{"pos": first + i, "turns": turn} for i, turn in enumerate(turns[:-1]) if turn]
            if last:
                rows.append({"pos": first + len(roles), "turns": turns[-1]})
            made.append(rows)
        yield batch_of(schema, key=batch.column("key"), chunk=batch.column("chunk"), cost=costs, illegal=illegal, audit=audits, turns=made)


def _chunks(placed: DataFrame, chunk: int) -> DataFrame:
    """A row for each `chunk` rows, with their symbols in order."""
    row = "struct(pos, role, state)"
    rows = placed.groupBy("key", F.expr(f"pos div {chunk}").alias("chunk"), "n").agg(F.expr(f"array_sort(collect_list({row}))").alias("rows"))
    rows = rows.selectExpr(
        "key",
        "chunk",
        f"chunk * {chunk} AS first_pos",
        f"(chunk + 1) * {chunk} >= n AS last",
        "array_join(transform(rows, r -> r.role), '') AS roles",
        "array_join(transform(rows, r -> r.state), '') AS states",
    )
    return rows


def _stitched(stages: Stages, chunks: DataFrame) -> DataFrame:
    """The chunks of conversations that have several, with the levelled vector behind each
    and the state in which it is entered, by fix-up passes over their speculative vectors."""
    several = chunks.where("NOT (last AND chunk = 0)").select("key", "chunk", "last", "roles", "states")
    guessed = _mapped(several.drop("last"), _speculated, "key string, chunk long, cost array<long>")
    guessed = guessed.join(several.select("key", "chunk", "last"), ["key", "chunk"])
    # a row's vectors reach from `chunk` up to `next`, null once the end is behind it
    known = guessed.selectExpr("key", "chunk", "CASE WHEN NOT last THEN chunk + 1 END AS next", "cost")
    across = "transform(sequence(0, 3), s -> {})"
    differ = " OR ".join(f"cost[{4 * s + t}] - cost[{4 * s}] <> cost[{t}] - cost[0]" for s in (1, 2, 3) for t in (1, 2, 3))
    known = stages.write(known.withColumn("open", F.expr(f"next IS NOT NULL AND ({differ})")), "vectors-0")
    passes = 0
    while known.where("open").limit(1).count():
        passes += 1
        behind = known.selectExpr("key", "chunk AS next", "next AS further", "cost AS more", "open AS still")
        grown = known.where("open").join(behind, ["key", "next"])
        cells = [f"least({', '.join(f'cost[{4 * s + k}] + more[{4 * k + t}]' for k in range(4))})" for s in range(4) for t in range(4)]
        grown = grown.selectExpr("key", "chunk", "further AS next", f"array({', '.join(cells)}) AS cost", "still")
        grown = grown.selectExpr("key", "chunk", "next", "cost", f"next IS NOT NULL AND still AND ({differ}) AS open")
        known = stages.write(known.where("NOT open").unionByName(grown), f"vectors-{passes}")
    end = f"array({', '.join(f'{x}L' for x in END)})"
    before = across.format(f"array_min(transform(sequence(0, 3), t -> cost[4 * s + t] + {end}[t]))")
    before = known.selectExpr("key", "chunk - 1 AS chunk", f"{before} AS v").where("chunk >= 0")
    before = before.selectExpr("key", "chunk", "transform(v, x -> x - array_min(v)) AS behind")
    several = several.join(before, ["key", "chunk"], "left").withColumn("behind", F.coalesce("behind", F.expr(end)))
    several = stages.write(several, "behind")

    leads = _mapped(several.select("key", "chunk", "roles", "states", "behind"), _traced, "key string, chunk long, leads array<long>")
    # a row's map reaches from its first chunk, `since`, through `chunk`
    settled = "since = 0 OR array_min(leads) = array_max(leads)"
    known = stages.write(leads.selectExpr("key", "chunk", "chunk AS since", "leads", f"NOT ({settled.replace('since', 'chunk')}) AS open"), "leads-0")
    passes = 0
    while known.where("open").limit(1).count():
        passes += 1
        ahead = known.selectExpr("key", "chunk + 1 AS since", "since AS earlier", "leads AS first", "open AS still")
        grown = known.where("open").join(ahead, ["key", "since"])
        grown = grown.selectExpr("key", "chunk", "earlier AS since", "transform(first, s -> leads[int(s)]) AS leads", "still")
        grown = grown.selectExpr("key", "chunk", "since", "leads", f"still AND NOT ({settled}) AS open")
        known = stages.write(known.where("NOT open").unionByName(grown), f"leads-{passes}")
    entered = known.selectExpr("key", "chunk + 1 AS chunk", f"leads[{START}] AS entered")
    return several.join(entered, ["key", "chunk"], "left").select("key", "chunk", "behind", F.coalesce("entered", F.lit(START)).alias("entered"))


PIECES = "key string, pos long, start boolean, end boolean, sha string, text string"


def _pieced(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one conversation that follow each other in a task as one piece; its hash in
    place of the text where both the start and the end are among them."""
    out: dict[str, list] = {name: [] for name in schema.names}

    def put(key: str, pos: int, start: bool, end: bool, lines: list[str]) -> None:
        text = "\n".join(lines) if lines else None
        whole = start and end
        sha = hashlib.sha256((text or "").encode()).hexdigest() if whole else None
        for name, value in zip(schema.names, (key, pos, start, end, sha, None if whole else text)):
            out[name].append(value)

    def flushed() -> pa.RecordBatch:
        done = batch_of(schema, **out)
        for values in out.values():
            values.clear()
        return done

    key, pos, start, end, lines = None, 0, False, False, []
    for batch in batches:
        for k, p, opens, closes, line in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "start", "end", "line"))):
            if k != key:
                if key is not None:
                    put(key, pos, start, end, lines)
                key, pos, start, end, lines = k, p, False, False, []
            start, end = start or opens, end or closes
            if line is not None:
                lines.append(line)
        if out["key"]:
            yield flushed()
    if key is not None:
        put(key, pos, start, end, lines)
        yield flushed()


def _hashed(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each conversation, over its pieces, which come in order."""
    key, state, any_text = None, None, False
    for batch in batches:
        keys, shas = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state, any_text = k, hashlib.sha256(), False
            if text is not None:
                state.update((("\n" if any_text else "") + text).encode())
                any_text = True
        if keys:
            yield batch_of(schema, key=keys, repaired_sha256=shas)
    if key is not None:
        yield batch_of(schema, key=[key], repaired_sha256=[state.hexdigest()])


def _lines(made: DataFrame, spoken: DataFrame) -> DataFrame:
    """The lines of each place: `role:text` of the turns made there."""
    texts = spoken.groupBy("key", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    line = """array_join(transform(filter(split(turns, ''), c -> c <> ''), c -> CASE c
        WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' WHEN 'U' THEN concat('user:', text)
        WHEN 'A' THEN concat('assistant:', text) ELSE concat(role, ':', text) END), '\\n')"""
    marked = ["key", "pos", "pos = -1 AS start", "pos >= 0 AND digest IS NULL AS end"]
    kept = made.where("digest IS NOT NULL").join(texts, ["key", "digest"])
    bare = made.where("digest IS NULL").selectExpr("*", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS text")
    return kept.unionByName(bare).selectExpr(*marked, f"CASE WHEN turns <> '' THEN {line} END AS line")


class Repair:
    """Cheapest repairs of the conversations in rows(conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK) -> None:
        self.rows = rows
        self.stages = stages = Stages(rows.sparkSession, "conversations")
        self.spoken = rows.select(_key(F.col("conv_id")).alias("key"), "turn", "role", "text").withColumn("digest", _digest())
        symbols = self.spoken.select(
            "key",
            "turn",
            F.substring("role", 1, 1).alias("role"),
            F.when(~F.col("text").rlike(SOLID), "b").when(F.col("text").rlike(UNENDED), "t").otherwise("-").alias("state"),
            F.col("role").alias("by_role"),
            "digest",
        )
        placed = ranked(stages, "rows", row_number(symbols), "key", ["turn", "by_role", "digest", "row"])
        placed = stages.write(placed.drop("by_role", "row"), "placed")
        firsts = placed.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("fresh"))
        said = placed.join(firsts, ["key", "pos"], "left").withColumn(
            "fault", F.expr("CASE WHEN state = 'b' THEN 'b' WHEN fresh IS NULL THEN 'd' WHEN state = 't' THEN 't' END")
        )
        said = said.drop("state", "fresh")
        self.said = said = stages.write(said, "said")
        known = said.withColumn("role", F.when(F.col("role").isin("s", "u", "a"), F.col("role")).otherwise("?"))
        known = known.withColumn("state", F.expr("CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE coalesce(fault, '-') END"))
        chunks = stages.write(_chunks(known, chunk), "chunks")
        stitched = _stitched(stages, chunks)
        ahead = chunks.select("key", (F.col("chunk") + 1).alias("chunk"), F.expr("right(roles, 1)").alias("ahead"))
        end = F.array(*(F.lit(x).cast("long") for x in END))
        ready = chunks.join(stitched, ["key", "chunk"], "left").join(ahead, ["key", "chunk"], "left").withColumns(
            {"behind": F.coalesce("behind", end), "entered": F.coalesce("entered", F.lit(START)), "ahead": F.coalesce("ahead", F.lit(""))}
        )
        ready = ready.select("key", "chunk", "first_pos", "last", "roles", "states", "behind", "entered", "ahead")
        self.chunks = stages.write(_mapped(ready, _edited, EDITED), "edited")

    def turns(self) -> DataFrame:
        """The repaired conversations: key, pos, start, end, line, the lines of a place in
        one; places without lines mark a conversation's start and end."""
        made = self.chunks.select("key", F.explode("turns").alias("t")).select("key", "t.*")
        made = made.join(self.said.select("key", "pos", "digest"), ["key", "pos"], "left")
        return _lines(made, self.spoken)

    def hashes(self) -> DataFrame:
        laid = self.turns().repartitionByRange("key", "pos").sortWithinPartitions("key", "pos")
        pieces = self.stages.write(_mapped(laid, _pieced, PIECES), "pieces")
        parts = pieces.where("sha IS NULL").repartition("key").sortWithinPartitions("key", "pos").select("key", "text")
        split = _mapped(parts, _hashed, "key string, repaired_sha256 string")
        return pieces.where("sha IS NOT NULL").selectExpr("key", "sha AS repaired_sha256").unionByName(split)

    def report(self, conv_ids: DataFrame) -> DataFrame:
        """A row for each conversation of conv_ids(conv_id), also where it has no rows."""
        faults = self.said.groupBy("key").agg(
            F.count(F.when(F.col("fault") == "b", 1)).alias("blank"),
            F.count(F.when(F.col("fault") == "d", 1)).alias("duplicate"),
            F.count(F.when(F.col("fault") == "t", 1)).alias("truncated"),
            F.expr("coalesce(max(turn) - min(turn) + 1, 0)").alias("span"),
        )
        turns = self.said.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("held"))
        costs = self.chunks.groupBy("key").agg(
            F.sum("cost").alias("cost"),
            F.sum("illegal").alias("illegal"),
            F.expr("array_join(transform(array_sort(collect_list(struct(chunk, audit))), x -> x.audit), '')").alias("audit"),
        )
        out = conv_ids.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
        for part in (faults, turns, costs, self.hashes()):
            out = out.join(part, "key", "left")
        zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
        return out.select(
            "conv_id",
            (F.coalesce("span", F.lit(0)) - F.coalesce("held", F.lit(0))).cast("long").alias("gaps"),
            *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )


def repaired(rows: DataFrame, damage=damaged, chunk: int = CHUNK) -> DataFrame:
    """What repairing the damaged rows takes, for each conversation of `rows`."""
    return Repair(damage(rows), chunk).report(rows)

"""Conversation structure repair on a suffix-shared automaton of signatures.

A row's signature is its role's initial (s, u, a or another) and its first fault:
blank (no visible character), duplicate (role and text seen earlier in the
conversation), truncated (last visible character is none of ``.!?``) or none.
Edits are Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate
rows have to go) and Insert of an empty user or assistant row anywhere (5); a
truncated row that stays adds 5.  The repaired roles read ``(s?(ua)+)?``.  Of the
cheapest edits those whose initials are least in ASCII order are taken.

The rows are ranged by conversation and turn, so a conversation of any size spreads
over many tasks, and cut into words of at most ``word_rows`` signatures.  The
distinct words of all conversations are sorted from their ends: words with a common
suffix share its nodes, and each node is worked out once.  For each state of the
grammar (start, after s, after u, after a) a node holds the cost to go, the first
edits of the best audit suffix with a link to the next node's state, and the rank of that
suffix among the states.  Words that do not end their conversation hold this for each
state that they may end in; a conversation of several words is then put together by one
pass over its words, with four back links a word.

Words held by more than one in ``HOT`` of all rows (fewer than ``HOT`` of them) are joined by
broadcast, so a shape that a third of all conversations have does not meet in one task.

Edge cases: a null role, text, conversation or turn counts as one blank where its
characters are asked for; null turns come first; rows of equal turns are ordered by a
hash of role and text, copies of a row are duplicates.  A null conversation is one
of its own.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codesieve.llm import common as C

ROLES = "suax"
FAULTS = ("none", "blank", "duplicate", "truncated")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"  # role * 4 + fault, from A
GONE = "-"  # a row that has to be deleted, whatever its role
START, S, U, A = range(4)
STATES = 4
STEP = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
INSERT = {START: U, S: U, U: A, A: U}
INFINITE = 1 << 60
HOT = 200
VISIBLE = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*+\z"


def _options(symbol: str) -> list[list[tuple[int, str, int]]]:
    """By state: (cost, edits, next state) of the best edits of one row, inserts before it
    included.  Two inserts lead back, so no more are tried."""
    out = []
    role, fault = ("", DUPLICATE) if symbol == GONE else (ROLES[LETTERS.index(symbol) // 4], LETTERS.index(symbol) % 4)
    for state in range(STATES):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for n in range(3):
            more, before = 5 * n, "I" * n
            ways = [(more + 2, before + "D", at)]
            if symbol != GONE:
                stays = more + (5 if fault == TRUNCATED else 0)
                if (role, at) in STEP:
                    ways.append((stays, before + "K", STEP[role, at]))
                ways += [(stays + 1, before + "R", STEP[r, at]) for r in "ua" if (r, at) in STEP]
            for cost, edits, then in ways:
                if then not in best or (cost, edits) < best[then]:
                    best[then] = cost, edits
            at = INSERT[at]
        out.append([(cost, edits, then) for then, (cost, edits) in best.items()])
    return out


OPTIONS = {x: _options(x) for x in LETTERS + GONE}


class Node:
    """One suffix: by (state, target) its cost, best first edits, next state and rank."""

    __slots__ = ("cost", "edits", "then", "rank")

    def __init__(self, cost, edits, then, rank):
        self.cost, self.edits, self.then, self.rank = cost, edits, then, rank


def end_node(last: bool) -> Node:
    """The empty suffix: the end of the conversation, or any state as the target."""
    if last:
        return Node([0, 10, 5, 0], ["", "II", "I", ""], [0] * STATES, [0, 2, 1, 0])
    return Node([0 if q == f else INFINITE for q in range(STATES) for f in range(STATES)], [""] * 16, [0] * 16, [0] * 16)


def before(symbol: str, node: Node, targets: int) -> Node:
    """The node of the suffix that ``symbol`` and ``node``'s suffix make."""
    cost, edits, then, keys = [], [], [], []
    for options in OPTIONS[symbol]:
        for f in range(targets):
            best = min((c + node.cost[q * targets + f], e, node.rank[q * targets + f], q) for c, e, q in options)
            cost.append(min(best[0], INFINITE))
            edits.append(best[1])
            then.append(best[3])
            keys.append(best[1:3])
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return Node(cost, edits, then, [place[k] for k in keys])


def walked(words):
    """(word, node of the whole word, audits) of words that come sorted from
    their ends; nodes of a suffix shared with the word before are used again."""
    for last in (True, False):
        path, known = [end_node(last)], ""
        targets = 1 if last else STATES
        for word in (w for w, is_last in words if is_last == last):
            shared = 0
            while shared < min(len(word), len(known)) and word[-1 - shared] == known[-1 - shared]:
                shared += 1
            del path[shared + 1:]
            for at in range(len(word) - shared - 1, -1, -1):
                path.append(before(word[at], path[-1], targets))
            known = word
            audits = []
            for q in range(STATES):
                for f in range(targets):
                    if path[-1].cost[q * targets + f] >= INFINITE:
                        audits.append(None)
                        continue
                    parts, state = [], q
                    for node in reversed(path):
                        parts.append(node.edits[state * targets + f])
                        state = node.then[state * targets + f]
                    audits.append("".join(parts))
            yield word, last, path[-1], audits


def _values(words: DataFrame) -> DataFrame:
    """(sig, last, cost, rank, audit) of each distinct word."""
    def run(batches):
        rows = []

        def listed():
            for b in C.frames(batches):
                yield from zip(b["sig"], b["last"], strict=True)

        held = list(listed())  # the words of one range, at most ``word_rows`` characters each
        for word, last, node, audits in walked(held):
            rows.append((word, last, node.cost, node.rank, audits))
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=["sig", "last", "cost", "rank", "audit"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["sig", "last", "cost", "rank", "audit"])

    width = C.shuffle_width(words.sparkSession)
    ranged = words.select("sig", "last").withColumn("from_end", F.reverse("sig")).repartitionByRange(width, "from_end", "last")
    return ranged.sortWithinPartitions("from_end").drop("from_end").mapInPandas(
        run, "sig string, last boolean, cost array<long>, rank array<int>, audit array<string>")


RECORD = ("conv string, part int, no int, spans boolean, last boolean, word string, h1 array<long>, h2 array<long>, "
          "first_turn long, last_turn long, n_turns long")


def _words(facts: DataFrame, word_rows: int) -> DataFrame:
    """Records of at most ``word_rows`` rows in order.  The first and the last conversation of a range
    may go on in others: they are marked, and know only their own duplicates."""
    def run(batches):
        part, out = TaskContext.get().partitionId(), []

        def records(conv, run_, spans):
            word, h1, h2, turns = run_
            ends = -(-len(word) // word_rows)
            for no in range(ends):
                own = slice(no * word_rows, (no + 1) * word_rows)
                known = [t for t in turns[own] if t is not None]
                out.append((conv, part, no, spans, no == ends - 1, "".join(word[own]), list(h1[own]), list(h2[own]),
                            known[0] if known else None, known[-1] if known else None, len(set(known))))

        now, held, seen, first = None, None, set(), True
        for b in C.frames(batches):
            turns = [None if pd.isna(t) else int(t) for t in b["turn"]]
            for conv, turn, role, fault, h1, h2 in zip(b["conv"], turns, b["role"], b["fault"], b["h1"], b["h2"], strict=True):
                if conv != now:
                    if held:
                        records(now, held, first)
                        first = False
                    now, held, seen = conv, ([], array("q"), array("q"), []), set()
                if fault != BLANK:
                    if (h1, h2) in seen:
                        fault = DUPLICATE
                    seen.add((h1, h2))
                held[0].append(LETTERS[4 * role + fault])
                held[1].append(h1)
                held[2].append(h2)
                held[3].append(turn)
            if len(out) >= 1024:
                yield _records(out)
                out.clear()
        if held:
            records(now, held, True)
        if out:
            yield _records(out)

    width = C.shuffle_width(facts.sparkSession)
    keys = ["conv", "turn", "h1", "h2", "salt"]  # the salt divides copies of one row
    ranged = facts.withColumn("salt", F.rand(13)).repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    return C.cut(ranged.drop("salt").mapInPandas(run, RECORD))


def _records(rows: list) -> pd.DataFrame:
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return pd.DataFrame(rows, columns=names, dtype=object)


@F.pandas_udf(StringType())
def _marked(word: pd.Series, places: pd.Series) -> pd.Series:
    """Words whose rows at ``places`` are duplicates of rows in an earlier range."""
    out = []
    for w, own in zip(word, places, strict=True):
        letters = list(w)
        for at in own if own is not None else ():
            letters[at] = LETTERS[LETTERS.index(letters[at]) // 4 * 4 + DUPLICATE]
        out.append("".join(letters))
    return pd.Series(out, dtype=object)


def _across_ranges(records: DataFrame) -> DataFrame:
    """The records with duplicates known across ranges, and which of them end a conversation."""
    inner = records.where("not spans").withColumn("only", F.col("last") & (F.col("no") == 0))
    open_ = records.where("spans")
    keys = open_.select("conv", "part", "no", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h"), "word").where(
        ~F.substring("word", F.col("at") + 1, F.lit(1)).isin(*[x for i, x in enumerate(LETTERS) if i % 4 in (BLANK, DUPLICATE)])) \
        .select("conv", "part", "no", "at", "h.h1", "h.h2")
    firsts = keys.groupBy("conv", "h1", "h2").agg(F.min("part").alias("first_part"), F.count("*").alias("c")).where("c > 1").drop("c")
    marks = keys.join(firsts, ["conv", "h1", "h2"]).where("part > first_part").groupBy("conv", "part", "no").agg(F.collect_list("at").alias("places"))
    # No more than two conversations a range are open: their ends fit every task.
    ends = open_.groupBy("conv").agg(F.max(F.struct("part", "no")).alias("end"), F.count("*").alias("n"))
    fixed = open_.join(marks, ["conv", "part", "no"], "left").join(F.broadcast(ends), "conv")
    fixed = fixed.withColumn("word", F.when(F.col("places").isNull(), F.col("word")).otherwise(_marked("word", "places")))
    fixed = fixed.withColumn("last", F.struct("part", "no") == F.col("end")).withColumn("only", F.col("n") == 1)
    return inner.unionByName(fixed.select(inner.columns))


def _kind(fault: int) -> Column:
    """How many letters of the word stand for a fault."""
    others = "".join(x for i, x in enumerate(LETTERS) if i % 4 != fault)
    return F.length(F.translate("word", others, "")).cast("long")


def _described(records: DataFrame) -> DataFrame:
    """The records with their signature word and what they add to the summary."""
    roles = F.translate("word", LETTERS, "".join(r * 4 for r in ROLES))
    gone = "".join(x for i, x in enumerate(LETTERS) if i % 4 in (BLANK, DUPLICATE))
    return records.withColumns({
        "sig": F.translate("word", gone, GONE * len(gone)), "blank": _kind(BLANK), "duplicate": _kind(DUPLICATE), "truncated": _kind(TRUNCATED),
        "illegal": (F.length("word") - 1 - F.regexp_count(roles, F.lit("(?=su|ua|au)"))).cast("long"),
        "first_role": F.substring(roles, 1, 1), "last_role": F.substring(roles, F.length("word"), F.lit(1))})


def _valued(records: DataFrame, own: list[str]) -> DataFrame:
    """The records with ``own`` columns of their word's values."""
    counts = C.cut(records.groupBy("sig", "last").agg(F.count("*").alias("c")))
    values = C.cut(_values(counts).join(counts, ["sig", "last"]))
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = values.where(F.col("c") * HOT > total).select("sig", "last", *own)
    cold = values.where(F.col("c") * HOT <= total).select("sig", "last", *own)
    by_hand = records.join(F.broadcast(hot), ["sig", "last"])
    rest = records.join(F.broadcast(hot.select("sig", "last")), ["sig", "last"], "left_anti").join(cold, ["sig", "last"])
    return by_hand.unionByName(rest)


SUMMARY = ("blank", "duplicate", "truncated", "illegal")
CHAINED = ("conv string, part int, no int, state int, target int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _chained(words: DataFrame) -> DataFrame:
    """Conversations of several words: (state, target) of each word, and a
    summary row (``part`` null) of each conversation."""
    def run(batches):
        names = [x.split(" ")[0] for x in CHAINED.split(", ")]
        out, now, held = [], None, None

        def closed():
            n, target, picks = len(held["places"]), None, []
            for k in range(n - 1, -1, -1):
                if k == n - 1:
                    state, target = held["back"][4 * k], -1
                else:
                    state, target = held["back"][4 * k + picks[-1][2]], picks[-1][2]
                picks.append((*held["places"][k], state, target))
            gaps = held["max"] - held["min"] + 1 - held["turns"] if held["turns"] else 0
            out.extend((now, p, no, q, f, None, None, None, None, None, None) for p, no, q, f in picks)
            out.append((now, None, None, None, None, gaps, *(held[x] for x in SUMMARY), held["cost"]))

        for b in C.frames(batches):
            for r in b.to_dict("records"):
                if r["conv"] != now:
                    if held:
                        closed()
                    now = r["conv"]
                    held = {"places": [], "back": bytearray(), "costs": [0, INFINITE, INFINITE, INFINITE], "rank": [0] * STATES, "cost": 0,
                            "min": None, "max": None, "turns": 0, "role": None, **dict.fromkeys(SUMMARY, 0)}
                held["places"].append((r["part"], r["no"]))
                for x in SUMMARY:
                    held[x] += r[x]
                if held["role"]:
                    held["illegal"] += held["role"] + r["first_role"] not in ("su", "ua", "au")
                held["role"] = r["last_role"]
                if r["n_turns"]:
                    held["turns"] += r["n_turns"] - (held["max"] == r["first_turn"])
                    held["min"] = r["first_turn"] if held["min"] is None else held["min"]
                    held["max"] = r["last_turn"]
                costs, ranks, targets = held["costs"], held["rank"], 1 if r["last"] else STATES
                best = [min((costs[q] + int(r["cost"][q * targets + f]), ranks[q], int(r["rank"][q * targets + f]), q) for q in range(STATES))
                        for f in range(targets)]
                held["back"] += bytes(x[3] for x in best) + b"\0" * (4 - targets)
                if r["last"]:
                    held["cost"] = best[0][0]
                else:
                    held["costs"] = [min(x[0], INFINITE) for x in best]
                    place = {k: i for i, k in enumerate(sorted({x[1:3] for x in best}))}
                    held["rank"] = [place[x[1:3]] for x in best]
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out.clear()
        if held:
            closed()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    columns = ["conv", "part", "no", "last", "cost", "rank", *SUMMARY, "first_role", "last_role", "first_turn", "last_turn", "n_turns"]
    sound = words.select(*columns).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_turn", "last_turn")})
    return sound.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInPandas(run, CHAINED)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage: by ``crc32(conv_id:turn) % 20`` a row is dropped (0), emptied (1), loses
    its ``.!?`` (2), stands twice (3) or becomes the user's (4); nulls count as one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    text = F.when(by == 1, "").when(by == 2, F.translate(words("text"), ".!?", "")).otherwise(words("text"))
    return conversations.where(by != 0).select(
        "conv_id", "turn", F.when(by == 4, "user").otherwise(words("role")).alias("role"), text.alias("text"),
        F.explode(F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


class Repair:
    """``summary``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows;
    ``rows``: conv, part, no, at (their order), role, text of the repaired conversations."""

    def __init__(self, summary: DataFrame, rows: DataFrame):
        self.summary, self.rows = summary, rows


def key_of(conv: Column) -> Column:
    """A conversation's id as a string, empty for null."""
    return F.coalesce(conv.cast("string"), F.lit(""))


def repair(rows: DataFrame, word_rows: int = 1024, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """The cheapest repair of every conversation in ``rows``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    texts = rows.select(key_of(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"),
                        blank(text_col).alias("text")).withColumns({f"h{n}": F.xxhash64(F.lit(n), "role", "text") for n in (1, 2)})
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(~F.col("text").rlike(WHOLE), TRUNCATED).otherwise(NONE)
    facts = texts.select("conv", "turn", "h1", "h2", F.when(initial.isin(*"sua"), F.position(initial, F.lit("sua")) - 1).otherwise(3).alias("role"),
                         fault.alias("fault"))
    records = C.cut(_described(_across_ranges(_words(facts, word_rows))))
    valued = C.cut(_valued(records, ["cost", "rank", "audit"]))
    chain = C.cut(_chained(valued.where("not only")))
    pick = F.when(F.col("target") < 0, F.col("state")).otherwise(F.col("state") * STATES + F.col("target"))
    of_many = valued.where("not only").join(chain.where("part is not null").select("conv", "part", "no", "state", "target"),
                                            ["conv", "part", "no"]).withColumn("own", F.get("audit", pick))
    of_one = valued.where("only").withColumn("own", F.get("audit", F.lit(0))).withColumn("state", F.lit(START))
    gaps = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(F.lit(0).cast("long"))
    counts = ["conv", "gaps", *SUMMARY, "cost", "audit"]
    joined = of_many.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "own"))),
                                                                 lambda x: x["own"]), "").alias("audit"))
    summary = of_one.withColumn("gaps", gaps).withColumn("cost", F.get("cost", F.lit(0))).withColumn("audit", F.col("own")).select(counts).unionByName(
        chain.where("part is null").select("conv", "gaps", *SUMMARY, "cost").join(joined, "conv").select(counts))

    edits = _edits(of_one.select("conv", "part", "no", "own", "word", "h1", "h2", "state").unionByName(
        of_many.select("conv", "part", "no", "own", "word", "h1", "h2", "state")))
    stays = edits.where("h1 is not null")
    known = texts.where(F.col("text").rlike(VISIBLE)).dropDuplicates(["conv", "h1", "h2"]).select("conv", "h1", "h2", F.col("role").alias("old_role"), "text")
    kept = stays.join(known, ["conv", "h1", "h2"]).select("conv", "part", "no", "at", F.coalesce("role", "old_role").alias("role"), "text")
    made = edits.where("h1 is null").select("conv", "part", "no", "at", "role", F.lit("").alias("text"))
    return Repair(summary, kept.unionByName(made))


def _edits(words: DataFrame) -> DataFrame:
    """(conv, part, no, at, role, h1, h2) of each row that the repair leaves: ``role`` is null where the old one
    stays, ``h1`` where the row is inserted."""
    def run(batches):
        names = ["conv", "part", "no", "at", "role", "h1", "h2"]
        for b in C.frames(batches):
            out = []
            for conv, part, no, audit, word, h1, h2, state in zip(*(b[c] for c in ("conv", "part", "no", "own", "word", "h1", "h2", "state")), strict=True):
                at, state = 0, int(state)
                for place, edit in enumerate(audit):
                    if edit == "D":
                        at += 1
                    elif edit == "I":
                        state = INSERT[state]
                        out.append((conv, part, no, place, "user" if state == U else "assistant", None, None))
                    else:
                        if edit == "K":
                            state, role = STEP[ROLES[LETTERS.index(word[at]) // 4], state], None
                        else:
                            state = INSERT[state]
                            role = "user" if state == U else "assistant"
                        out.append((conv, part, no, place, role, int(h1[at]), int(h2[at])))
                        at += 1
            yield pd.DataFrame(out, columns=names, dtype=object)

    return words.mapInPandas(run, "conv string, part int, no int, at int, role string, h1 long, h2 long")


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash of each conversation's ``role:text`` lines, taken
    row by row in order, so that a conversation of any size needs a fixed space."""
    def run(batches):
        now, running, out = None, None, []
        for b in C.frames(batches):
            for conv, role, text in zip(b["conv"], b["role"], b["text"], strict=True):
                if conv != now:
                    if running:
                        out.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
                out = []
        if running:
            out.append((now, running.hexdigest()))
        if out:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])

    return rows.repartition("conv").sortWithinPartitions("conv", "part", "no", "at").mapInPandas(run, "conv string, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the undamaged table: summary and hash of its damaged rows' repair."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", key_of(F.col("conv_id")))
    done = repair(damaged(conversations))
    zero = F.lit(0).cast("long")
    return ids.join(done.summary, "conv", "left").join(digests(done.rows), "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *SUMMARY, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

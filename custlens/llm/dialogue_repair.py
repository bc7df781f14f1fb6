"""Conversation structure repair by generalised LR parsing.

The roles of a conversation, as initials, must read ``(s?(ua)+)?``.  An SLR table is
built from the grammar below; the parser keeps a graph-structured stack, in which a
node is an LR state on a parent node and is made once, so that stacks share their
tails.  Every row may be kept, reroled or deleted and empty rows may be inserted;
each way costs.  Where two ways lead to the same stack top, the smaller
(cost, audit) stays.

The grammar is left-recursive, so only a handful of stacks exist.  What a row does to
the live stack tops depends on their relative costs, on the order of their audits
and on the row's kind alone, and is therefore looked up once it has been worked
out: a row takes constant time, and a conversation five bytes a row until its end is
known.  (Audits that reach different tops before the next row differ in a letter
both have: each holds one letter other than I for every row, the last one included.
So their order stays, whatever is appended.)

Spark does the rest: faults, order and hashes are expressions; repeats are found by
a window over (conversation, digest); narrow rows are parsed in order, streamed
through a task; the texts are streamed a second time, beside the audit, into the
digest.  A digest of a whole conversation is sequential by nature, so one task reads
a conversation's rows in order, but never holds more than one batch of them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow, partitions_for

# The grammar of role initials and the costs of edits.
GRAMMAR = [("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua")]
TERMINALS = "sua"
RIGHT = ("su", "ua", "au")
RENAMED = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A stack top that costs this much more than the cheapest is left: from any top, the rest
#: of any other's parse can be followed for 10 at most (an insertion to be in step, 3; a
#: deletion in place of the one s that may be kept, 4; an insertion at the end, 3).
SLACK = 12
#: Kinds of a row: 0 is deleted for certain; 1 + 2 * place of its initial in "?sua" + truncated.
GONE = 0
SPACE = " \t\n\x0b\f\r"


class Parser:
    """SLR(1) tables of GRAMMAR, the stack's nodes, and the memory of steps."""

    def __init__(self):
        self.rules = [("S", "C"), *GRAMMAR]
        self._tables()
        #: node -> (LR state, parent node), and back.
        self.nodes, self.number = [(0, -1)], {(0, -1): 0}
        self._near: dict[int, dict[int, int]] = {}
        self._moves: dict[tuple[int, int], dict[int, tuple[int, str]]] = {}
        #: A configuration: (node, cost above the least) in the order of the audits.
        self.configs: list[tuple[tuple[int, int], ...]] = []
        self._config_number: dict[tuple, int] = {}
        self.start = self._config(((0, 0),))
        #: (configuration, kind) -> (next one, rise of the least cost, (index before, letters) of each top)
        self.steps: dict[tuple[int, int], tuple[int, int, list[tuple[int, str]]]] = {}

    # LR tables
    def _closure(self, items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            for k, (left, _) in enumerate(self.rules):
                if dot < len(right) and left == right[dot] and (k, 0) not in out:
                    out.add((k, 0))
                    todo.append((k, 0))
        return frozenset(out)

    def _tables(self) -> None:
        first = self._closure(frozenset({(0, 0)}))
        states, self.goto = [first], {}
        for i, items in enumerate(states):
            after: dict[str, set] = {}
            for rule, dot in items:
                if dot < len(self.rules[rule][1]):
                    after.setdefault(self.rules[rule][1][dot], set()).add((rule, dot + 1))
            for symbol, kernel in after.items():
                own = self._closure(frozenset(kernel))
                if own not in states:
                    states.append(own)
                self.goto[i, symbol] = states.index(own)
        follow: dict[str, set] = {"S": {"$"}, "C": {"$"}, "P": set()}
        for _ in self.rules:
            for left, right in self.rules:
                for k, symbol in enumerate(right):
                    if symbol in follow:
                        # no part of this grammar that follows another can be empty
                        follow[symbol] |= {right[k + 1]} if k + 1 < len(right) else follow[left]
        self.reduce: dict[tuple[int, str], list[int]] = {}
        self.accept = set()
        #: States with nothing but one finished rule.
        self.sole = {i: rule for i, items in enumerate(states) if len(items) == 1 for rule, dot in items if rule and dot == len(self.rules[rule][1])}
        for i, items in enumerate(states):
            for rule, dot in items:
                left, right = self.rules[rule]
                if dot == len(right):
                    if rule == 0:
                        self.accept.add(i)
                    for symbol in follow[left] if rule else ():
                        self.reduce.setdefault((i, symbol), []).append(rule)

    # the stack
    def _node(self, state: int, parent: int) -> int:
        key = (state, parent)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
        return self.number[key]

    def _reduced(self, node: int, ahead: str) -> set[int]:
        """The node and all that reductions before ``ahead`` make of it."""
        out, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for rule in self.reduce.get((self.nodes[top][0], ahead), ()):
                left, right = self.rules[rule]
                base = top
                for _ in right:
                    base = self.nodes[base][1]
                new = self._node(self.goto[self.nodes[base][0], left], base)
                if new not in out:
                    out.add(new)
                    todo.append(new)
        return out

    def shift(self, node: int, symbol: str) -> list[int]:
        """The tops after ``symbol``, reduced where their state allows nothing else."""
        out = []
        for n in sorted(self._reduced(node, symbol)):
            if (self.nodes[n][0], symbol) in self.goto:
                new = self._node(self.goto[self.nodes[n][0], symbol], n)
                while self.nodes[new][0] in self.sole:
                    left, right = self.rules[self.sole[self.nodes[new][0]]]
                    base = new
                    for _ in right:
                        base = self.nodes[base][1]
                    new = self._node(self.goto[self.nodes[base][0], left], base)
                out.append(new)
        return out

    def accepts(self, node: int) -> bool:
        return any(self.nodes[n][0] in self.accept for n in self._reduced(node, "$"))

    # weighted actions
    def near(self, node: int) -> dict[int, int]:
        """Every node that insertions reach, with the fewest of them."""
        if node not in self._near:
            out, todo = {node: 0}, [node]
            for old in todo:
                for symbol in RENAMED:
                    for new in self.shift(old, symbol):
                        if new not in out:
                            out[new] = out[old] + 1
                            todo.append(new)
            self._near[node] = out
        return self._near[node]

    def moves(self, node: int, kind: int) -> dict[int, tuple[int, str]]:
        """The tops that insertions and then one edit of the row lead to, each with
        its least (cost, letters)."""
        if (node, kind) not in self._moves:
            out: dict[int, tuple[int, str]] = {}

            def reach(new: int, cost: int, letters: str) -> None:
                out[new] = min(out.get(new, (cost, letters)), (cost, letters))

            own, extra = ("?" + TERMINALS)[max(kind - 1, 0) // 2], TRUNCATED * ((kind + 1) % 2)
            for mid, k in self.near(node).items():
                reach(mid, k * INSERT + DELETE, "I" * k + "D")
                if kind != GONE:
                    for new in self.shift(mid, own):
                        reach(new, k * INSERT + extra, "I" * k + "K")
                    for symbol in RENAMED:
                        for new in self.shift(mid, symbol):
                            reach(new, k * INSERT + REROLE + extra, "I" * k + "R")
            self._moves[node, kind] = out
        return self._moves[node, kind]

    def _config(self, tops: tuple) -> int:
        if tops not in self._config_number:
            self._config_number[tops] = len(self.configs)
            self.configs.append(tops)
        return self._config_number[tops]

    def step(self, config: int, kind: int) -> tuple[int, int, list[tuple[int, str]]]:
        best: dict[int, tuple[int, int, str]] = {}
        for i, (node, cost) in enumerate(self.configs[config]):
            for new, (more, letters) in self.moves(node, kind).items():
                way = (cost + more, i, letters)
                if new not in best or way < best[new]:
                    best[new] = way
        least = min(cost for cost, _, _ in best.values())
        tops = sorted((i, letters, new, cost - least) for new, (cost, i, letters) in best.items() if cost - least <= SLACK)
        made = self._config(tuple((new, cost) for _, _, new, cost in tops)), least, [(i, letters) for i, letters, _, _ in tops]
        self.steps[config, kind] = made
        return made

    def audit(self, kinds: bytes) -> tuple[int, str]:
        """Cost and audit of the cheapest edits of rows of these kinds."""
        total, config, steps, trail = 0, self.start, self.steps, array("I")
        for kind in kinds:
            trail.append(config)
            config, more, _ = steps.get((config, kind)) or self.step(config, kind)
            total += more
        cost, at, k = min((cost + k * INSERT, i, k) for i, (node, cost) in enumerate(self.configs[config])
                          for mid, k in self.near(node).items() if self.accepts(mid))
        letters = ["I" * k]
        for i in range(len(kinds) - 1, -1, -1):
            at, own = steps[trail[i], kinds[i]][2][at]
            letters.append(own)
        return total + cost, "".join(reversed(letters))


_PARSER: list[Parser] = []


def parser() -> Parser:
    """One per worker process: its memory of steps serves all conversations."""
    if not _PARSER:
        _PARSER.append(Parser())
    return _PARSER[0]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _ordered(rows: DataFrame, *more: Column) -> DataFrame:
    """conv_id, turn, role, text (null: one space), there, and the md5 that orders the
    rows of one turn.  ``there``: null or true, where false the row is none, but its
    conversation is reported."""
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    return out.withColumn("tie", F.md5(F.concat(F.col("role"), F.lit(":"), F.col("text")).cast("binary")))


def parse_conversations(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id and REPORT for every conv_id of ``rows`` (conv_id, turn, role, text,
    and there if some rows only name their conversation)."""
    n = partitions or partitions_for(rows, "text")
    ordered = _ordered(rows)
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    first = F.substring("role", 1, 1)
    narrow = ordered.select(
        "conv_id", "turn", "tie", "there", first.alias("initial"), (ended == "").alias("blank"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(first != "", F.instr(F.lit(TERMINALS), first)).otherwise(0).alias("place"))
    w = Window.partitionBy("conv_id", "tie", "there").orderBy(F.col("turn").asc_nulls_first())
    narrow = narrow.repartition(n, "conv_id").withColumn("again", F.row_number().over(w) > 1)
    fault = F.when(~F.col("there"), -1).when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    narrow = narrow.withColumn("fault", fault).select(
        "conv_id", "turn", "tie", "initial", "fault", "again",
        F.when(F.col("fault").between(1, 2), GONE).otherwise(1 + 2 * F.col("place") + (F.col("fault") == 3).cast("int")).alias("kind"))
    narrow = narrow.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "tie", "again").drop("tie", "again")
    own = _type_of(rows)
    types = arrow_types(f"conv_id {own}, {REPORT}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        glr = parser()
        done: list[list] = []
        now = object()  # equal to no conv_id
        count = low = high = last = None

        def finish():
            cost, audit = glr.audit(bytes(kinds))
            done.append([now, (high - low + 1 - count[4]) if low is not None else 0, count[0], count[1], count[2], count[3], cost, audit])

        begun = False
        for b in batches:
            for conv, turn, initial, fault, kind in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or conv != now:
                    if begun:
                        finish()
                    # blank, duplicate, truncated, illegal, distinct turns
                    begun, now, kinds, before = True, conv, bytearray(), None
                    count, low, high, last = [0, 0, 0, 0, 0], None, None, None
                if fault < 0:
                    continue
                if turn is not None:
                    low, high = turn if low is None else low, turn
                    count[4] += last is None or turn != last
                    last = turn
                if fault:
                    count[fault - 1] += 1
                count[3] += before is not None and before + initial not in RIGHT
                before = initial
                kinds.append(kind)
            if len(done) >= 1000:
                yield as_batch([list(c) for c in zip(*done)], types)
                done.clear()
        if begun:
            finish()
        if done:
            yield as_batch([list(c) for c in zip(*done)], types)

    return map_arrow(narrow, run, f"conv_id {own}, {REPORT}")


def _type_of(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _beside(rows: DataFrame, partitions: int) -> DataFrame:
    """Each conversation's report and then its rows in order, whole conversations in a
    partition: conv_id, REPORT (null on rows), role and text (null on reports)."""
    report = parse_conversations(rows, partitions)
    own = _ordered(rows).filter("there").drop("there")
    both = report.unionByName(own, allowMissingColumns=True).repartition(partitions, "conv_id")
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "tie").drop("turn", "tie")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("report", its values) at each conversation's head, then (letter, role, text) for
    each row of the result and each row deleted; None after each batch."""
    audit, at, out, odd = "", 0, 0, 0

    def inserted():
        nonlocal at, out
        while at < len(audit) and audit[at] == "I":
            at, out = at + 1, out + 1
            yield "I", ("user", "assistant")[(out - 1 - odd) % 2], ""

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        letters = columns[b.schema.get_field_index("audit")]
        for i, (role, text) in enumerate(zip(columns[-2], columns[-1])):
            if letters[i] is not None:
                yield from inserted()
                audit, at, out = letters[i], 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                yield "report", [c[i] for c in columns[:-2]]
                continue
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter == "R":
                role = ("user", "assistant")[(out - odd) % 2]
            out += letter != "D"
            yield letter, role, text
        yield None
    yield from inserted()


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the repaired
    conversations.  Kept rows keep their role and text; inserted rows are empty."""
    own = _type_of(rows)
    schema = f"conv_id {own}, place long, edit string, role string, text string"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, place = None, 0
        for e in _edits(batches):
            if e is None:
                if made:
                    yield as_batch([list(c) for c in zip(*made)], types)
                made = []
            elif e[0] == "report":
                conv, place = e[1][0], 0
            elif e[0] != "D":
                made.append((conv, place, *e))
                place += 1
        if made:
            yield as_batch([list(c) for c in zip(*made)], types)

    return map_arrow(_beside(rows, partitions_for(rows, "text")), run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text; others are not read,
    but for a boolean ``there``, see parse_conversations): REPORT, and repaired_sha256
    of the repaired ``role:text`` lines.

    Rows come by turn, null turns first, rows of one turn by the md5 of ``role:text``
    (equal rows are alike).  A null role or text is one space; an empty or unknown
    role is illegal beside any other and cannot be kept.  A null conv_id is a
    conversation like others.  A conversation without rows gives zeros, an empty
    audit and the hash of the empty string; an empty table gives an empty one.
    """
    own = _type_of(rows)
    schema = f"conv_id {own}, {REPORT}, repaired_sha256 string"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = []
        report, digest, lines = None, None, 0
        for e in _edits(batches):
            if e is None:
                if made:
                    yield as_batch([list(c) for c in zip(*made)], types)
                made = []
            elif e[0] == "report":
                if report is not None:
                    made.append([*report, digest.hexdigest()])
                report, digest, lines = e[1], hashlib.sha256(), 0
            elif e[0] != "D":
                digest.update(("\n" if lines else "").encode() + f"{e[1]}:{e[2]}".encode())
                lines += 1
        if report is not None:
            made.append([*report, digest.hexdigest()])
        if made:
            yield as_batch([list(c) for c in zip(*made)], types)

    return map_arrow(_beside(rows, partitions_for(rows, "text")), run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1
    empties its text, 2 takes its full stops and marks, 3 repeats it, 4 makes it the
    user's.  Dropped rows stay with ``there`` false and no text."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    code = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    out = rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code <= 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (code != 0).alias("there"), F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1)).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "there", F.explode("times")).drop("col")

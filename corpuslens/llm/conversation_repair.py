"""Repair of conversations: faults of their rows, and the cheapest edits to roles (s?(ua)+)?, ASCII-least among equals.

Rows lie in order of conversation, turn, role and text over range partitions, so a conversation of any length is dealt over tasks. What is
surely a whole conversation is settled where it lies; others become fragments of bounded size, each with its cheapest edits from every state of the
grammar to every other. A stream over a conversation's fragments in order joins those ways and chooses one; fragments then render their part of it, and another
stream hashes the parts. Only the audit itself, a cell of the result, is held whole.

Edits of one prefix are shared: an audit is a linked node (the one before it, an edit) with ancestors at powers of two and a rolling hash. Of two audits
of equal cost the least is found by searching for the longest common prefix over ancestors whose hashes agree; what they agree on is verified link by link up to the node that both share,
and where a hash misled the texts themselves are compared. Neither of two such audits can begin with the other: both hold one edit for each row, and only the last is followed by inserts.

Rows: a null role or text is one space, as is a null id or turn in the key of damage. Null conv_ids are one conversation. Null turns come first. Rows of equal turn: by role, text.
Repeated rows are counted first and lie one after another. Empty texts are blank. Very long texts: whole, in fragments of their own. Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import batches, stage, unstage

#: Rows and bytes of text of a fragment.
ROWS, BYTES = 4096, 4_000_000
#: Rolling hashes of audits.
BASE, PRIME = 1_000_003, (1 << 61) - 1
#: States of the grammar: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
LEGAL = {"su", "ua", "au"}
_SPACES = r"[\x20\x09-\x0D]"


class Audits:
    """Persistent audits: node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, edits: str) -> int:
        for e in edits:
            up, k = [node], 0
            while len(self.up[up[k]]) > k:
                up.append(self.up[up[k]][k])
                k += 1
            self.up.append(tuple(up))
            self.edit.append(e)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * BASE + ord(e)) % PRIME)
            node = len(self.edit) - 1
        return node

    def lift(self, node: int, depth: int) -> int:
        while (more := self.depth[node] - depth) > 0:
            node = self.up[node][more.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of equal depth hold the same text, read up to the node that both share."""
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self.lift(x, depth), self.lift(y, depth)
        if a != b and self.hash[a] != self.hash[b]:
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            if self.same(self.up[a][0], self.up[b][0]):
                return self.edit[a] < self.edit[b]
        elif self.same(a, b):
            return self.depth[x] < self.depth[y]
        return self.text(x) < self.text(y)


def least(offers: list[tuple[int, int, str]], audits: Audits) -> tuple[int, int]:
    """The cheapest of (cost, node, edits after it), the least audit of those; as (cost, node)."""
    cost = min(o[0] for o in offers)
    node, *rest = [audits.add(n, edits) for c, n, edits in offers if c == cost]
    for n in rest:
        if audits.less(n, node):
            node = n
    return cost, node


def ways(rows: list[tuple[str, bool, bool]], entry: int, audits: Audits) -> dict[int, tuple[int, int]]:
    """For each state that rows (initial, must go, truncated) can lead to from `entry`: cost and audit.

    An insert comes right before a row that stays: before a deleted one it would be less after it.
    """
    best = {entry: (0, 0)}
    for initial, gone, truncated in rows:
        if gone:
            best = {q: (c + DELETE, audits.add(n, "D")) for q, (c, n) in best.items()}
            continue
        offers: dict[int, list] = {}
        for q, (c, n) in best.items():
            offers.setdefault(q, []).append((c + DELETE, n, "D"))
            c += truncated
            direct = ASSISTANT if q == USER else USER
            other = USER + ASSISTANT - direct
            offers.setdefault(direct, []).append((c + REROLE, n, "R"))
            offers.setdefault(other, []).append((c + INSERT + REROLE, n, "IR"))
            if initial == "s" and q == NOTHING:
                offers.setdefault(SYSTEM, []).append((c + KEEP, n, "K"))
            elif initial in ("u", "a"):
                wanted = USER if initial == "u" else ASSISTANT
                offers[wanted].append((c + KEEP, n, "K") if wanted == direct else (c + INSERT + KEEP, n, "IK"))
        best = {q: least(o, audits) for q, o in offers.items()}
    return best


#: Inserts that end a conversation from each state, and their cost.
ENDS = {NOTHING: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}


def render(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """Lines role:text after the edits of an audit, and the state that they lead to."""
    out, at = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e == "D":
            continue
        if e == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        out.append(f"{role}:{text}")
    return out, state


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_FRAGMENT = pa.schema(
    [("conv_id", pa.int64()), ("no", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
    + [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.string()), ("ways", pa.list_(_WAY)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
FRAGMENT = (
    f"conv_id long, no long, {', '.join(f'{c} long' for c in COUNTS)}, first_turn long, last_turn long, turns long, head string, tail string, cost long, audit string, "
    "repaired_sha256 string, repaired string, ways array<struct<entry:int,exit:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
)


def _fragment(conv, rows: list[tuple], no: int, whole: bool, with_text: bool) -> dict:
    """rows: (turn, role, text, initial, blank, fresh, truncated) of one copy each."""
    initials = [r[3] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    out = {
        "conv_id": conv, "no": no, "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "head": initials[0], "tail": initials[-1],
        "blank": sum(r[4] for r in rows), "duplicate": sum(not r[4] and not r[5] for r in rows), "truncated": sum(not r[4] and r[5] and r[6] for r in rows),
        "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False)),
    }
    todo, texts, audits = [(r[3], r[4] or not r[5], r[6]) for r in rows], [(r[1], r[2]) for r in rows], Audits()
    if whole:
        offers = [(c + ENDS[q][1], n, ENDS[q][0]) for q, (c, n) in ways(todo, NOTHING, audits).items()]
        cost, node = least(offers, audits)
        audit = audits.text(node)
        lines = "\n".join(render(texts, audit, NOTHING)[0])
        return out | {"cost": cost, "audit": audit, "repaired_sha256": _sha(lines), "repaired": lines if with_text else None}
    found = [(entry, q, c, audits.text(n)) for entry in range(4) for q, (c, n) in ways(todo, entry, audits).items()]
    return out | {"ways": [dict(zip(("entry", "exit", "cost", "audit"), w, strict=True)) for w in found], "roles": [x for x, _ in texts], "texts": [x for _, x in texts]}


def _fragments(with_text: bool):
    def run(it):
        here, made = TaskContext.get().partitionId() << 40, 0
        conv, rows, size, alone, seen = None, [], 0, False, False

        def out(whole: bool):
            nonlocal rows, size, made
            made += 1
            row = _fragment(conv, rows, here + made, whole, with_text)
            rows, size = [], 0
            return pa.RecordBatch.from_pylist([row], _FRAGMENT)

        for batch in batches(it):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen and r[0] != conv:
                    if rows:
                        yield out(alone)  # its end is seen, and so is its beginning unless it is the partition's first
                    alone = True
                seen, conv = True, r[0]
                turn, role, text, initial, blank, fresh, truncated, n = r[1:]
                for copy in range(n):
                    rows.append((turn, role, text, initial, blank, fresh and not copy, truncated))
                    size += len(text)
                    if len(rows) >= ROWS or size >= BYTES:
                        alone = False
                        yield out(False)
        if rows:
            yield out(False)

    return run


class Way:
    """A way through fragments, linked: the one before it, and this fragment's part of the audit."""

    def __init__(self, before, no: int, entry: int, audit: str):
        self.before, self.no, self.entry, self.audit = before, no, entry, audit


def _way_less(x: Way | None, y: Way | None, ends: tuple[str, str] = ("", "")) -> bool:
    """Compares audits from the first fragment on which two ways differ; both are through the same fragments."""
    a, b = [ends[0]], [ends[1]]
    while x is not y:
        a.append(x.audit)
        b.append(y.audit)
        x, y = x.before, y.before
    return "".join(reversed(a)) < "".join(reversed(b))


_STITCHED = pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("entry", pa.int32()), ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string())])
STITCHED = f"conv_id long, no long, entry int, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"


class _Joined:
    """A conversation's fragments so far."""

    def __init__(self, conv):
        self.conv, self.best, self.counts, self.tail = conv, {NOTHING: (0, None)}, dict.fromkeys(COUNTS, 0), None
        self.first = self.last = None
        self.turns = 0

    def take(self, f: dict) -> None:
        for c in COUNTS:
            self.counts[c] += f[c]
        if self.tail is not None and self.tail + f["head"] not in LEGAL:
            self.counts["illegal"] += 1
        self.tail = f["tail"]
        if f["turns"]:
            self.turns += f["turns"] - (self.last == f["first_turn"])
            self.first, self.last = f["first_turn"] if self.first is None else self.first, f["last_turn"]
        best: dict[int, tuple[int, Way]] = {}
        for w in f["ways"]:
            if w["entry"] not in self.best:
                continue
            cost, before = self.best[w["entry"]]
            cost, way = cost + w["cost"], Way(before, f["no"], w["entry"], w["audit"])
            now = best.get(w["exit"])
            if now is None or cost < now[0] or cost == now[0] and _way_less(way, now[1]):
                best[w["exit"]] = (cost, way)
        self.best = best

    def done(self) -> pa.RecordBatch:
        end, best = None, None
        for q, (cost, way) in self.best.items():
            text, more = ENDS[q]
            if best is None or cost + more < best[0] or cost + more == best[0] and _way_less(way, best[1], (text, end)):
                best, end = (cost + more, way), text
        chosen, way = [], best[1]
        while way is not None:
            chosen.append(way)
            way = way.before
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        parts = [{"conv_id": self.conv, "no": w.no, "entry": w.entry, "audit": w.audit + (end if w is best[1] else "")} for w in reversed(chosen)]
        total = {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": best[0], "audit": "".join(p["audit"] for p in parts)}
        return pa.RecordBatch.from_pylist([total, *parts], _STITCHED)


def _stitch(it):
    """Of fragments by conversation and number: one row for each conversation, and of each fragment (with `no`) the chosen edits."""
    now = None
    for batch in it:
        for k in range(batch.num_rows):
            f = batch.slice(k, 1).to_pylist()[0]
            if now is None or f["conv_id"] != now.conv:
                if now is not None:
                    yield now.done()
                now = _Joined(f["conv_id"])
            now.take(f)
    if now is not None:
        yield now.done()


def _render(it):
    for batch in it:
        for k in range(batch.num_rows):
            f = batch.slice(k, 1).to_pylist()[0]
            lines = render(list(zip(f["roles"], f["texts"], strict=True)), f["audit"], f["entry"])[0]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((f["conv_id"], pa.int64()), (f["no"], pa.int64()), ("\n".join(lines), pa.string()))], ["conv_id", "no", "lines"])


def _hash(with_text: bool):
    """Hash (and text) of rendered lines that come by conversation and number."""

    def run(it):
        now, sha, held = (), None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(now, pa.int64()), pa.array([sha.hexdigest()]), pa.array(["\n".join(held) if with_text else None], pa.string())], ["conv_id", "repaired_sha256", "repaired"])

        for batch in it:
            for conv, lines in zip(batch["conv_id"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                if (conv,) == now:
                    sha.update(b"\n")
                else:
                    if now:
                        yield out()
                    now, sha, held = (conv,), hashlib.sha256(), []
                sha.update(lines.encode())
                if with_text:
                    held.append(lines)
        if now:
            yield out()

    return run


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns with faults by the checksum of each row's key: of 20 rows one is dropped, one emptied, one loses its ends of sentences, one is there twice, one becomes the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    out = _plain(turns).where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return out.drop("copy")


def _last_letter(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, f"{_SPACES}+\\z", ""), -1, 1)


def repair(turns: DataFrame, with_text: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and the repaired text) of every conversation of turns (conv_id, turn, role, text)."""
    rows = stage(_plain(turns).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n")), "rows")
    # Where each text was first said: null turns come first, in structs too.
    said = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    same = rows["conv_id"].eqNullSafe(said["conv_id"]) & (rows["role"] == said["role"]) & (rows["text"] == said["text"])
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    marked = rows.join(said.hint("merge"), same).select(rows["*"], said["first"]["turn"].eqNullSafe(rows["turn"]).alias("fresh"))
    marked = marked.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), "fresh", (~_last_letter(F.col("text")).isin(".", "!", "?")).alias("truncated"), "n")
    marked = stage(marked, "marked")
    ordered = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    fragments = stage(ordered.mapInArrow(_fragments(with_text), FRAGMENT), "fragments")
    open_ = fragments.where("ways IS NOT NULL")
    steps = open_.select("conv_id", "no", *COUNTS, "first_turn", "last_turn", "turns", "head", "tail", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "no")
    stitched = stage(steps.mapInArrow(_stitch, STITCHED), "stitched")
    unstage(rows, marked)
    chosen = stitched.where("no IS NOT NULL").select("no", "entry", "audit")
    parts = open_.select("conv_id", "no", "roles", "texts").join(chosen, "no").mapInArrow(_render, "conv_id long, no long, lines string")
    hashed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(_hash(with_text), "conv_id long, repaired_sha256 string, repaired string")
    totals = stitched.where("no IS NULL").drop("no", "entry")
    sewn = totals.join(hashed, totals["conv_id"].eqNullSafe(hashed["conv_id"]), "left").select(totals["*"], F.coalesce("repaired_sha256", F.lit(_sha(""))).alias("repaired_sha256"), F.coalesce("repaired", F.lit("")).alias("repaired"))
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    columns = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256", *["repaired"] * with_text]
    return fragments.where("ways IS NULL").withColumn("gaps", gaps).select(columns).unionByName(sewn.select(columns))


def repair_all(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """repair() of damaged rows, with a row for every conversation of turns; those without rows have zeros, no edits and the hash of an empty text."""
    found = repair(damaged)
    every = turns.select(F.col("conv_id").cast("long")).distinct()
    rest = [F.coalesce(F.col(c), F.lit(_sha("") if c == "repaired_sha256" else "" if c == "audit" else 0)).alias(c) for c in found.columns[1:]]
    return every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").select(every["conv_id"], *rest)

"""Repair of conversations against plain dynamic programming over whole strings and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpuslens.llm import conversation_repair as cr
from corpuslens.llm import queries
from tests.llm.test_operators import frame

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
FULL = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marks(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        letters = FULL.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def step(state, role):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))


def plain(rows):
    """Dynamic programming over (cost, audit, lines) tuples of every state; inserts anywhere."""
    best = {"": (0, "", ())}

    def inserts():
        for _ in range(3):
            for q, (c, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step(q, role[0])) is not None:
                        best[to] = min(best.get(to, (9e9,)), (c + 2, audit + "I", (*lines, role + ":")))

    for role, text, fault in marks(rows):
        inserts()
        new = {}
        for q, (c, audit, lines) in best.items():
            options = [(q, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append((step(q, role[:1]), extra, "K", (f"{role}:{text}",)))
                options += [(step(q, r[0]), 2 + extra, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            for to, cost, edit, more in options:
                if to is not None:
                    new[to] = min(new.get(to, (9e9,)), (c + cost, audit + edit, lines + more))
        best = new
    inserts()
    return min(best[q] for q in ("", "a") if q in best)


def expected(rows, ids):
    out = []
    for c in ids:
        mine = [r for r in rows if r[0] == c]
        found = marks(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = plain(mine)
        initials = [r[0][:1] for r in found]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_rows(r, convs, longest=9):
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    texts = ["Yes.", "No!", "half", " \t", "", "Why?  ", "a b.", "umm\x85", "x. y", None]
    out = []
    for c in convs:
        for k in range(r.randrange(longest)):
            turn = r.choice([None, k, k, k, k + r.randrange(3)])
            out.append((c, turn, r.choice(roles[:2] * 3 + roles), r.choice(texts) if r.random() < 0.7 else f"said {r.randrange(50)}."))
    return out


def test_query_on_conversations(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, sf_dir)) == expected(damaged(rows), {x[0] for x in rows})


@pytest.mark.parametrize(("size", "prime"), [(4096, cr.PRIME), (1, cr.PRIME), (2, cr.PRIME), (3, 7), (4096, 5)])
def test_awkward_conversations_in_fragments_of_every_size(spark, tmp_path, monkeypatch, size, prime):
    """A tiny prime makes most hashes collide."""
    monkeypatch.setattr(cr, "ROWS", size)
    monkeypatch.setattr(cr, "PRIME", prime)
    rows = random_rows(random.Random(size * prime), [None, -1, *range(60)])
    rows += rows[:10] + [(99, 0, "user", "gone")]
    frame(spark, [(*x, 1, "y") for x in rows], SCHEMA + ", n int, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    with pytest.MonkeyPatch.context() as m:
        fragments = cr._fragments
        m.setattr(cr, "_fragments", lambda with_text: _with(fragments(with_text), size, prime))
        assert got(queries.op13_conversation_repair(spark, str(tmp_path))) == expected(damaged(rows), {x[0] for x in rows})


def _with(run, size, prime):
    """The workers' module gets the same sizes."""

    def inner(it):
        from corpuslens.llm import conversation_repair as there

        there.ROWS, there.PRIME = size, prime
        try:
            yield from run(it)
        finally:
            there.ROWS, there.PRIME = 4096, (1 << 61) - 1

    return inner


def test_cheapest_edits_by_trying_all():
    """Every edit sequence of a few rows, kept if its roles fit the grammar."""
    r = random.Random(5)
    for _ in range(150):
        rows = [(r.choice("suaat"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(4))]
        best = None
        for inserted in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            for kept in itertools.product("KDUA", repeat=len(rows)):
                if any(e != "D" and gone for e, (_, gone, _) in zip(kept, rows, strict=True)):
                    continue
                roles, audit, cost = inserted[0], "I" * len(inserted[0]), 2 * sum(map(len, inserted))
                for e, (initial, _, truncated), more in zip(kept, rows, inserted[1:], strict=True):
                    roles += ("" if e == "D" else initial if e == "K" else e.lower()) + more
                    audit += ("R" if e in "UA" else e) + "I" * len(more)
                    cost += {"K": 0, "D": 3}.get(e, 2) + (truncated and e != "D")
                if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        audits = cr.Audits()
        cost, node = cr.least([(c + cr.ENDS[q][1], n, cr.ENDS[q][0]) for q, (c, n) in cr.ways(rows, cr.NOTHING, audits).items()], audits)
        assert (cost, audits.text(node)) == best


@pytest.mark.parametrize("prime", [cr.PRIME, 3])
def test_audits_compare_as_their_texts(monkeypatch, prime):
    monkeypatch.setattr(cr, "PRIME", prime)
    r, audits, nodes = random.Random(6), cr.Audits(), [0]
    for _ in range(600):
        nodes.append(audits.add(r.choice(nodes[-40:]), r.choice("DIKR")))
    for _ in range(3000):
        x, y = r.choice(nodes), r.choice(nodes)
        assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def test_a_hot_conversation_and_repeated_rows(spark):
    r = random.Random(7)
    rows = [(1, k, r.choice(["user", "assistant"]), r.choice(["Fine.", "why?", f"said {k}", f"told {k}."])) for k in range(9000)] + [(2, 3, "user", "again.")] * 5000 + [(3, 1, "user", "z" * 5_000_000)]
    found = {x["conv_id"]: x for x in cr.repair(frame(spark, rows, SCHEMA), with_text=True).collect()}
    assert sorted(tuple(x)[:-1] for x in found.values()) == expected(rows, {1, 2, 3})
    assert found[2]["repaired"] == "user:again.\nassistant:" and all(hashlib.sha256(x["repaired"].encode()).hexdigest() == x["repaired_sha256"] for x in found.values())


def test_nothing(spark, tmp_path):
    frame(spark, [], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0

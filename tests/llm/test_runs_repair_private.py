"""Periodic runs, conversation repair and personal data: brute-force versions and edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm import conversations, private, runs
from panelmill.llm.queries import QUERIES, damaged, planted_repeats

ODD = [
    (None, None),
    (None, "a a a a a a a"),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "word " * 30_000),
    (5, "x y " * 5 + "x z"),
    (5, "x y " * 5 + "x z"),
    (6, "  ".join("ab" * 8)),
    (7, "mail a.b@c.org, 10.0.0.999 10.0.0.255 and +1 (269) 555-3296"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ---


def runs_by_scan(words, least_words, least_periods):
    found, n = [], len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(least_words, least_periods * q):
                if not any(stretch[:-r] == stretch[r:] for r in range(1, q)):
                    found.append((start, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least_words, least_periods", [(6, 4), (2, 2), (4, 2), (9, 3)])
def test_runs_against_scan(least_words, least_periods):
    draw = np.random.default_rng(least_words)
    for _ in range(60):
        texts = []
        for _ in range(8):
            n = int(draw.integers(0, 60))
            words = draw.integers(0, draw.integers(1, 4), n)
            at = planted_repeats(int(draw.integers(100)), n) if n else None
            texts.append(words[at] if at is not None else words)
        got = runs.periodic_runs(texts, least_words, least_periods)
        assert got == [runs_by_scan(t.tolist(), least_words, least_periods) for t in texts]


def test_long_runs_take_linear_steps():
    n = 300_000
    assert runs.periodic_runs([np.zeros(n, np.int64), np.arange(n) % 7], 6, 4) == [[(0, n, 1)], [(0, n, 7)]]


def test_op11(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{small}/documents.parquet'").fetchall()
    want = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs_by_scan(words, 6, 4) if n < 3_000 else None
        want[doc_id] = (words, found)
    got = QUERIES["op11_periodic_runs"](spark, small).collect()
    assert len(got) == len(rows)
    assert sum(r.n_runs > 0 for r in got) > 10
    for r in got:
        words, found = want[r.doc_id]
        if found is None:
            continue
        dropped = {x for s, length, q in found for x in range(s + q, s + length)}
        best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_runs_edge_cases(make):
    docs = make(ODD).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("mine"))
    got = runs.find_runs(docs, arrange=lambda name, n: None).collect()
    assert len(got) == len(ODD)
    found = {(r.doc_id, len(r.collapsed)): ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert found[(None, 1)] == ([(0, 7, 1)], "a")
    assert found[(4, 4)] == ([(0, 30_000, 1)], "word")
    assert found[(5, 5)] == ([(0, 11, 2)], "x y z")
    assert found[(1, 0)] == found[(2, 0)] == found[(3, 0)] == ([], "")
    # A no-break space is no separator.
    assert [r.runs for r in got if r.doc_id == 6][0][0].period == 2
    assert runs.find_runs(make([])).collect() == []


# --- conversations ---


def cheapest(messages):
    """Least cost and least letters by trying every edit; ``messages`` are (initial, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def go(i, state, inserts):
        found = [(0, "")] if i == len(messages) and state in ("", "a") else []
        moves = []
        if inserts:
            moves += [("I", 2, step.get((state, r)), i, inserts - 1) for r in "ua"]
        if i < len(messages):
            initial, fault = messages[i]
            moves.append(("D", 3, state, i + 1, 3))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                moves.append(("K", more, step.get((state, initial)), i + 1, 3))
                moves += [("R", 2 + more, step.get((state, r)), i + 1, 3) for r in "ua"]
        for letter, cost, to, at, left in moves:
            if to is not None:
                rest = go(at, to, left)
                if rest:
                    found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=None)

    return go(0, "", 3)


def repaired(messages, audit):
    out, state, at = [], "", 0
    for letter in audit:
        role = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((role, ""))
        else:
            old, text = messages[at]
            at += 1
            if letter == "D":
                continue
            out.append((role if letter == "R" else old, text))
        state = out[-1][0][0]
    assert at == len(messages)
    return out


def expected(conversation):
    """All columns of a conversation of ``turn, role, text`` rows."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(tuple(zip(initials, faults)))
    after = repaired([(r[1], r[2]) for r in rows], audit)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in after)),
    }


def test_op12(spark, small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet'").fetchall()
    damage = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damage[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, small).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert {k: v for k, v in r.items() if k != "conv_id"} == expected(damage[conv])


ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("audit", T.StringType()),
    ]
)


@pytest.mark.parametrize("segment", [3, 65_536])
def test_repair_against_all_edits(spark, segment):
    draw = np.random.default_rng(segment)
    texts = ["", " \n", "so it is.", "so it is", "why? \t", "x", " "]
    roles = ["system", "user", "assistant", "tool", "", "users"]
    rows = []
    for conv in range(60):
        for _ in range(int(draw.integers(1, 13))):
            turn = None if draw.random() < 0.1 else int(draw.integers(0, 9))
            role = roles[draw.choice(6, p=[0.1, 0.35, 0.35, 0.08, 0.04, 0.08])]
            rows.append((None if conv == 7 else conv, turn, role, texts[draw.integers(len(texts))], "mine"))
    table = spark.createDataFrame(rows, ROWS)
    plans = conversations.plan_repairs(table, segment=segment)
    got = {r.conv_id: r.asDict() for r in conversations.repaired_digests(table, plans).collect()}
    held = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        held[conv].append((turn, role, text))
    assert set(got) == set(held)
    for conv, r in got.items():
        assert {k: v for k, v in r.items() if k != "conv_id"} == expected(held[conv]), conv
    messages = defaultdict(list)
    for r in sorted(conversations.repaired_messages(table, plans).collect(), key=lambda r: r.position):
        messages[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(messages[c])) for c in held} == {c: r["repaired_sha256"] for c, r in got.items()}


def test_repair_edge_cases(spark):
    rows = [
        (1, None, None, None, ""),
        (2, 3, "user", "hot.", ""),
        *[(3, 1, "user", "again and again.", "")] * 500,
        *[(4, t, "user" if t % 2 else "assistant", f"turn {t}.", "") for t in range(1, 2001)],
    ]
    table = spark.createDataFrame(rows, ROWS)
    present = F.col("conv_id") != 2
    plans = conversations.plan_repairs(table, present=present, segment=100)
    got = {r.conv_id: r for r in conversations.repaired_digests(table, plans, present=present).collect()}
    assert (got[1].blank, got[1].audit, got[1].repaired_sha256) == (1, "D", sha(""))
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (0, "", sha(""))
    assert (got[3].duplicate, got[3].audit) == (499, "D" * 500) or got[3].audit == "K" + "D" * 499 + "I"
    assert (got[3].cost, got[3].gaps) == (499 * 3 + 2, 0)
    assert (got[4].cost, got[4].audit, got[4].illegal) == (0, "K" * 2000, 0)
    assert conversations.plan_repairs(table.limit(0)).collect() == []


def test_damage_fills_nulls(spark):
    rows = damaged(spark.createDataFrame([(None, None, None, None, "")], ROWS)).collect()
    assert {(r.conv_id, r.turn, r.role) for r in rows} <= {(None, None, " "), (None, None, "user")}


# --- personal data ---


def test_op13(spark, small):
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 12 <= len(d) <= 19 and by_table(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
    ]

    def by_table(digits):
        twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
        return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0

    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{small}/documents.parquet'").fetchall())
    got = QUERIES["op13_personal_data"](spark, small).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        spans = sorted(
            (m.start(), i, m.end(), kind)
            for i, (kind, rule, kept) in enumerate(rules)
            for m in re.finditer(rule, text)
            if kept(m.group(), re.sub(r"\D", "", m.group()))
        )
        shown = [f"{kind}:{start}:{end}" for start, _, end, kind in spans]
        assert r.base_sha256 == sha(",".join(shown))
        assert [s for s in r.spans.split(",") if s and not s.startswith("likely_")] == shown
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in private.KINDS]


def test_field_decodes_the_best_tags():
    draw = np.random.default_rng(4)
    for _ in range(200):
        n, k = int(draw.integers(1, 6)), len(private.TAGS)
        emit, pairs = draw.normal(size=(n, k)) * 3, draw.normal(size=(k, k))
        emit[:, 0] += draw.choice([0, 4, 9])

        def score(tags):
            ends = zip((0, *tags), (*tags, 0), strict=True)
            return sum(emit[i, t] for i, t in enumerate(tags)) + sum(pairs[a, b] for a, b in ends)

        best = max(itertools.product(range(k), repeat=n), key=score)
        got = private.viterbi(np.concatenate([emit, emit]), pairs, np.array([0, n])).reshape(2, n)
        assert [score(tuple(tags)) for tags in got.tolist()] == pytest.approx([score(best)] * 2)


def test_likelihood_slope():
    """Training raises the likelihood of its labels to near certainty where shapes tell them apart."""
    windows = [(["x", "3-4", "x"], [0, 4, 0]), (["x", "x"], [0, 0]), (["(3)", "3-4"], [4, 4]), (["4", "x"], [0, 0])] * 5
    field = private.train(windows)
    decode = private.Decoder(field)
    tags, edges = decode(pa.array(["call (269) 555-3296 now", "in 2024 it was", "555-3296"]))
    assert [tags[a:b].tolist() for a, b in itertools.pairwise(edges)] == [[0, 4, 4, 0], [0, 0, 0, 0], [4]]


def planted(seed, n):
    """Rewritten forms of made-up data in plain sentences: ``text, kind, start, end``."""
    draw = np.random.default_rng(seed)

    def pick(*options):
        return options[draw.integers(len(options))]

    for _ in range(n):
        kind = pick(*private.KINDS)
        digits = "".join(map(str, draw.integers(0, 10, 15)))
        if kind == "email":
            data = f"{pick('ann', 'bob.li', 'kw')}.{draw.integers(99)}@{pick('corp', 'mail')}.{pick('example.org', 'co.uk')}"
        elif kind == "ip":
            data = ".".join(map(str, draw.integers(1, 255, 4)))
        elif kind == "card":
            data = next(digits + c for c in "0123456789" if private.luhn(digits + c))
        else:
            data = f"+1 ({draw.integers(200, 999)}) {draw.integers(200, 999)}-{draw.integers(1000, 9999)}"
        form = pick(*private.rewritten(kind, data))
        before = " ".join(pick("the", "Ondly", "that", "wherest,", "in", "at", "dot") for _ in range(5)) + " "
        yield before + form + " and ernt thou.", kind, len(before), len(before) + len(form)


def test_rewritten_forms_are_found(spark, small, make):
    labelled = private.labelled_windows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    cases = list(planted(11, 200))
    got = private.find_private(make([(i, c[0]) for i, c in enumerate(cases)]), labelled).collect()
    hits = sum(
        any((s.start, s.end) == cases[r.doc_id][2:] and s.kind.endswith(cases[r.doc_id][1]) for s in r.spans) for r in got
    )
    assert hits >= 0.8 * len(cases)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = private.find_private(docs.where(~F.col("text").rlike("[0-9@]")), labelled)
    assert clean.where(F.size("spans") > 0).count() == 0


def test_private_edge_cases(make):
    got = private.find_private(make(ODD).withColumn("spans", F.lit(1))).collect()
    assert len(got) == len(ODD)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got}
    assert found[7] == [("email", 5, 14), ("ip", 27, 37), ("phone", 42, 59)]
    assert all(not found[d] for d in (1, 2, 3, 4, 5, 6))
    assert private.find_private(make([])).collect() == []

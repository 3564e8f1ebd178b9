"""Conversation repair, chat formatting and fill-in-middle against brute force, round trips and DuckDB."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from careerline.llm import chat_format, conversation_repair, fill_in_middle, role_grammar
from careerline.llm.queries import CONTROL_TEXT, LLM_QUERIES
from careerline.llm.sql import LLM_SQL
from registry.compare import difference, oracle_connection

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
EDGE_TURNS = [
    (None, None, None, None),
    (None, 1, "user", "Without an id."),
    (1, None, "system", "First, as its turn is missing."),
    (1, 0, "user", "Same."),
    (1, 0, "user", "Same."),
    (1, 7, "assistant", " \n\t "),
    (1, 8, "umpire", "A role that begins like the user's!"),
    (1, 9, "", "No role?"),
    (2, 5, "assistant", None),
    (3, 0, "assistant", "é" * 70_000 + "."),
    (4, 0, "a:\\c</turn>### b\n", "x\\e\\\\b </turn>\n### user: y"),
    (4, 1, "assistant", "\\### Assistant: </turn> ok"),
    (4, 2, "assistant", "and again"),
    (4, 3, "user", "no reply"),
]


@pytest.fixture(scope="module")
def given(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(*names).collect()]


@pytest.mark.parametrize("name", ["op11_repair", "op12_chat_format", "op13_fill_in_middle"])
def test_same_as_duckdb(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, oracle_connection(folder), folder, LLM_QUERIES[name], LLM_SQL[name]) is None


# --- repair ----------------------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def all_audits(marks: str):
    """Every sequence of edits, at most as dear as deleting every row, as (cost, audit)."""
    most = 4 * len(marks)

    def go(row, state, cost, audit):
        if cost > most:
            return
        if row == len(marks) and state in ("", "a"):
            yield cost, audit
        for role in "ua":
            if (state, role) in NEXT:
                yield from go(row, NEXT[state, role], cost + 3, audit + "I")
        if row == len(marks):
            return
        yield from go(row + 1, state, cost + 4, audit + "D")
        mark = marks[row]
        if mark in "bd":
            return
        cut_off = 3 * mark.islower()
        if (state, mark.lower()) in NEXT:
            yield from go(row + 1, NEXT[state, mark.lower()], cost + cut_off, audit + "K")
        for role in "ua":
            if (state, role) in NEXT:
                yield from go(row + 1, NEXT[state, role], cost + cut_off + 3, audit + "R")

    return go(0, "", 0, "")


def cheapest(matrix):
    ends = zip(matrix[0], map(role_grammar.closing_cost, range(4)), role_grammar.CLOSING, strict=True)
    return min((x[0] + cost, role_grammar.spelled(x[1]) + "I" * len(roles)) for x, cost, roles in ends if x)


def test_matrices_find_the_cheapest_and_least_audit():
    short = ["".join(x) for n in (1, 2, 3) for x in itertools.product(role_grammar.MARKS, repeat=n)]
    dice = random.Random(5)
    longer = ["".join(dice.choices(role_grammar.MARKS, k=5)) for _ in range(300)]
    sequences = [*short, *longer]
    for marks, matrix in zip(sequences, role_grammar.transfer_matrices(sequences), strict=True):
        assert cheapest(matrix) == min(all_audits(marks)), marks


@pytest.mark.parametrize("least_uses", [2, 10**9])
def test_rules_spell_their_sequences(least_uses):
    dice = random.Random(6)
    sequences = ["U" * 9, "UA" * 40, "", "b", *("".join(dice.choices("UAUAs", k=30)) for _ in range(50))]
    rules, shortened = role_grammar.re_pair(sequences, least_uses=least_uses)
    marks = list(role_grammar.MARKS)
    for x, y in rules:
        marks.append(marks[x] + marks[y])
    assert ["".join(marks[k] for k in row) for row in shortened] == sequences
    assert bool(rules) == (least_uses == 2)


def damage_by_hand(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 4:
            role = "user"
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def cheapest_by_hand(marks):
    """Row by row: the best audit per state, inserts by repeated relaxation."""
    best = {"": (0, "")}
    for mark in [*marks, None]:
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (state, role) in NEXT:
                        way = (cost + 3, audit + "I")
                        best[NEXT[state, role]] = min(best.get(NEXT[state, role], way), way)
        if mark is None:
            return min(best[s] for s in ("", "a") if s in best)
        after = defaultdict(list)
        for state, (cost, audit) in best.items():
            after[state].append((cost + 4, audit + "D"))
            for role in "sua" if mark not in "bd" else "":
                extra = 3 * mark.islower() + 3 * (role != mark.lower())
                if (state, role) in NEXT and (role == mark.lower() or role != "s"):
                    after[NEXT[state, role]].append((cost + extra, audit + ("K" if role == mark.lower() else "R")))
        best = {state: min(ways) for state, ways in after.items()}


def report_by_hand(rows):
    sorted_rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    marks, seen = "", set()
    for _, _, role, text in sorted_rows:
        mark = role[0] if role and role[0] in "sua" else "o"
        stripped = text.strip(WHITE)
        if not stripped:
            mark = "b"
        elif (role, text) in seen:
            mark = "d"
        elif stripped[-1] in ".!?":
            mark = mark.upper()
        seen.add((role, text))
        marks += mark
    turns = [r[1] for r in sorted_rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in sorted_rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = cheapest_by_hand(marks)
    lines, k = [], 0
    for letter in audit:
        role, text = (sorted_rows[k][2], sorted_rows[k][3]) if letter != "I" else (None, "")
        if letter in "IR":
            role = "assistant" if lines and lines[-1][0] == "u" else "user"
        if letter != "D":
            lines.append(f"{role}:{text}")
        k += letter != "I"
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    faults = Counter(marks)
    cut_off = sum(faults[x] for x in "suao")
    return gaps, faults["b"], faults["d"], cut_off, illegal, cost, audit, digest


def by_conversation(rows):
    found = defaultdict(list)
    for row in rows:
        found[row[0]].append(row)
    return found


def check_repair(spark, rows):
    found = conversation_repair.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    after = by_conversation(damage_by_hand(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {k: report_by_hand(after[k]) if k in after else empty for k in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in found} == want
    assert len(found) == len(want)


def test_repair_matches_the_plain_rules(spark, given):
    check_repair(spark, given)


def test_repair_of_odd_rows(spark):
    check_repair(spark, EDGE_TURNS)
    assert conversation_repair.digests(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("segment_bits", [1, 3, 10])
def test_long_conversations_in_segments(spark, monkeypatch, segment_bits):
    """The borders of segments leave no trace, whatever their length."""
    dice = random.Random(7)
    rows = [
        (k % 3, k, dice.choice(["user", "assistant", "system", "tool"]), dice.choice(["", "yes.", f"word {k}.", f"cut {k}"]))
        for k in range(300)
    ]
    usual = conversation_repair.plan
    monkeypatch.setattr(conversation_repair, "plan", lambda rows, _: usual(rows, segment_bits))
    check_repair(spark, rows)


def test_repaired_rows_and_clashing_columns(spark):
    names = "key long, place long, step string, conv long, n long, said string, who string"
    rows = [(1, 2, "x", 9, 1, "Hello.", "user"), (1, 2, "x", 9, 2, "Again.", "user"), (1, 2, "x", 9, 3, "Bye.", "assistant")]
    shown, report = conversation_repair.repair(spark.createDataFrame(rows, names), "conv", "n", "who", "said")
    found = [(r["edit"], r["role"], r["text"]) for r in shown.orderBy("place", "step").collect()]
    assert [r["audit"] for r in report.collect()] == ["KIKK"]
    assert found == [("K", "user", "Hello."), ("I", "assistant", ""), ("K", "user", "Again."), ("K", "assistant", "Bye.")]


# --- chat format -----------------------------------------------------------------------------


def turns_by_hand(rows):
    for conv, turns in by_conversation(rows).items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        yield conv, [(r[2] or "", r[3] or "") for r in turns]


def test_examples_are_read_back(spark, given):
    rows = [*given, *EDGE_TURNS]
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    for conv, turns in turns_by_hand(rows):
        replies = "".join(text for role, text in turns if role == "assistant")
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        got = found.pop(conv)
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(replies), digest(replies))
    assert not found


def test_every_reply_has_an_example_with_its_context(spark):
    rows = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT), (-7, 2, "user", "more"), (-7, 3, "assistant", ""), (-7, 4, "user", "")]
    examples = chat_format.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [(r["turns"], r["loss_chars"], r["is_last"]) for r in examples] == [(2, 21, False), (4, 0, False), (5, None, True)]
    for before, after in itertools.pairwise(examples):
        assert after["formatted"].startswith(before["formatted"])
    first = examples[0]
    masked = first["formatted"][first["loss_start"] : first["loss_start"] + first["loss_chars"]]
    assert masked == "\\b\\h Assistant: \\e ok"
    # Nothing said can be taken for a turn's mark.
    assert [r["formatted"].count("</turn>") for r in examples] == [2, 4, 5]
    assert [r["formatted"].count("###") for r in examples] == [2, 4, 5]


@pytest.mark.parametrize("seed", range(3))
def test_escapes_are_reversible(spark, seed):
    dice = random.Random(seed)
    parts = ["\\", "\\b", "\\e", "\\h", "\\c", "</turn>", "</turn", "###", "#", ":", " ", "\n", "b", "é", "user: "]
    said = ["".join(dice.choices(parts, k=dice.randrange(8))) for _ in range(400)]
    rows = [(k, 0, said[k], said[-k - 1]) for k in range(400)]
    whole = chat_format.examples(spark.createDataFrame(rows, SCHEMA))
    read = whole.select("conv_id", F.explode(chat_format.read_back(F.col("formatted"))).alias("t")).select("conv_id", "t.*")
    assert Counter(map(tuple, read.collect())) == Counter((k, role, text) for k, _, role, text in rows)


def test_formatting_stays_native(spark):
    plan = LLM_QUERIES["op12_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    # Examples are read back where they are made.
    assert plan.count("Exchange") == 1
    assert chat_format.digests(chat_format.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_formatting_with_clashing_columns(spark):
    names = "example long, turns string, formatted string, key long, n long, who string, said string"
    rows = [(1, "x", "y", 5, 1, "user", "Hi"), (1, "x", "y", 5, 2, "assistant", "Ho")]
    found = chat_format.examples(spark.createDataFrame(rows, names), "key", "n", "who", "said").collect()
    assert [(r["key"], r["formatted"]) for r in found] == [(5, "### user: Hi</turn>\n### assistant: Ho</turn>\n")]


# --- fill in middle --------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 4096])
def test_cuts_match_a_scan(size):
    dice = random.Random(size)
    texts = ["", " ", "a", "日", *("".join(dice.choices(" \t\nab é日😀\x1c\xa0", k=dice.randrange(80))) for _ in range(300))]
    for text in texts:
        units, blocks = UNIT.findall(text), fill_in_middle.Blocks(text.encode(), size)
        assert (blocks.units, blocks.points) == (len(units), len(text))
        for k in range(len(units) + 1):
            start = "".join(units[:k])
            assert blocks.cut(k) == (len(start.encode()), len(start))


def arranged_by_hand(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, len(units), "plain", None, None, text
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, i), (i, j), (j, None)))
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, len(units), form, len(prefix), len(middle), output


def test_fill_in_middle_matches_brute_force(spark):
    dice = random.Random(8)
    rows = [(None, "no key at all"), (None, None), (1, ""), (2, " \n "), (3, "word " * 60_000), (3, "word " * 60_000), (4, "x" * 50_000)]
    parts = ["<", "P>", "S", "<M", ">", " ", "é", "日本", "\n", "word "]
    rows += [(k, "".join(dice.choices(parts, k=dice.randrange(30)))) for k in range(10, 600)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, key string, output string")
    made = fill_in_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    shown = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert Counter(map(tuple, shown)) == Counter(arranged_by_hand(*r) for r in rows)
    again = made.select(F.expr("coalesce(text, '')").alias("text"), fill_in_middle.restored(F.col("output"), F.col("form")).alias("again"))
    assert again.where("text <> again").count() == 0
    assert {r["form"] for r in shown} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0

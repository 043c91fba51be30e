"""Chat formatting against a fold of one event after another, and exact round trips."""

import hashlib
import random

from pyspark.sql import functions as F

from cobbler.llm import chat, queries

from .conftest import SF

LOG = "conv_id long, seq long, slot long, kind string, role string, text string"
NASTY = ["", "### ", "</turn>", "</turn>\n", "\\", "\\b", "\\h", "\\e", "\\\\e", "</tu### rn>", "### assistant: x</turn>\n### user: y", "a: b", "<", "</turn",
         "\n", "é😀", "### ### ", "\\### Assistant: </turn> ok", "  </turn", "</</turn>turn>"]


def one_by_one(events):
    """conv -> {slot: (role, text)}, applying each event in turn."""
    out = {}
    for conv, seq, slot, kind, role, text in sorted(set(events), key=lambda e: (e[0] is not None, e[0] or 0, e[1] or 0)):
        if seq is None or kind not in ("message", "delta", "edit", "regenerate"):
            continue
        state, roles = out.setdefault(conv, ({}, {}))
        if kind in ("edit", "regenerate"):
            for later in [s for s in state if s > slot]:
                del state[later]
        state[slot] = (state.get(slot, "") if kind == "delta" else "") + (text or "")
        if role is not None:
            roles[slot] = role
    return {c: {s: (roles.get(s, ""), t) for s, t in sorted(state.items())} for c, (state, roles) in out.items() if state}


def folded(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["conv_id"], {})[r["slot"]] = (r["role"], r["text"])
    return {c: dict(sorted(v.items())) for c, v in out.items()}


def random_log(rng, convs=40):
    rows = []
    for c in range(convs):
        n, slots = 0, rng.randrange(1, 6)
        for _ in range(rng.randrange(1, 40)):
            n += rng.randrange(1, 4)
            kind = rng.choices(["message", "delta", "edit", "regenerate", "seen"], [4, 8, 1, 1, 1])[0]
            rows.append((c, n, rng.randrange(slots), kind, rng.choice([None, "user", "assistant", "system"]), rng.choice([*NASTY, None, "word "])))
    rows += rng.sample(rows, 30) + [(None, 1, 0, "message", "user", "no id"), (0, None, 0, "message", "user", "no seq"), (1, 10**6, 9, None, "user", "x")]
    rng.shuffle(rows)
    return rows


def test_fold_equals_one_event_after_another(spark):
    rows = random_log(random.Random(3))
    got = folded(chat.fold(spark.createDataFrame(rows, LOG)))
    assert got == one_by_one(rows)
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0


def test_edits_and_regenerations(spark):
    rows = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", None), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "y"),
            (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "hello"), (1, 7, 2, "message", "user", "more"),
            (2, 1, 0, "message", "user", "q"), (2, 2, 1, "message", "assistant", "a"), (2, 3, 0, "edit", None, "q2"),
            (3, 1, 0, "message", "user", "q"), (3, 2, 1, "message", "assistant", "a"), (3, 3, 0, "edit", "system", "q2"), (3, 4, 1, "delta", None, "b")]
    assert folded(chat.fold(spark.createDataFrame(rows, LOG))) == {
        1: {0: ("user", "hi"), 1: ("assistant", "hello"), 2: ("user", "more")}, 2: {0: ("user", "q2")}, 3: {0: ("system", "q2"), 1: ("assistant", "b")}}


def test_render_round_trip(spark):
    rng = random.Random(8)
    turns = [(c, s, rng.choice([*NASTY, "assistant", "user"]), "".join(rng.choices([*NASTY, "plain "], k=rng.randrange(4)))) for c in range(60) for s in range(rng.randrange(1, 7))]
    turns.append((60, 0, "assistant", "x" * 3_000_000 + "</turn>"))
    df = chat.render(spark.createDataFrame(turns, "conv_id long, slot long, role string, text string"))
    rows = df.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.learned(F.col("segments")).alias("learned")).collect()
    assert len(rows) == 61
    for r in rows:
        want = [(role, text) for c, _, role, text in turns if c == r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == want
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["learned"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("</turn>") == len(want) and not any("### " in s["text"] or "</turn>" in s["text"] for s in r["segments"] if s["loss"])


def test_streamed_log_gives_the_stored_rows(spark):
    stored = spark.read.parquet(f"{SF}/conversations.parquet")
    log = chat.log_of(stored)
    assert log.filter("kind = 'delta'").count() > 0 and log.groupBy("conv_id", "seq").count().filter("count > 1").count() == 0
    want = {}
    for r in sorted(stored.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: list(v.values()) for c, v in folded(chat.fold(log)).items()} == want


def test_log_of_edge_rows(spark):
    """Null ids, turns, roles and texts, repeated rows, ties, clashing names, an empty table."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, None, "assistant", "first" * 500), (1, 3, None, "no role"),
            (None, 1, "user", "no id"), (2, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], "conv_id int, turn int, role string, text string, slot int, seq int, kind int, turns int")
    got = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in
           chat.format_conversations(chat.log_of(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert got == {1: [("assistant", "first" * 500), ("assistant", ""), ("user", "a"), ("user", "a"), ("", "no role")],
                   None: [("user", "no id")], 2: [("assistant", "")]}
    assert chat.format_conversations(chat.log_of(df.limit(0))).count() == 0


def test_one_large_conversation(spark):
    """A conversation with most rows: every turn is there once, in order."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN 5 ELSE id END AS conv_id", "id AS turn",
                                      "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id) AS text")
    r, = chat.format_conversations(chat.log_of(df)).filter("conv_id = 5").select(chat.read_back(F.col("formatted")).alias("back")).collect()
    assert [t["text"] for t in r["back"]] == [f"text {k}" for k in range(6000) if k % 3]


def test_query_has_no_python_and_the_control_conversation(spark):
    df = queries.op12_chat_format(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    r, = df.filter("conv_id = -7").collect()
    text = "\\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

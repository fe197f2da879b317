import hashlib
import random
import re

from skyquilt.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "[+]", "\\", "\\[+]", "[", "<s", "[\\+]", "\\\\", "", None, "a\nb", "[:]", "é[/INST", "$1", "[INST", "<", "</s"]


def test_round_trip(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        turns = [(t, rng.choice(["user", "assistant", "system", None, "[:]\\"]), "".join(rng.choice(NASTY) or "" for _ in range(rng.randint(0, 4))) or rng.choice(NASTY)) for t in range(rng.randint(1, 7))]
        want[c] = [(r or "", x or "") for _, r, x in turns]
        rows += [(c, t, r, x, "q", "z") for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns string")
    for r in chat.format_chats(df).withColumn("back", chat.parse(chat.F.col("formatted"))).collect():
        assert [(x.role, x.text) for x in r.back] == want[r.conv_id]
        said = [t for role, t in want[r.conv_id] if role == "assistant"]
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert [re.sub(r"(?s)\\(.)", r"\1", t) for t in spans] == said


def test_digests(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b"), (1, 2, "assistant", None), (1, 3, "user", "x" * 100000), (2, 5, "user", "late"), (2, 1, "assistant", "早い")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    assert set(got) == {1, 2, -1}
    for c, r in got.items():
        own = sorted(x[1:] for x in rows if x[0] == c)
        loss = "".join(t or "" for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b or ''}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert got == {None: "[INST][:][+][/INST]", 7: "[INST]user[:]a[+]a[/INST]"}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """More turns than a block of running totals, and runs of one role."""
    rows = [(1, i, "assistant" if i % 7 < 3 else "user", f"t{i}" * (i % 5)) for i in range(2000)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == [t for *_, r, t in rows if r == "assistant"]
    assert got.formatted.startswith("<s>assistant[:][+]t1[+]t2t2</s>[INST]user[:]t3t3t3[+]")

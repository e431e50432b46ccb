"""Every perspective against a plain rendering and the DuckDB query."""

from tillpoint.llm import chat
from tillpoint.llm.queries import ORACLE, op2

from conftest import SMALL  # noqa: F401


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, "unknown" if r is None else r, x or "", t))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda s: s[:4])
        for p in sorted({r for _, _, r, _, _ in turns} - {"system"}):
            at = 0
            for n, (_, _, r, x, t) in enumerate(turns):
                who = "system" if r == "system" else "assistant" if r == p else f"user:{r}"
                head = f"<|{who}|>\n"
                seg = f"{head}{x}\n<|end|>\n"
                own = who == "assistant"
                out.append((c, p, n, t, who, seg, at, len(seg), at + len(head) if own else None, len(seg) - len(head) if own else 0))
                at += len(seg)
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_conversations(spark, con):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = op2(spark, SMALL)
    assert key(got.collect()) == key(brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    want = con.sql(ORACLE["op2_chat_perspectives"])
    assert sorted(want.columns) == sorted(got.columns)
    assert key(got.select(*want.columns).collect()) == key(want.fetchall())


def test_odd_turns(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi é☃"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2, "ann", ""),
            (1, None, "cid", "first"), (1, 700, None, "late"), (1, 300, "ann", "x" * 50_000), (None, 1, "ann", "lost"),
            (None, 1, "bob", "found"), (2, 1, "system", "alone"), (3, -5, "ann", "minus")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _block string, perspective int")
    assert key(chat.rotate(df).collect()) == key(brute(rows))


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []

import hashlib

import numpy as np

from graphloom.llm import chat_format as m

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(seed=0):
    r = np.random.default_rng(seed)
    bits = ["hello", "&lt;", "<turn>", "</turn>\n", "\n", "&amp;", "\\", "😀", "<", "&", "&nl;", " "]
    out = []
    for c in range(30):
        for t in range(int(r.integers(1, 40))):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant", "to\nol"][int(r.integers(0, 3))]
            out.append((c, t, role, "".join(r.choice(bits, int(r.integers(0, 120))))))
    return out + [(50, 0, None, None), (50, 1, "assistant", ""), (51, 3, "assistant", "x " * 5000), (None, 1, "user", "a"), (52, 1, "user", "same"), (52, 1, "user", "same")]


def brute(data):
    convs = {}
    for c, t, role, text in data:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_reads_back_every_turn(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as window", "2 as seq").write.parquet(f"{tmp_path}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    want = brute([*data, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in m.query(spark, str(tmp_path)).collect()}
    assert got == want


def test_windows_keep_to_the_budget(spark):
    data = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], f"w{t} " * 30) for t in range(1, 60)]
    got = m.windows(spark.createDataFrame(data, SCHEMA)).orderBy("window").collect()
    assert len(got) > 5 and all(w.n_tokens <= m.BUDGET for w in got)
    assert all(w.formatted.startswith("<turn>system\nbe kind</turn>\n") for w in got)
    assert got[0].n_repeated == 0 and all(2 <= w.n_repeated <= 3 for w in got[1:])
    for w in got:
        texts = [w.formatted[s.start : s.end] for s in w.loss_spans]
        assert all(t.startswith("w") for t in texts)


def test_only_turns_too_large_alone_pass_the_budget(spark):
    r = np.random.default_rng(4)
    data = []
    for c in range(60):
        system = int(r.choice([0, 3, 120, 300, 500, 700]))
        if system:
            data.append((c, 0, "system", "s " * system))
        data += [(c, t, ("user", "assistant")[t % 2], f"w{t} " * int(r.choice([0, 1, 20, 90, 200, 300, 480, 600]))) for t in range(1, int(r.integers(2, 40)))]
    got = m.windows(spark.createDataFrame(data, SCHEMA)).collect()
    large = 0
    for w in got:
        turns = w.formatted.count(m.OPEN)
        with_system = w.formatted.startswith("<turn>system\n")
        if w.n_tokens > m.BUDGET:
            assert turns - with_system <= 1
            large += 1
    assert large > 20 and len(got) - large > 100
    said = sum(w.formatted.count(m.OPEN) - w.n_repeated for w in got)
    assert said == len(data)


def test_two_turns_that_fit_alone_get_two_windows(spark):
    data = [(1, 0, "user", "a " * 246), (1, 1, "assistant", "b " * 496), (1, 2, "user", "c " * 120), (1, 3, "assistant", "d " * 300)]
    got = m.windows(spark.createDataFrame(data, SCHEMA)).orderBy("window").collect()
    assert [w.n_tokens for w in got] == [250, 500, 124, 124 + 304]


def test_parts_are_laid_out_apart(spark, monkeypatch, tmp_path):
    """Every part begins with a window of its own, with the system turn and without history; nothing is lost."""
    monkeypatch.setattr(m, "PART_TURNS", 7)
    data = [(1, t, "system" if t in (-20, 3) else ("user", "assistant")[t % 2], f"w{t} " * (t % 40)) for t in range(-20, 60)] + [(2, t, "user", "x") for t in range(20)]
    data += [(c, t, role, text) for c, t, role, text in rows(3) if c is not None]
    got = m.windows(spark.createDataFrame(data, SCHEMA)).orderBy("conv_id", "window").collect()
    own = [w for w in got if w.conv_id == 1]
    assert all(w.formatted.startswith("<turn>system\n") for w in own) and not any(w.conv_id == 2 and "system" in w.formatted for w in got)
    opens = [w for k, w in enumerate(own) if k == 0 or w.window >> 32 != own[k - 1].window >> 32]
    assert sum(w.formatted.count(m.OPEN) - w.n_repeated for w in own) == sum(c == 1 for c, *_ in data)
    parts = -(-sum(c == 1 for c, *_ in data) // 7)
    assert len(opens) == parts and [w.n_repeated for w in opens] == [0] + [1] * (parts - 1)
    assert all(w.n_tokens <= m.BUDGET for w in own)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    want = brute([*data, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in m.query(spark, str(tmp_path)).collect()} == want


def test_parts_follow_positions_whatever_the_numbers(spark, monkeypatch):
    """Turn numbers far apart, null or all the same give the windows that dense numbers give."""
    monkeypatch.setattr(m, "PART_TURNS", 16)
    for size in (14, 50):
        numbers = {1: lambda t: t, 2: lambda t: 2000 * t, 3: lambda t: 5, 4: lambda t: None, None: lambda t: t - 10**12}
        data = [(c, f(t), "system" if t == 0 else "user", f"{'A' if t == 0 else 'w'}{t:03} " * 30) for c, f in numbers.items() for t in range(size)]
        data = [(c, n, "system" if c not in (1, 2, None) else r, x) for c, n, r, x in data]
        got = {}
        for w in m.windows(spark.createDataFrame(data, SCHEMA)).orderBy("window").collect():
            got.setdefault(w.conv_id, []).append((w.formatted.replace("system", "user"), w.n_repeated, w.n_tokens))
        assert len(got) == 5 and all(v == got[1] for v in got.values())
        assert sum(n for _, n, _ in got[1]) > len(got[1])


def test_empty(spark):
    assert m.windows(spark.createDataFrame([], SCHEMA)).count() == 0

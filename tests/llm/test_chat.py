"""Long dialogues in parts."""

from millrace.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def rendered(rows, speaker):
    out, spans = "", []
    for _, role, text in rows:
        out += f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == speaker else 'user name=' + role}\n"
        if role == speaker:
            spans.append(f"{len(out)}-{len(out) + len(text)}")
        out += f"{text}<|im_end|>\n"
    return out, ",".join(spans)


def test_every_participant_in_every_part(spark):
    talk = [(0, "system", "rules"), (1, "guest", "hello"), *((i, "ab"[i % 2], f"text {i} \U0001f600") for i in range(2, 25)), (25, "system", "more"), *((i, "ab"[i % 2], f"text {i}") for i in range(26, 36))]
    odd = [(None, None, "x")] * 11 + [(5, "a", "same")] * 12
    rows = [(1, *t) for t in talk] + [(None, *t) for t in odd] + [(2, 5000, "a", "alone")]
    got = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.perspectives(spark.createDataFrame(rows, TURNS), part_turns=10).collect()}
    whole = {1: talk, None: sorted([(t or -1, r or "unknown", x) for t, r, x in odd]), 2: [(5000, "a", "alone")]}
    expected = {}
    for conv, turns in whole.items():
        for at in range(0, len(turns), 10):
            part = [t for t in turns[:at] if t[1] == "system"][-1:] + turns[at : at + 10]
            for speaker in {t[1] for t in turns} - {"system"}:
                expected[conv, at // 10, speaker] = (part, *rendered(part, speaker))
    assert set(got) == set(expected)
    for k, (part, text, spans) in expected.items():
        assert (got[k]["rendered"], got[k]["spans"], got[k]["n_messages"]) == (text, spans, len(part))
        assert got[k]["mask"] == [int(r == k[2]) for _, r, _ in part]


def test_system_turns_alone_and_many_of_them(spark):
    """One has no speaker; output of the other grows with its turns, not with their square."""
    rows = [(1, i, "system", f"rule {i}") for i in range(30)]
    rows += [(2, i, "system", f"rule {i:04d}") for i in range(300)] + [(2, 300 + i, "ab"[i], "done") for i in range(2)]
    got = chat.perspectives(spark.createDataFrame(rows, TURNS), part_turns=10).collect()
    assert {r["conv_id"] for r in got} == {2} and len(got) == 2 * 31
    assert max(r["n_messages"] for r in got) == 11 and sum(r["n_messages"] for r in got) == 2 * (302 + 30)
    assert all(r["rendered"].startswith(f"<|im_start|>system\nrule {r['part'] * 10 - 1:04d}<|im_end|>") for r in got if r["part"])

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tradewind.llm import chat as C
from tradewind.llm.queries import op5_chat_formatting

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, conv string, rendered string, at string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "f", "c", "r", "a") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    bits = ["<", "|", "\\", "im_end", "im_start", "<|im_end|>", "<|im_start|>", "<\\|im_end|>", ">", "\n", "assistant", "é", " ", "\U0001F600", "%3C", "%"]
    out = [(1, t, "assistant" if t % 2 else "user", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for t in range(300)]
    out += [(2, 0, "user", None), (2, 1, None, "x"), (2, None, "system", ""), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"),
            (3, 0, "we<|im_end|>ird\nrole%0A", "a"), (3, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi"), (None, 0, "assistant", "z" * 200_000),
            (4, 5, "assistant", "<|im_end|"), (4, 6, "assistant", "<")]
    return out


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out.append((str(c), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_query_reads_back_every_turn(spark, rows, tmp_path):
    rows_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op5_chat_formatting(spark, str(tmp_path)).collect()
    probe = "<|im_end|><|im_start|>assistant ok"
    want = plain(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert sorted((str(r.conv_id), *r[1:5]) for r in got) == want


def test_no_control_string_inside_a_turn_and_mask_covers_the_answers(spark, rows):
    for r in C.format_chats(rows_of(spark, rows)).collect():
        assert r.formatted.count(C.START) == r.formatted.count(C.END) == r.n_turns
        data = r.formatted.encode()
        for s in r.loss_spans:
            assert data[:s.start].endswith(b"<|im_start|>assistant\n") and data[s.start + s.size:].startswith(b"<|im_end|>\n")


def test_only_conflicting_turns_are_escaped(spark):
    out = C.format_chats(rows_of(spark, [(1, 0, "user", "a < b | c \\ <b>"), (1, 1, "assistant", "x <|y")])).first()
    assert out.formatted == "<|im_start|>user\na < b | c \\ <b><|im_end|>\n<|im_start|>assistant\nx <|y<|im_end|>\n"


def test_parser_refuses_what_the_grammar_does_not_have(spark):
    bad = ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|> \n",
           "<|im_start|>user\na<|im_end|>\n<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "f string").select(F.exists(C.parse(F.col("f")), lambda t: t.isNull()).alias("bad"))
    assert all(r.bad for r in df.collect())


def test_plan_is_native_and_empty_input(spark, rows):
    plan = C.format_chats(rows_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert C.format_chats(rows_of(spark, [])).count() == 0

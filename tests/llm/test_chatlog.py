import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chatlog
from tessera.llm.queries import op12_chat_format
from tests.llm import helpers as H

CONV = "conv_id long, turn long, role string, text string"
EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _brute(convs):
    """{conv_id: [(role, text)]} to digests."""
    out = {}
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), _sha(said))
    return out


def _digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_escape_is_reversible_and_leaves_no_control():
    rng = random.Random(1)
    bits = [*chatlog.CONTROLS, "&", "&amp;", "&lt;", "&lsqb;", "&newline;", "<", "[", "|", "im_end|>", "\n", "é", "a", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        out = chatlog.escape(text)
        assert chatlog.unescape(out) == text and not any(c in out for c in chatlog.CONTROLS)
        role = rng.choice(["user", "assistant", "a\nb", text])
        assert list(chatlog.parse(chatlog.render_turn(role, text)[0] * 2)) == [(role, text)] * 2


def test_whole_table(spark):
    rows = H.table(spark, "conversations").collect()
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    out = op12_chat_format(spark, H.SF)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert out.count() == len(convs) and _digests(out) == _brute(convs)
    marks = sum(len("<|im_start|>" + r + "\n<|im_end|>\n") for r, _ in convs[-7])
    assert [r.formatted_chars for r in out.collect() if r.conv_id == -7] == [marks + 2 * (21 + 2 * 5 + 3)]


@pytest.mark.parametrize("segment_chars", [1, 60, 1 << 20])
def test_fold_of_random_logs(spark, segment_chars):
    """Streamed deltas, edits and regenerations, one conversation with a third of all events."""
    rng, rows, want = random.Random(segment_chars), [], {}
    for k in range(300):
        conv = 0 if k % 3 == 0 else rng.randrange(1, 40)
        turn = len(want.setdefault(conv, []))
        role = rng.choice(["user", "assistant", "system", "x<|im_end|>\ny"])
        text, seq = rng.choice(["", "Hi & [INST]"]), 0
        rows.append((conv, turn, seq, "message", role, text))
        for _ in range(rng.randrange(6)):
            seq += rng.randrange(1, 4)
            kind, new = rng.choice(["delta", "delta", "edit", "regenerate", None]), rng.choice(["a", "<s>é", "", None])
            rows.append((conv, turn, seq, kind, None, new))
            text = (new or "") if kind in ("edit", "regenerate") else text + (new or "")
        want[conv].append((role, text))
    rng.shuffle(rows)
    segments = chatlog.format_log(spark.createDataFrame(rows, EVENT), ("seq",), segment_chars).cache()
    assert segments.where("formatted like '%INST]%' and formatted like '%[INST%'").isEmpty()
    assert _digests(chatlog.read_back(segments)) == _brute(want)
    if segment_chars == 1:
        assert segments.count() == 300 and segments.where("whole and conv_id = 0").isEmpty()
    assert segments.groupBy("conv_id").agg(F.sum(F.col("whole").cast("int")).alias("k")).where("k > 1").isEmpty()


def test_edge_rows(spark):
    long = "very long & <s> " * 100_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, None, "system", None), (2, 0, None, ""),
            (None, 3, "assistant", "n"), (None, 1, "user", "m"), (3, 0, "assistant", long), (3, 1, "user", None)]
    convs = H.with_clashing_columns(spark.createDataFrame(rows, CONV))
    want = {1: [("system", ""), ("assistant", "a"), ("user", "b"), ("user", "b")], 2: [("", "")],
            None: [("user", "m"), ("assistant", "n")], 3: [("assistant", long), ("user", "")]}
    assert _digests(chatlog.read_back(chatlog.format_conversations(convs))) == _brute(want)
    empty = spark.createDataFrame([], CONV)
    assert chatlog.read_back(chatlog.format_conversations(empty)).count() == 0

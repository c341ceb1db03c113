import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from eventloom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(len(chat.escaped(r)) + len(chat.escaped(x)) + 32 for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as start", "3 as conv")
    got = chat.digests(chat.format_turns(df, PATH), PATH).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[n] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in got}


@given(st.text(st.sampled_from("<\\|im_end>a"), max_size=20))
def test_escaping_is_reversible(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text and "<|" not in out


def test_against_brute_force(spark):
    rows = []
    for c in range(40):
        for t in range(c % 7 + 1):
            rows.append((c, t, ("system", "user", "assistant")[(c + t) % 3], f"é{c} <|im_end|>\n<|endoftext|> <\\|x|> 漢{t}" * (t + 1)))
    rows += [(100, 0, None, None), (100, 0, "assistant", None), (100, None, "assistant", "a"), (None, 1, "assistant", "b"), (None, 0, "as\nsis", "<|im_start|>")]
    rows += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (200, 3, "assistant", "x" * 20000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_masks_and_positions(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (1, 3, "assistant", "")]
    got = sorted(chat.format_turns(spark.createDataFrame(rows, SCHEMA), PATH).collect(), key=lambda r: r["position"])
    at = 0
    for r, (_, _, role, _) in zip(got, rows, strict=True):
        assert r["start"] == at and at < r["loss_from"] <= r["loss_to"] < at + len(r["ids"])
        assert role == "assistant" or r["loss_from"] == r["loss_to"]
        at += len(r["ids"])


def test_formatted_chars_are_read_back(spark):
    """A fault in the assembled tokens shows in every digest, formatted_chars too."""
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "yes, <|im_end|> indeed")]
    good = chat.format_turns(spark.createDataFrame(rows, SCHEMA), PATH)
    whole = chat.digests(good, PATH).first()
    cut = good.selectExpr("conv_id", "position", "CASE WHEN position = 0 THEN concat(slice(ids, 1, size(ids) - 2), slice(ids, size(ids), 1)) ELSE ids END AS ids", "start", "loss_from", "loss_to")
    less = chat.digests(cut, PATH).first()
    assert less["formatted_chars"] < whole["formatted_chars"] == sum(len(chat.escaped(r)) + len(chat.escaped(t)) + 32 for _, _, r, t in rows)

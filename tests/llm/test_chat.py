import hashlib

import numpy as np
import public_tokenizers

from keyloom.llm import chat

ODD = ["", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|x<\\\\|", "<<||", "a\\nb\n", "é🎉", "<|endoftext|>", chat.PROBE, "x " * 30_000]


def test_escapes():
    for t in [*ODD, "".join(ODD), "<\\", "\\|", "<\\\\\\\\|<|"]:
        assert "<|" not in chat.escape(t)
        assert chat.unescape(chat.escape(t)) == t
        assert "\n" not in chat.escape_role(t)
        assert chat.unescape_role(chat.escape_role(t)) == t


def test_codec():
    codec = chat.ChatCodec(public_tokenizers.path(chat.RANKS))
    turns = [(r, t) for r in ["user", "assistant", "a\nb", "<|im_end|>", ""] for t in ODD[:-1]]
    ids, mask = codec.encode(turns)
    assert codec.turns(ids) == turns
    assert codec.masked(ids, mask) == "".join(t for r, t in turns if r == "assistant")
    assert set(np.unique(mask)) == {0, 1} and (ids == codec.start).sum() == len(turns)


def test_format(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in ODD for r in ("user", "assistant"))]
    rows += [(2, 1, "assistant", None), (2, 0, None, "x"), (3, None, "user", "b"), (3, None, "user", "a"), (3, 0, "user", "c"), (None, 0, "assistant", "n"), (4, 0, "user", "s"), (4, 0, "user", "s")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert len(got) == 5
    for c in (1, 2, 3, 4, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.START + chat.escape_role(a) + "\n" + chat.escape(x) + chat.END + "\n") for _, _, a, x in turns)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0

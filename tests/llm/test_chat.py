"""Round trips of texts that look like the template, and masks that hold to the turn."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from channelweave.llm.chat import END, MIDDLE, START, escape, format_conversations, parse, read_back, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
NASTY = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", "a", "é", "日", "😀", "\n", " ", START, END, MIDDLE]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=4))
def test_escaping(turns):
    for role, text in turns:
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    formatted, spans = render(turns, frozenset(r for r, _ in turns))
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def test_format(spark):
    texts = ["", "x", START, f"{END}{START}assistant ok", "<", "|im_end|>", "<\\|", "é日😀 \n\n", " lead", "trail \n", "\n\n", "long " * 50_000, None]
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], texts[(c * 3 + t) % len(texts)], 0) for c in range(30) for t in range(c % 7 + 1)]
    rows += [(None, 1, "assistant", "null id", 0), (99, None, "assistant", "second", 0), (99, None, "assistant", "first", 0), (98, 1, "user", "same", 0), (98, 1, "user", "same", 0)]
    formatted = format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {r.conv_id: r for r in read_back(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(formatted) == len(got) == len({r[0] for r in rows})
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, r or "", x or "") for k, t, r, x, _ in rows if k == c), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))
    for r in formatted:
        assert len(r.input_ids) == len(r.starts) == len(r.ends) == len(r.loss_mask)
        control = [i for i, (a, b) in enumerate(zip(r.starts, r.ends, strict=True)) if r.formatted[a:b] in (START, END, MIDDLE)]
        assert not any(r.loss_mask[i] for i in control) and len({r.input_ids[i] for i in control}) == 3


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []

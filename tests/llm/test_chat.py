"""Chat formatting: round trip, and the layout against a trie walked in Python."""

import hashlib
import random

import public_tokenizers
import pytest

from keystrata.llm import chat
from keystrata.llm.tokenizing import tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")

KIND = "conv_id bigint, turn bigint, role string, text string, start bigint, `node` string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 5, "n") for r in rows], KIND).repartition(3)


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


CONTROL = r"\### Assistant: </turn> ok"
ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
    (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL), (None, 0, "user", "lost"), (4, None, "assistant", None), (4, 1, None, ""), (5, 0, "a\nb#\\<", "\\n \\h ## <</turn>\n### user\n"),
    (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "assistant", "x" * 5000), (8, 0, "user", "hi"), (8, 1, "assistant", "hello"), (8, 2, "user", "more"),
]


@pytest.mark.parametrize("text", ["", "\\", "\\\\h", CONTROL, "###", "</turn>\n", "\n", "\\n", "a#<\\"])
def test_escapes_are_reversible_and_safe(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and "#" not in shown and "<" not in shown
    assert chat.parsed(chat.formatted(text, text)) == (text, text)


def test_read_back(spark, tmp_path):
    chat.write_tree(made(spark, ODD), f"file://{tmp_path}/c", BYTES)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_tree(spark, f"file://{tmp_path}/c").collect()}
    assert got == expected(ODD)


def test_layout_is_depth_first_and_attends_to_ancestors(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 6)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", draw.choice("ab") * draw.randint(1, 2)))
    chat.write_tree(made(spark, rows), f"file://{tmp_path}/c", BYTES)
    nodes = {r["start"]: r for r in spark.read.parquet(f"file://{tmp_path}/c/nodes").collect()}
    paths = {}
    for r in spark.read.parquet(f"file://{tmp_path}/c/paths").collect():
        paths.setdefault(r["conv"], []).append((r["depth"], r["start"]))
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append(chat.formatted(role, text))
    distinct = {tuple(t[: i + 1]) for t in talks.values() for i in range(len(t))}
    assert len(nodes) == len(distinct)
    at = token_at = 0
    for start in sorted(nodes):
        assert start == at and nodes[start]["token_start"] == token_at
        at += nodes[start]["size"]
        token_at += nodes[start]["n_tokens"]
    for conv, path in paths.items():
        starts = [s for _, s in sorted(path)]
        assert [nodes[s]["turn"] for s in starts] == talks[conv] and starts == sorted(starts)
        seen, position = set(), 0
        own, token_seen, token_position = tokenizer(BYTES), set(), 0
        for s in starts:
            r = nodes[s]
            assert r["ids"] == own.encode(r["turn"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["token_position"] == token_position
            assert {c for a, b in zip(r["token_ancestors_from"], r["token_ancestors_to"]) for c in range(a, b)} == token_seen
            token_position += r["n_tokens"]
            token_seen |= set(range(r["token_start"], r["token_start"] + r["n_tokens"]))
            held = {c for a, b in zip(nodes[s]["ancestors_from"], nodes[s]["ancestors_to"]) for c in range(a, b)}
            assert held == seen and nodes[s]["position"] == position
            position += nodes[s]["size"]
            seen |= set(range(s, s + nodes[s]["size"]))
    # depth-first: between a node and any descendant lie only its descendants
    ends = {}
    for path in paths.values():
        starts = [s for _, s in sorted(path)]
        for i, s in enumerate(starts):
            ends.setdefault(s, set()).update(starts[i:])
    for s, own in ends.items():
        inside = {t for t in nodes if s <= t <= max(own)}
        assert inside == own


def test_nothing(spark, tmp_path):
    chat.write_tree(made(spark, []), f"file://{tmp_path}/c", BYTES)
    assert chat.read_tree(spark, f"file://{tmp_path}/c").count() == 0

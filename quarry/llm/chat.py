r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\ntext<|im_end|>\n`` for each turn and read again by a
deterministic parser. Turns that don't come back as they were are escaped (one more backslash in each
``<|``, ``<\|``, ``<\\|`` ...; roles also mark backslashes and line feeds), and the rendering is repeated
until what is read is what was written.

Rows: turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own. A null text
or role is empty, a null conv_id is a conversation of its own. An empty table gives no rows. One conversation is
held in memory at a time. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_CONTROL = re.compile(r"<\|im_(?:start|end)\|>")
_ROLE = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


class NotParsed(ValueError):
    """The text doesn't follow the grammar."""


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """role, text and the place (start, end) of the text as written, for each turn."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None or _CONTROL.search(m[1]) or _CONTROL.search(m[2]):
            raise NotParsed(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def _write(turns: list[tuple[str, str]], roles: set[int], texts: set[int]) -> str:
    return "".join(
        f"{START}{escape_role(r) if i in roles else r}\n{escape(t) if i in texts else t}{END}\n" for i, (r, t) in enumerate(turns)
    )


def _alone(turn: tuple[str, str], role: bool, text: bool) -> tuple[bool, bool]:
    """Whether role and text come back when the turn is rendered by itself."""
    probe = lambda t, r, x: (lambda s: parse(s))(_write([t], {0} if r else set(), {0} if x else set()))
    ok = []
    for t, r, x in (((turn[0], ""), role, False), (("", turn[1]), False, text)):
        try:
            ok.append([y[:2] for y in probe(t, r, x)] == [t])
        except NotParsed:
            ok.append(False)
    return ok[0], ok[1]


def render(turns: list[tuple[str, str]]) -> str:
    """The text of a conversation, escaped no more than the round trip needs."""
    roles: set[int] = set()
    texts: set[int] = set()
    for _ in range(3):
        text = _write(turns, roles, texts)
        try:
            if [x[:2] for x in parse(text)] == turns:
                return text
        except NotParsed:
            pass
        for i, turn in enumerate(turns):
            role_ok, text_ok = _alone(turn, i in roles, i in texts)
            if not role_ok:
                roles.add(i)
            if not text_ok:
                texts.add(i)
    raise NotParsed("escaping doesn't make the round trip")


def loss_spans(text: str) -> list[tuple[int, int]]:
    """Places of the assistant's texts in a rendered conversation: what a loss mask covers."""
    return [(a, b) for role, _, a, b in parse(text) if role == LOSS_ROLE]


def _formatted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [render([(x["role"], x["text"]) for x in turns]) for turns in batch["turns"]]
        yield pd.DataFrame({"conv_id": batch["conv_id"], "formatted": texts, "spans": [[list(x) for x in loss_spans(t)] for t in texts]})


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (start and end of each loss-masked part): one row for each conversation."""
    turns = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turns.alias("t"))
    grouped = grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInPandas(_formatted, "conv_id long, formatted string, spans array<array<int>>")


def _digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for conv_id, text, spans in zip(batch["conv_id"], batch["formatted"], batch["spans"]):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in spans)
            rows.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and their loss masks say."""
    return formatted.mapInPandas(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

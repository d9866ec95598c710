"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is <turn>, the role, <says>, the text and </turn>. Backslashes are doubled
and a backslash is put into control strings inside roles and texts, so that markers never come from data and all is read
back exactly. The rendering is encoded once, with offsets; markers are added to the tokenizer as plain tokens, so no token
crosses one. The turns' spans and the tokens' spans are both sorted: a binary search finds each assistant text's tokens,
whose spans, cut to the turn, carry the loss.

A conversation's turns come together in one task, as one training example has to; conversations aren't grouped further.
Turns are ordered by (turn, role, text); repeated rows are repeated turns. Null texts and roles count as empty; each row without
conv_id is a conversation of its own; an empty table gives an empty result; further columns are left behind. Very long texts
are rendered whole; a batch holds some 4 MB of text or one conversation.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_bytes

OPEN, SAYS, CLOSE, LEARNED = "<turn>", "<says>", "</turn>", "assistant"
_state: dict = {}


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace(OPEN, "<\\turn>").replace(SAYS, "<\\says>").replace(CLOSE, "<\\/turn>")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation and the span of each turn's text in it, with whether it is learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + SAYS, escape(text)
        out += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body), role == LEARNED))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.removesuffix(CLOSE).partition(SAYS)
        out.append((unescape(role), unescape(text)))
    return out


def loss_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mask over the tokens, and the learned part of each token's span; two binary searches a turn."""
    mask, low, high = np.zeros(len(starts), bool), starts.copy(), starts.copy()
    for a, b, learned in spans:
        if learned and a < b:
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            mask[first:last] = True
            low[first:last], high[first:last] = np.maximum(starts[first:last], a), np.minimum(ends[first:last], b)
    return mask, low, high


def read_loss(formatted: str, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Spans under the mask; tokens of one character's bytes share its span, neighbours join."""
    out: list[list[int]] = []
    for a, b in zip(low[mask].tolist(), high[mask].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokenizer_of(blob: bytes):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_str(blob.decode())
    t.encode_special_tokens = True  # control strings of the vocabulary are ordinary text
    t.add_tokens([AddedToken(m, normalized=False) for m in (OPEN, SAYS, CLOSE)])
    return t


FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>, loss_starts array<int>, loss_ends array<int>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
BATCH = 1 << 22


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from an array for each row."""
    ends = np.cumsum([0, *map(len, columns)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns) if columns else [], kind))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a conversation: the rendered text, its token ids and spans, the loss mask and the learned part of each token's span."""
    blob = turns.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # rows without an id don't meet
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        conv, text, ids, *spans = zip(*out, strict=True)
        kinds = [pa.int32()] * 2 + [pa.bool_()] + [pa.int32()] * 2
        arrays = [pa.array(conv, pa.int64()), pa.array(text, pa.string()), _lists([np.array(i, np.int32) for i in ids], pa.int32()), *[_lists(list(c), k) for c, k in zip(spans, kinds, strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, names=_names(FORMATTED))

    def run(batches):
        if _state.get("key") != (tokenizer_path, len(blob.value)):
            _state.update(key=(tokenizer_path, len(blob.value)), tokenizer=tokenizer_of(blob.value))
        for b in batches:
            out, size = [], 0
            for k in range(b.num_rows):
                conv, roles, texts = (c[k].as_py() for c in b.columns)
                text, spans = render(list(zip(roles, texts, strict=True)))
                e = _state["tokenizer"].encode(text, add_special_tokens=False)
                at = np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2)
                starts, ends = at[:, 0].copy(), at[:, 1].copy()
                out.append((conv, text, e.ids, starts, ends, *loss_tokens(starts, ends, spans)))
                size += len(text)
                if size >= BATCH:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return whole.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens: from the output alone."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            text = b.column(1).to_pylist()
            ends = [b.column(c).offsets.to_numpy() for c in (2, 5, 6, 7)]
            mask, low, high = (b.column(c).values.to_numpy(zero_copy_only=False) for c in (5, 6, 7))
            out = []
            for k, t in enumerate(text):
                n, m, x, y = (slice(e[k], e[k + 1]) for e in ends)
                turns = parse(t)
                learned = "".join(unescape(t[i:j]) for i, j in read_loss(t, mask[m], low[x], high[y]))
                out.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(learned), sha(learned), len(t), n.stop - n.start, int(np.count_nonzero(mask[m]))))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=_names(READ))

    return formatted.mapInArrow(run, READ)

"""SentencePiece BPE without a merge loop over the text: a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique: among the vocabulary entries that end there (found by
an automaton) it is the one that is compatible with the last token of the prefix before it. Two tokens are compatible if
merging their joined characters by score gives back just these two. The ids are then recovered from the end backwards.
Entries never hold a word mark after another character, so a text falls into words that are encoded apart and remembered.

The 15 entries of repeated marks share one score, so what is merged first among them depends on places, which no prefix
table can hold; words that begin with two marks or more are merged by score and place directly. Characters outside the
vocabulary become byte tokens. Null texts count as empty: no tokens. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, read_bytes, texts

MARK = "▁"
#: Entries of a worker's memories before they start anew.
CACHE_WORDS, CACHE_STEMS, CACHE_PAIRS = 400_000, 1_100_000, 1_000_000
#: Marks that words often end with.
MARKS = ".,!%&#$*|?;:"
START = 0xFFFF
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_state: dict = {}


class PrefixEncoder:
    """Encodes and decodes like the model's library for an identity normalizer with a dummy prefix and byte fallback."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.scores, self.byte = {}, {}, {}
        self.text, self.raw = {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)], self.raw[i] = i, int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[p], self.scores[i], self.text[i] = i, sp.get_score(i), p
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.single = {p for p in self.pieces if len(p) == 1}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}  # neighbours within an entry
        self.words, self.stems, self.pair = Memory(CACHE_WORDS), Memory(CACHE_STEMS, first=True), {}

    def merge(self, s: str) -> list[str]:
        """Symbols after merging neighbours by score, the leftmost first among equals."""
        sym, n = list(s), len(s)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (i := self.pieces.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, len(sym[a]) + len(sym[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not sym[a] or not sym[b] or after[a] != b or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a], sym[b] = sym[a] + sym[b], ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in sym if x]

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left; left START: a text's start or a character outside the vocabulary."""
        b = self.text[right]
        ok = self.merge(b) == [b] if left == START else self.merge(self.text[left] + b) == [self.text[left], b]
        if len(self.pair) >= CACHE_PAIRS:
            self.pair.clear()
        self.pair[left << 16 | right] = ok
        return ok

    def byte_ids(self, s: str) -> list[int]:
        return [self.byte[b] for b in s.encode("utf-8")]

    def word(self, s: str) -> list[int]:
        """Ids of a word by its prefix table."""
        if s.startswith(MARK * 2):
            return [i for x in self.merge(s) for i in ([self.pieces[x]] if x in self.pieces else self.byte_ids(x))]
        if not self.single.issuperset(s):  # characters outside the vocabulary stand alone
            out, at = [], 0
            for k, c in enumerate(s):
                if c not in self.single:
                    out += self.table(s[at:k]) + self.byte_ids(c)
                    at = k + 1
            return out + self.table(s[at:])
        return self.table(s)

    def table(self, s: str) -> list[int]:
        """The unique last token of each prefix, then the ids from the end backwards."""
        if not s:
            return []
        last, size, pair = [-1] * (len(s) + 1), [0] * (len(s) + 1), self.pair
        last[0] = START
        for end, (i, n) in self.automaton.iter(s):
            end += 1
            if last[end] < 0 and (left := last[end - n]) >= 0:
                ok = pair.get(left << 16 | i)
                if ok or ok is None and self.compatible(left, i):
                    last[end], size[end] = i, n
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def look(self, key: str) -> tuple[str, str]:
        """Ids joined by commas, and what they decode to, of a word: after a line end or its own marks, or else after one mark."""
        if key[:1] == MARK:
            return self.look_word(key)
        if key[:1] == "\n":
            ids, text = self.look_word(key[1:]) if len(key) > 1 else ("", "")
            return f"{self.byte[10]},{ids}" if ids else str(self.byte[10]), "\n" + text
        return self.look_word(MARK + key)

    def look_word(self, s: str) -> tuple[str, str]:
        stem = s.rstrip(MARKS)
        if stem and stem != s and s[len(stem) - 1 : len(stem) + 1] not in self.inside:  # no entry crosses the cut
            (a, b), (c, d) = self.part(stem), self.part(s[len(stem) :])
            return f"{a},{c}", b + d
        return self.part(s)

    def part(self, s: str) -> tuple[str, str]:
        if (known := self.stems.known.get(s)) is not None:
            return known
        ids: list[int] = []
        for k, line in enumerate(s.split("\n")):  # no entry holds a line end
            ids += ([self.byte[10]] if k else []) + (self.word(line) if line else [])
        got = ",".join(map(str, ids)), self.decode_part(ids)
        if len(s) <= 64:
            self.stems.offer({s: got})
        return got

    def decode_part(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.raw:
                raw.append(self.raw[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode_text(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the decoded text."""
        if not text:
            return "", ""
        if "  " in text or text[0] == " " or MARK in text:
            words = _WORDS.findall(MARK + text.replace(" ", MARK))
        else:  # a line end begins a word, too: no entry holds one
            words = text.replace("\n", " \n").split(" ")
        got, odd = list(map(self.words.known.get, words)), False
        if missing := [k for k, v in enumerate(got) if v is None]:
            new = {}
            for k in missing:
                w = words[k]
                if (v := new.get(w)) is None:
                    v, back = self.look(w)
                    if back == spoken(w):
                        new[w] = v
                    else:
                        odd = True
                got[k] = v
            self.words.offer({w: v for w, v in new.items() if len(w) <= 64})
        # words that are remembered decode to themselves, so a text of such words does
        return ",".join(got), "".join([self.look(w)[1] for w in words])[1:] if odd else text.replace(MARK, " ")


def spoken(key: str) -> str:
    """What a word's key stands for in the text, with the space before it."""
    return key.replace(MARK, " ") if key[:1] == MARK else key if key[:1] == "\n" else " " + key


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, ids (comma-joined), n_tokens, decoded. Rows stay in their partitions; nothing is shuffled."""
    return _mapped(docs, model_path, "doc_id long, ids string, n_tokens long, decoded string", lambda ids, text: (ids, ids.count(",") + 1 if ids else 0, text))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; texts don't leave the workers."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return _mapped(docs, model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (ids.count(",") + 1 if ids else 0, sha(ids), sha(text)))


def _mapped(docs: DataFrame, model_path: str, schema: str, row) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))
    kinds = [(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in schema.split(", ")]

    def run(batches):
        if _state.get("key") != (model_path, len(model.value)):
            _state.update(key=(model_path, len(model.value)), encoder=PrefixEncoder(model.value))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [(d, *row(*_state["encoder"].encode_text(t))) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return texts(docs).mapInArrow(run, schema)

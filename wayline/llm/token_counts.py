"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The last token of the encoding of each prefix of a word follows from those of shorter prefixes: a
vocabulary token t that ends the prefix is the last one exactly if the last token before it and t, merged
together, stay these two tokens. So one pass over a word gives its token count at every prefix. What the pass needs of the
bytes behind it is a state that many words share, and a step from a state by a byte is worked out once. A text's counts
are stored as one byte per byte of text: twice the change of the count, plus one where a character ends. Running sums
over the stored bytes answer how many tokens a prefix has (``tokens_at``) and where a budget cuts (``cut_at``), without the text and
without encoding again.

A prefix is counted as if it were the whole text: where cutting changes how the end is split into words (runs of white space,
contractions, special strings) the changes are corrected there.

Defined cases: null counts as the empty text, with no tokens; special strings inside texts are one
token; offsets are UTF-8 bytes, and cuts fall between characters; counts at places inside a character are those of its bytes;
repeated rows give repeated rows; an empty table gives no rows; further columns are passed through, of the names added the input's are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import others, written

#: White space of the Unicode property, as a character class: fixed value.
SPACE = "\t-\r \x85\xa0  -     　"
#: How the tokenizer splits text into words: fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions of three characters, which have no two-character beginning: fixed values.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: A word of Latin letters and what ASCII marks follow it, which make two words: fixed value.
PLAIN = r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"
#: Chunks, words, steps and pairs of tokens that a Python worker remembers, about 0.4 GB; it starts afresh beyond.
CHUNKS, REMEMBERED, STEPS, PAIRS = 300_000, 600_000, 800_000, 800_000
#: Numbers that the states of a step may have on average; those of long runs of one character have some hundreds.
WIDTH = 20
#: Longest chunk or word that it remembers.
LONGEST = 256
BATCH_BYTES = 8 << 20
TOO_FAR = "a token count changes by more than 63 at one byte"


def signed(changes: np.ndarray) -> bytes:
    """Changes as signed bytes of which one bit stays free; larger ones, which no token could make, are an error."""
    if len(changes) and (changes.max() > 63 or changes.min() < -64):
        raise OverflowError(TOO_FAR)
    return changes.astype(np.int8).tobytes()


class PrefixCounter:
    """Changes of the token count along a text, for one tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are their own characters in the file
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.ids = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.made = {t: (a, b, r) for (a, b), (r, t) in self.ranks.items()}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.below: dict[int, int] = {}  # tree of tokens: node * 256 + byte to node
        self.ending: dict[int, int] = {}  # node to the token of two bytes or more that ends there
        for t, i in self.ids.items():
            node = 0
            for byte in t:
                node = self.below.setdefault(node << 8 | byte, len(self.below) + 1)
            if len(t) > 1:
                self.ending[node] = i
        self.goes_on = {key >> 8 for key in self.below}
        self.spines: tuple[dict, dict] = ({}, {})
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.split, self.plain = regex.compile(WORDS).findall, re.compile(PLAIN).fullmatch
        self.chunks_of = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.runs, self.runs_in = (getattr(re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])"), f) for f in ("search", "finditer"))
        self.pair: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self._forget()
        self.alone: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word by the merges in order of rank."""
        ids = [self.ids[bytes([b])] for b in word]
        while len(ids) > 1:
            best = min((self.ranks.get(p, (1 << 30, 0)) for p in zip(ids, ids[1:])), default=None)
            if best[0] == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one end of t while its bytes are merged, each with the rank of the merge that ends it."""
        known = self.spines[side].get(t)
        if known is None:
            known, end, x = [(t, 1 << 30)], 0, t
            while x in self.made:
                end, x = self.made[x][2], self.made[x][side]
                known.append((x, end))
            self.spines[side][t] = known
        return known

    def _follows(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay two tokens: no pair of their facing ends is merged while both are there.

        Of merges with the same rank the leftmost comes first.
        """
        known = self.pair.get(a << 32 | b)
        if known is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            ranks, left = self.ranks, self._spine(b, 0)
            known = not any((q := ranks.get((x, y))) and q[0] < gone and q[0] <= end for x, gone in self._spine(a, 1) for y, end in left)
            self.pair[a << 32 | b] = known
        return known

    def _whole(self, t: int) -> bool:
        known = self.alone.get(t)
        if known is None:
            known = self.alone[t] = self.merged(self.bytes[t]) == [t]
        return known

    def _forget(self) -> None:
        """An empty table of steps, in which state 0 is the beginning of a word."""
        self.steps.clear()
        self.numbers.clear()
        self.states.clear()
        self.held = 0
        self._number((0, -1, 0))

    def _number(self, state: tuple[int, ...]) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.held += len(state)
        return number

    def _step(self, at: int, byte: int) -> int:
        """The next state * 256 + the change of the count as a byte, after one more byte.

        A state is what later bytes depend on: of each place where a token that is not over may have begun, the first
        place first, the node of its bytes so far, the last token before it (-1: none) and the count there less the
        count here. Words that begin differently soon come to the same states, so new words need few new steps.
        """
        state = self.states[at]
        if len(self.steps) >= STEPS or self.held >= STEPS * WIDTH:
            self._forget()
            at = self._number(state)
        last, change, begun = -1, 0, []
        for node, before, count in zip(state[::3], state[1::3], state[2::3]):
            node = self.below.get(node << 8 | byte)
            if node is None:
                continue
            if last < 0 and (t := self.ending.get(node)) is not None and (self._follows(before, t) if before >= 0 else self._whole(t)):
                last, change = t, count + 1
            if node in self.goes_on:
                begun.append((node, before, count))
        if last < 0:  # no longer token fits: the byte itself
            last, change = self.ids[bytes((byte,))], 1
        if not -64 <= change <= 63:
            raise OverflowError(TOO_FAR)
        after = self._number((*(x for node, before, count in begun for x in (node, before, count - change)), 0, last, 0))
        step = self.steps[at << 8 | byte] = after << 8 | change & 255
        return step

    def word_changes(self, word: bytes) -> bytes:
        """Change of the token count at every byte of a word."""
        steps, out, at = self.steps, bytearray(), 0
        for byte in word:
            step = steps.get(at << 8 | byte)
            if step is None:
                step = self._step(at, byte)
            out.append(step & 255)
            at = step >> 8
        return bytes(out)

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = self.word_changes(word.encode("utf-8", "replace"))
            if word in CONTRACTIONS:  # cut after two characters it is an apostrophe and a letter
                known = bytes((1, 1, (sum(known) - 2) & 255))
            if len(word) <= LONGEST:
                if len(self.words) > REMEMBERED:
                    self.words.clear()
                self.words[word] = known
        return known

    def _chunk(self, chunk: str) -> bytes:
        known = self.chunks.get(chunk)
        if known is None:
            plain = self.plain(chunk)
            known = b"".join(map(self._word, plain.groups() if plain else self.split(chunk)))
            if len(chunk) <= LONGEST:
                if len(self.chunks) > CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = known
        return known

    def _plain(self, text: str) -> bytes:
        """Changes over a text without special strings."""
        out = b"".join([self.chunks.get(c) or self._chunk(c) for c in self.chunks_of(text)])
        if not self.runs(text):
            return out
        # A text that ends with a run of white space holds all of it as one word.
        held, at, behind = np.frombuffer(out, np.int8).astype(np.int16), 0, 0
        for m in self.runs_in(text):
            at += len(text[behind : m.end()].encode("utf-8", "replace"))
            behind, run = m.end(), m.group()
            more = self._tokens(run) - self._tokens(run[:-1]) - self._tokens(run[-1])
            held[at - 1] += more
            held[at] -= more
        return signed(held)

    def _tokens(self, word: str) -> int:
        return int(np.frombuffer(self._word(word), np.int8).sum(dtype=np.int64))

    def changes(self, text: str | None) -> np.ndarray:
        """Change of the token count at every byte of a text."""
        text = text or ""
        if not self.special or not self.special.search(text):
            return np.frombuffer(self._plain(text), np.int8)
        out, at = [], 0
        for m in self.special.finditer(text):
            before, name = text[at : m.start()], m.group()
            plain = np.frombuffer(self._plain(before), np.int8)
            base = int(plain.sum(dtype=np.int64))
            ends = [int(np.frombuffer(self._plain(before + name[:k]), np.int8).sum(dtype=np.int64)) for k in range(1, len(name))]
            sizes = [len(c.encode()) for c in name]
            steps = np.diff([base, *ends, base + 1])
            special = np.zeros(sum(sizes), np.int64)
            special[np.cumsum(sizes) - 1] = steps
            out += [plain, np.frombuffer(signed(special), np.int8)]
            at = m.end()
        return np.concatenate([*out, np.frombuffer(self._plain(text[at:]), np.int8)])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """A worker keeps the counter of one file, and what it remembers, between tasks."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def packed(changes: np.ndarray, raw: bytes) -> bytes:
    """The stored form of a text's changes: twice each, plus one where a character ends."""
    held = np.frombuffer(raw, np.uint8)
    ends = np.ones(len(held), np.int8)
    ends[:-1] = (held[1:] & 0xC0) != 0x80
    return (changes * 2 + ends).astype(np.int8).tobytes()


def _stored(batches: Iterator[pa.RecordBatch], path: str, passed: list[str]) -> Iterator[pa.RecordBatch]:
    counts = counter(path)
    for batch in batches:
        texts, start, held, rows = batch.column("text"), 0, 0, []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            rows.append(packed(counts.changes(text), text.encode("utf-8", "replace")))
            held += len(rows[-1])
            if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                made = [pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], names=[*passed, *PREFIXED])
                start, held, rows = i + 1, 0, []


PREFIXED = ("n_bytes", "prefixes")


def prefix_counts(docs: DataFrame, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (default all) with n_bytes and prefixes (binary), from a table in the shared folder."""
    names = [c for c in others(docs.columns, PREFIXED) if keep is None or c in keep]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_bytes", T.LongType()), T.StructField("prefixes", T.BinaryType())])
    made = docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(partial(_stored, path=path, passed=names), schema)
    return written(made, "prefixes", compression="zstd")


def _sums(prefixes: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(prefixes or b"", np.int8) >> 1, dtype=np.int64)


@pandas_udf(T.LongType())
def tokens_at(prefixes: pd.Series, n_bytes: pd.Series) -> pd.Series:
    """Tokens of the first n_bytes of a text, from its stored prefixes: 0 for none, all of them beyond its end."""
    out = []
    for p, n in zip(prefixes, n_bytes, strict=True):
        held = np.frombuffer(p or b"", np.int8)[: max(0, int(n))]
        out.append(int((held >> 1).sum(dtype=np.int64)))
    return pd.Series(out, dtype="int64")


@pandas_udf(T.LongType())
def cut_at(prefixes: pd.Series, budget: pd.Series) -> pd.Series:
    """Bytes of the longest prefix of a text, in whole characters, with at most ``budget`` tokens, from its stored prefixes."""
    out = []
    for p, most in zip(prefixes, budget, strict=True):
        fits = np.flatnonzero((_sums(p) <= most) & (np.frombuffer(p or b"", np.int8) & 1 == 1))
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int64")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (default all) with n_bytes, n_tokens, over_limit and cut_bytes, all from the stored prefixes.

    cut_bytes: length of the longest prefix within the limit.
    """
    added = ("n_bytes", "n_tokens", "over_limit", "cut_bytes", "prefixes")
    names = [c for c in others(docs.columns, added) if keep is None or c in keep]
    stored = prefix_counts(docs.select(*dict.fromkeys([*names, "text"])), path, tuple(names))
    counted = stored.select(*names, "n_bytes", tokens_at("prefixes", "n_bytes").alias("n_tokens"), cut_at("prefixes", F.lit(limit)).alias("cut_bytes"))
    return counted.select(*names, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_bytes")

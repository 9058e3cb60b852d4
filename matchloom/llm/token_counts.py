"""Token counts at every prefix of a text, by prefix dynamic programming over byte-pair encodings.

The last token of a prefix's encoding is the one token that ends there and stands rightly behind the last token of the
prefix before it; its count is that prefix's plus one. So one pass over a piece gives the counts of all its prefixes,
and questions about budgets and cuts are look-ups.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 1024
#: Bytes from which on a piece is worked out by itself.
LONG_PIECE = 64
#: Pieces, prefixes of pieces and token pairs that a task remembers.
REMEMBERED = 700_000

#: The split pattern of the byte-level tokenizer, and the endings that it splits off whole.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("'re", "'ve", "'ll")

#: Characters on whose class two pattern libraries might differ; texts with one are split by the tokenizer itself.
_UNUSUAL = re.compile(r"[\x00-\x08\x0e-\x1f\x85\xa0]|[^\x00-ɏ]")
_TWO_SPACES = re.compile(r"\s\s")


def _byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes: themselves where printable, else code points from 256 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class PrefixCounter(dict):
    """piece -> counts of its non-empty byte prefixes, as 32-bit numbers; filled by the recurrence above."""

    def __init__(self, spec: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.vocabulary = frozenset(vocabulary)
        self.lengths = [2, 3, 4, 1, *range(5, max(map(len, vocabulary)) + 1)]
        self.letters = _byte_letters()
        self.split = regex.compile(PIECES).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = {s[0] for s in special}
        self.state: dict[str, tuple[int, str]] = {"": (0, "")}
        self.fits: dict[tuple[str, str], bool] = {}

    def _fit(self, before: str, token: str) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        key = (before, token)
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        found = self.fits[key] = [t.value for t in self.model.tokenize(before + token)] == ([before, token] if before else [token])
        return found

    def _prefixes(self, word: str) -> list[int]:
        """Counts of the non-empty prefixes. Words share beginnings, so each prefix is worked out once."""
        if len(word) > LONG_PIECE:
            return self._long(word)
        state, vocabulary, known = self.state, self.vocabulary, self.fits.get
        if len(state) >= REMEMBERED:
            state.clear()
            state[""] = (0, "")
        size = len(word)
        i = size
        while word[:i] not in state:
            i -= 1
        counts = [state[word[:x]][0] for x in range(1, i + 1)]
        for i in range(i + 1, size + 1):
            for k in self.lengths:  # one length fits, so their order is free: the likely ones first
                if k <= i and (token := word[i - k : i]) in vocabulary:
                    count, last = state[word[: i - k]]
                    fits = known((last, token))
                    if fits or fits is None and self._fit(last, token):
                        state[word[:i]] = (count + 1, token)
                        counts.append(count + 1)
                        break
        return counts

    def _long(self, word: str) -> list[int]:
        """The same for a long piece, whose prefixes are not worth remembering."""
        counts, last = [0], [""]
        for i in range(1, len(word) + 1):
            for k in self.lengths:
                if k <= i and (token := word[i - k : i]) in self.vocabulary:
                    fits = self.fits.get((last[i - k], token))
                    if fits or fits is None and self._fit(last[i - k], token):
                        counts.append(counts[i - k] + 1)
                        last.append(token)
                        break
        return counts[1:]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if piece in ENDINGS:  # a prefix of two bytes is not such an ending yet: an apostrophe and a letter
            out = array("I", [1, 2, len(self.model.tokenize(piece))])
        else:
            word = "".join([self.letters[b] for b in piece.encode()])
            out = array("I", self._prefixes(word))
        value = self[piece] = out.tobytes()
        return value

    def pieces(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def plain(self, text: str) -> tuple[np.ndarray, str]:
        """Counts at the non-empty byte prefixes of a text without special strings, and its last piece."""
        pieces = self.pieces(text)
        found = list(map(self.__getitem__, pieces))
        local = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.cumsum(sizes)
        whole = local[ends - 1].astype(np.int64)
        base = np.cumsum(whole) - whole
        counts = local + np.repeat(base, sizes)
        if _TWO_SPACES.search(text):
            self._runs(pieces, ends - sizes, base, counts)
        return counts, pieces[-1]

    def _runs(self, pieces: list[str], starts: np.ndarray, base: np.ndarray, counts: np.ndarray) -> None:
        """White space that more white space or a word follows is split; cut off there, the run is one piece."""
        for i in range(1, len(pieces)):
            first = pieces[i][0]
            if first.isspace() and pieces[i - 1].isspace():
                size = len(pieces[i].encode()) if pieces[i].isspace() else len(first.encode())
                run = np.frombuffer(self[pieces[i - 1] + (pieces[i] if pieces[i].isspace() else first)], np.uint32)
                if not pieces[i].isspace() or i + 1 < len(pieces):
                    counts[starts[i] : starts[i] + size] = base[i - 1] + run[-size:]

    def counts(self, text: str) -> np.ndarray:
        """Token counts of all byte prefixes, the empty one first; exact where a prefix ends between characters."""
        out, total, at = [np.zeros(1, np.int64)], 0, 0
        for m in self.special.finditer(text) if any(c in text for c in self.marks) else ():
            last = ""
            if m.start() > at:
                part, last = self.plain(text[at : m.start()])
                out.append(part + total)
                before = total + int(part[-1]) - int(np.frombuffer(self[last], np.uint32)[-1])
                total += int(part[-1])
            else:
                before = total
            # Cut off inside, a special string is ordinary text that may join the piece before it.
            open_ = [before + sum(len(self[p]) and int(np.frombuffer(self[p], np.uint32)[-1]) for p in self.pieces(last + m.group()[:k])) for k in range(1, len(m.group()))]
            total += 1
            out.append(np.array([*open_, total], np.int64))
            at = m.end()
        if at < len(text):
            part, _ = self.plain(text[at:])
            out.append(part + total)
        return np.concatenate(out)


@lru_cache(1)
def _counter(spec: str) -> PrefixCounter:
    """A Python worker makes one and keeps what it remembers, of bounded size, from task to task."""
    return PrefixCounter(spec)


def longest_prefix(counts: np.ndarray, raw: bytes, limit: int) -> int:
    """Bytes of the longest prefix, ending between characters, that has at most `limit` tokens."""
    inside = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
    return int(np.flatnonzero((counts <= limit) & ~inside)[-1])


def _spec(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for raw in batch.column(1).cast(pa.binary()):
        b = raw.as_py() or b""
        yield b.decode(), b


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, counts array<int>): token counts at each byte prefix from the empty to the whole text.

    path: the tokenizer's file, which the driver reads and broadcasts. Special strings count as the library's default
    has them, one token. Null text is empty: counts [0].
    """
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for i, (text, _) in enumerate(_texts(batch)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([counter.counts(text)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit, cut_bytes), one row per row.

    n_tokens is the last of the prefix counts; cut_bytes how many bytes the longest prefix within the limit has. A
    null or empty text has 0 of each. Whole texts, at any length; no shuffle. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            sizes, tokens, cuts = [], [], []
            for text, raw in _texts(batch):
                counts = counter.counts(text)
                sizes.append(len(raw))
                tokens.append(int(counts[-1]))
                cuts.append(len(raw) if counts[-1] <= limit else longest_prefix(counts, raw, limit))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()),
                pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_bytes bigint")

"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A batch of pre-tokens is one ragged array of symbols. In every round each pre-token applies
its lowest-ranked pair, all occurrences at once and all pre-tokens at the same time,
until no pair of the vocabulary is left; the symbols that survive are the tokens. That
equals merging pair by pair because a pair always ranks after the merges that made its
parts, which is checked when the vocabulary is read.

White space separates pre-tokens in this kind of vocabulary, so counts are kept per
space-separated word. The memory of words is emptied when it is full.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 400_000
SYMBOLS_AT_ONCE = 400_000
PIECE = 1 << 20  # bytes of a text that are split into words at once
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges of a tokenizer file (BPE on bytes with a mark at the word's end)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols])
        self.last = np.array([ids[s + end] for s in symbols])
        self.of_symbol = {s: b for b, s in enumerate(symbols)}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.special_at = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs]) for k in (0, 1))
        made = np.array([ids["".join(p)] for p in pairs])
        rank = np.arange(len(pairs))
        born = np.full(max(ids.values()) + 1, -1)
        np.maximum.at(born, made, rank)
        self.in_order = bool(((born[left] < rank) & (born[right] < rank)).all())
        key = left * (1 << 20) + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], rank[order], made[order]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words: dict[bytes, int] = {}
        # what the file's own pattern does to the characters of _PLAIN
        self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    _PLAIN = regex.compile("[\x21-\x7e\xa1-ɏ]*")

    def pretokens(self, word: bytes) -> list[bytes]:
        text = word.decode("utf-8", "replace")
        if self._PLAIN.fullmatch(text):  # composed letters and signs whose properties no Unicode version changes
            return [p.encode() for p in self.pretoken.findall(text.lower())]
        return [bytes(self.of_symbol[c] for c in p) for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def survivors(self, pretokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        sizes = np.array([len(p) for p in pretokens])
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = sizes.copy()
        while len(symbol):
            key = symbol[:-1] * (1 << 20) + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(begin, len(owner)))
            low = np.minimum.reduceat(rank, begin)
            hit = (rank == np.repeat(low, length)) & (rank != _NONE)
            where = np.flatnonzero(hit)
            if self.in_order:
                # of touching occurrences (a symbol with itself) every second one merges
                run = np.concatenate(([True], np.diff(where) > 1)) if len(where) else np.empty(0, bool)
                first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            else:  # only the leftmost occurrence of each pre-token
                where = where[np.concatenate(([True], np.diff(owner[where]) > 0))] if len(where) else where
            symbol[where] = self.made[at[where]]
            counts -= np.bincount(owner[where], minlength=len(counts))
            keep = np.repeat(low != _NONE, length)
            keep[where + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return counts

    def learn(self, words: list[bytes]) -> None:
        """Count the tokens of new words and remember them."""
        pieces: list[bytes] = []
        owner: list[int] = []
        total = np.zeros(len(words), np.int64)

        def settle() -> None:
            if pieces:
                np.add.at(total, owner, self.survivors(pieces))
                pieces.clear()
                owner.clear()

        held = 0
        for i, word in enumerate(words):
            parts = [word]
            if self.special_at and self.special_at.search(word):
                total[i] += len(self.special_at.findall(word))
                parts = [p for p in self.special_at.split(word) if p]
            for part in parts:
                new = self.pretokens(part)
                pieces += new
                owner += [i] * len(new)
                held += len(part)
            if held > SYMBOLS_AT_ONCE:
                settle()
                held = 0
        settle()
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words = {}
        self.words.update(zip(words, total.tolist()))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        new = {w for words in split for w in words}
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words = {}
        self.learn([w for w in new if w not in self.words])
        known = self.words
        return [sum(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where words end."""
    begin = 0
    while begin < len(text):
        cut = regex.compile(rb"[ \t\n\r\x0b\x0c]").search(text, begin + PIECE)
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


def _counter(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        vocab = vocabulary(path if os.path.isabs(path) else public_tokenizers.path(path))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            size, tokens = [], []
            for start in range(0, batch.num_rows, 100):
                part = [t.as_py() or b"" for t in texts.slice(start, 100)]
                size += map(len, part)
                for at in range(len(part)):
                    if len(part[at]) > PIECE:
                        long, part[at] = part[at], b""
                        tokens.append((start + at, sum(vocab.count([p])[0] for p in _pieces(long))))
                tokens += [(start + at, n) for at, n in enumerate(vocab.count(part)) if n]
            counts = np.zeros(batch.num_rows, np.int64)
            for at, n in tokens:
                counts[at] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(counts), pa.array(counts > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json",
                 limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is an absolute path that every worker has, or a file of the public
    tokenizers package. No begin or end token is counted; the text of a special token
    inside a text counts as that one token.

    * Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole, however long.
    * Every row gives a row; a null id stays null, repeated ids repeat.
    * An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_counter(tokenizer, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))

"""BPE encoding and decoding by forced-boundary splitting.

Byte-pair merging only ever makes tokens of the vocabulary, so two neighbouring symbols that no vocabulary token holds
side by side are never merged across: a certain cut. A pre-token is cut there, each fragment is encoded on its own (and
remembered, as fragments repeat), and the ids are concatenated; the result is that of encoding the pre-token whole.

Documents are encoded where they are read, in Arrow batches without a shuffle; the vocabulary is read by each worker from its
installed file. The caches are bounded and hold short pieces only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table, tidied

#: Entries of a worker's cache, and characters of the longest piece it keeps.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Texts of characters below this one (Latin letters) hold nothing to compose and lower-case alike everywhere.
COMMON = "\u0250"
#: Separators that str.split() takes for white space and the vocabulary's pre-tokenizer does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: Latin-1's printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: NFC, white space dropped, lower case, word-end suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # A fragment that ends its word gets the suffix from the first; the others are encoded as they stand.
        self.last = BPE(self.vocab, merges, end_of_word_suffix=self.end)
        self.inner = BPE(self.vocab, merges)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in specials.items()}
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.symbols = dict(enumerate(byte_symbols()))
        self.joined = {pair for t in self.vocab for pair in self.pairs(self.split_symbols(t))}
        file = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = file.normalizer, file.pre_tokenizer
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.fragments: dict[tuple[str, bool], list[int]] = {}

    def forget(self) -> None:
        """Empty the caches: a worker lives on after its task, and other work than this may follow."""
        self.cache.clear()
        self.fragments.clear()
        give_back()

    def split_symbols(self, token: str) -> list[str]:
        """A token's symbols; the word end is part of the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    @staticmethod
    def pairs(symbols: list[str]):
        return zip(symbols, symbols[1:])

    def encode_fragment(self, fragment: str, ends: bool) -> list[int]:
        ids = self.fragments.get((fragment, ends))
        if ids is None:
            ids = [t.id for t in (self.last if ends else self.inner).tokenize(fragment)]
            if len(fragment) <= CACHE_CHARS:
                if len(self.fragments) >= CACHE_ENTRIES:
                    self.fragments.clear()
                self.fragments[fragment, ends] = ids
        return ids

    def symbols_of(self, word: str) -> str:
        """One printable symbol for each byte of a pre-token."""
        return word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols)

    def encode_symbols(self, body: str) -> list[int]:
        """Ids of one pre-token: cut at every pair that no vocabulary token holds, then fragment by fragment."""
        joined, stop = self.joined, len(body) - 1
        cuts = [k for k in range(1, stop) if (body[k - 1], body[k]) not in joined]
        if stop and (body[stop - 1], body[stop] + self.end) not in joined:
            cuts.append(stop)
        if not cuts:  # a whole word, which the caller remembers
            return [t.id for t in self.last.tokenize(body)]
        cuts = [0, *cuts, stop + 1]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.encode_fragment(body[a:b], b > stop)]

    def _word(self, word: str, body: str | None = None) -> tuple[str, int, str]:
        ids = self.encode_symbols(self.symbols_of(word) if body is None else body)
        return self._keep(word, (" ".join(map(str, ids)), len(ids), self.decode(ids)))

    def _keep(self, piece: str, found: tuple[str, int, str]) -> tuple[str, int, str]:
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def _piece(self, piece: str) -> tuple[str, int, str]:
        """Ids joined by spaces, their number, and the decoded text of a piece without white space; cached if short."""
        if piece.isalpha() and max(piece) < COMMON:
            return self._word(piece)
        get = self.cache.get
        if max(piece) < COMMON and min(piece) > " ":
            parts = [get(w) or self._word(w) for w in self.words.findall(piece)]
        else:  # characters on which libraries may differ: the vocabulary's own pre-tokenizer decides
            parts = [self._word("\0" * 99, body) for body, _ in self.pre_tokenizer.pre_tokenize_str(piece)]
        if len(parts) == 1 and parts[0][1]:
            return self._keep(piece, parts[0])
        parts = [p for p in parts if p[1]]
        return self._keep(piece, (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts])))

    def decode(self, ids) -> str:
        """Tokens joined by a space, as the file names no decoder; special tokens are kept."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def _plain(self, text: str) -> list[tuple[str, int, str]]:
        """The parts of a text without special tokens, one for each piece between white space."""
        if not text:
            return []
        if max(text) < COMMON and not any(c in text for c in NOT_SPACE):
            pieces = text.lower().split()
        else:  # the vocabulary's own normalizer leaves no white space but U+0020
            pieces = self.normalizer.normalize_str(text).split(" ")
        get, make = self.cache.get, self._piece
        return [get(p) or make(p) for p in pieces if p]

    def encode(self, text: str | None) -> list[tuple[str, int, str]]:
        """The parts of a text: (ids joined by spaces, number of ids, decoded), to be joined by spaces where not empty."""
        text = text or ""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = []
        for k, t in enumerate(self.special.split(text)):
            parts += [(str(self.specials[t]), 1, t)] if k % 2 else self._plain(t)
        return parts

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the SHA-256 of the ids joined by spaces and of the decoded text."""
        parts = [p for p in self.encode(text) if p[1]]
        ids, decoded = " ".join([p[0] for p in parts]), " ".join([p[2] for p in parts])
        return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row's whole text.

    Null and empty texts give no ids and an empty decoded text. Repeated rows and equal ids are encoded row by row; other
    columns are ignored whatever their names; an empty table gives an empty result.
    """

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)

        def encoded(texts: pd.Series) -> pd.DataFrame:
            rows = [[int(i) for p in bpe.encode(t) for i in p[0].split()] for t in texts]
            return pd.DataFrame({"ids": rows, "decoded": [bpe.decode(r) for r in rows]})

        yield from tidied(map(encoded, batches))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", encode("text").alias("x")).select("doc_id", "x.ids", "x.decoded")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """encode_documents() with ids and decoded text as digests, so that neither leaves the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        try:
            for texts in batches:
                yield pd.DataFrame([bpe.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.forget()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", digest("text").alias("x")).select("doc_id", "x.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_path())

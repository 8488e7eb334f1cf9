"""Byte-pair encoding by forced-boundary splitting, and decoding.

Every merge of a BPE vocabulary makes a token, so two neighbouring symbols that
stand side by side inside no token can never be merged across: the cut between
them is certain. A word is split at all such forced boundaries, its fragments
are encoded independently (and remembered, since fragments repeat far more than
words), and the results are concatenated. The outcome equals encoding the word
as a whole.

Vocabulary files are those of the ``tokenizers`` library: BPE over the bytes'
printable alphabet with an end-of-word suffix. Normalising and cutting text into
words use a fast path over ASCII and Latin-1 letters, where the rules reduce to
one regular expression, and the library's own normaliser and pre-tokeniser
elsewhere.

Null text counts as empty and has no tokens. Whole texts are encoded, of any
length; rows repeat as given. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import sys
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonorel.llm.common import bound_arrow_batches

#: Bytes that stand for themselves in the printable alphabet of byte-level BPE (fixed values of that format).
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Words remembered by each worker; beyond it the memory is emptied and fills anew.
CACHE_WORDS = 200_000
#: Fragments remembered beside them. Words without a cut are remembered as words only.
CACHE_FRAGMENTS = 40_000

_LATIN = "a-zß-öø-ÿ"
_FAST_TEXT = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_FAST_WORD = re.compile(rf"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\x0b\x0c\r {_LATIN}0-9]+")


def _alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    def __init__(self, path: str, most_words: int = CACHE_WORDS):
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._final = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None, cache_capacity=0)
        self._inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self._path = path
        self._alphabet = "".join(_alphabet()[b] for b in range(256))
        self._special_cut = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.inside, self.inside_last = self._pairs_inside_tokens()
        self.most_words = most_words
        self.packed: dict[str, bytes] = {}
        self._parts: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})

    @cached_property
    def library(self):
        """The library's own normaliser and pre-tokeniser, loaded where a text needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def _pairs_inside_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of bytes (first * 256 + second): whether some token has it inside, and whether some token ends a word with it."""
        byte_of = {c: b for b, c in _alphabet().items()}
        inside, last = np.zeros(65536, bool), np.zeros(65536, bool)
        for token in self.vocab:
            if token in self.special:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            for k, pair in enumerate(zip(body, body[1:])):
                (last if ends and k == len(body) - 2 else inside)[pair[0] * 256 + pair[1]] = True
        return inside, last if self.suffix else inside

    def _fragment(self, raw: bytes, final: bool) -> bytes:
        """The packed ids of one fragment, encoded on its own."""
        known = self._parts[final]
        ids = known.get(raw)
        if ids is None:
            ids = self._tokenize(raw, final)
            if len(known) >= CACHE_FRAGMENTS:
                known.clear()
            known[raw] = ids
        return ids

    def _tokenize(self, raw: bytes, final: bool) -> bytes:
        mapped = raw.decode("latin-1").translate(self._alphabet)
        return array("I", [t.id for t in (self._final if final else self._inner).tokenize(mapped)]).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes those words that aren't remembered: cuts all of them at forced boundaries at once, then encodes the fragments."""
        new = [w for w in words if w not in self.packed]
        if not new:
            return
        if len(self.packed) + len(new) > self.most_words:
            self.packed.clear()
            new = list(words)
        raws = [w.encode("utf-8") for w in new]
        flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint16)
        ends = np.cumsum([len(r) for r in raws])
        pairs = flat[:-1] * 256 + flat[1:]
        cut = ~self.inside[pairs]  # cut[i]: between bytes i and i + 1
        last = ends - 2
        last = last[(np.diff(ends, prepend=0) > 1)]
        cut[last] = ~self.inside_last[pairs[last]]
        cut[ends[:-1] - 1] = False
        places = np.flatnonzero(cut) + 1
        of = np.searchsorted(ends, places, side="right")
        starts = ends - np.diff(ends, prepend=0)
        inner = (places - starts[of]).tolist()
        first = np.searchsorted(of, np.arange(len(raws) + 1)).tolist()
        part = self._fragment
        for k, raw in enumerate(raws):
            if (a := first[k]) == (b := first[k + 1]):
                self.packed[new[k]] = self._tokenize(raw, True)
            else:
                at = inner[a:b]
                self.packed[new[k]] = b"".join([part(raw[i:j], False) for i, j in zip([0, *at], at)]) + part(raw[at[-1] :], True)
        for token, number in self.special.items():
            if token in words:
                self.packed[token] = array("I", [number]).tobytes()

    def words(self, text: str | None) -> list[str]:
        """Pre-tokenised words. A special token is a word of its own; ordinary words never equal one."""
        if not text:
            return []
        if self._special_cut is not None and "<|" in text:
            return [
                w for part in self._special_cut.split(text) if part for w in (
                    [part] if part in self.special else self._plain_words(part)
                )
            ]
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if _FAST_TEXT.fullmatch(text):
            return _FAST_WORD.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit numbers."""
        cut = [self.words(t) for t in texts]
        self.learn(set().union(*cut))
        get = self.packed.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], np.uint32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder, so the tokens are joined by spaces."""
        return " ".join([self.token_of[i] for i in ids])


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit numbers")


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def small_batches(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_decode(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (null: empty);
    with keep_text also ids array<int> and decoded string."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if keep_text else ""
    )

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        numbers = {i: str(i) for i in bpe.token_of}
        for whole in batches:
            for batch in small_batches(whole):
                out: list[list] = [[] for _ in range(6 if keep_text else 4)]
                for doc_id, packed in zip(batch.column(0).to_pylist(), bpe.encode_packed(batch.column(1).to_pylist())):
                    ids = np.frombuffer(packed, np.uint32).tolist()
                    decoded = bpe.decode(ids)
                    row = [
                        doc_id,
                        len(ids),
                        hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest(),
                        hashlib.sha256(decoded.encode()).hexdigest(),
                        ids,
                        decoded,
                    ]
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, types)],
                    names + ["ids", "decoded"][: 2 * keep_text],
                )

    bound_arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)

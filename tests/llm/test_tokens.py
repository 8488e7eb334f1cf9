"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sonorel.llm import bpe, packing, token_counts


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def test_random_texts_encode_as_the_library_does(tokenizer, library, texts):
    rnd = random.Random(1)
    alphabet = "aAéÀßσΣΑİı½٣ 一\x1c\x0b\x0c  'sdtrevm!?<|>😀é\n09ªµ²"
    odd = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    odd += ["".join(chr(rnd.randrange(1, 0xD800)) for _ in range(20)) for _ in range(1000)]
    ours = bpe.ForcedBoundaryBPE(tokenizer, most_words=500)
    for text in [*odd, *texts, "x<|endoftext|>y<|startoftext|>"]:
        assert ours.encode(text) == library.encode(text or "", add_special_tokens=False).ids


def test_fragments_alone_give_the_word(tokenizer):
    ours = bpe.load(tokenizer)
    cut = 0
    for word in ("zxqjkvb", "qzqzqz", "strength", "xkcdqq"):
        flat = np.frombuffer(word.encode(), np.uint8)
        cut += int((~ours.inside[flat[:-1].astype(np.uint16) * 256 + flat[1:]]).sum())
        assert ours.encode(word) == ours.library.encode(word, add_special_tokens=False).ids
    assert cut  # some boundary was forced


def test_query_columns(docs, nothing, tokenizer, library):
    rows = bpe.encode_decode(docs, tokenizer, keep_text=True).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(nothing, tokenizer).count() == 0


def test_counts_answer_every_limit(docs, nothing, tokenizer, library):
    n = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    sums = token_counts.token_counts(docs, tokenizer).cache()
    for r in sums.collect():
        assert r.docs_at_least == sum(x >= r.context_limit for x in n) and r.docs_at_most == sum(x <= r.context_limit for x in n)
        assert r.total_tokens == sum(n) and r.truncated_tokens == sum(min(x, r.context_limit) for x in n)
    for limit in (1, 7, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(sums, 0.5) == n[(len(n) + 1) // 2 - 1]
    empty = token_counts.token_counts(nothing, tokenizer)
    assert empty.count() == 0 and token_counts.truncated_total(empty, 5) == 0


def test_pieces_fit_and_nothing_is_lost(docs, nothing, tokenizer, library):
    rows = packing.pack(docs, tokenizer, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        found = {p.piece: p for p in by_doc[r.doc_id]}
        assert sum(p.length for p in found.values()) == len(ids)
        for p in found.values():
            assert p.start == p.piece * 256 and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    least = -(-sum(r.length for r in rows) // 256)
    assert len(by_sequence) <= 1.03 * least + 1
    assert packing.pack(nothing, tokenizer).count() == 0


def test_plans_hold_every_piece():
    rnd = random.Random(2)
    for _ in range(20):
        counts = {rnd.randint(1, 4096): rnd.randint(1, 300) for _ in range(rnd.randint(1, 200))}
        groups = packing.plan(counts)
        held: dict[int, int] = {}
        for many, lengths in groups:
            assert many > 0 and sum(lengths) <= 4096
            for n in lengths:
                held[n] = held.get(n, 0) + many
        assert held == counts
    assert packing.plan({}) == []

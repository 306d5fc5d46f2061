import hashlib
import random

import numpy as np
import pytest

from gridmark.llm.bpe_automaton import BpeCodec, bpe_round_trip
from gridmark.llm.queries import vocabulary
from gridmark.llm.token_counts import LONG, pieces, token_counts
from tests.llm.helpers import corpus, frame

PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'s", "é", "ß", "漢", "😀", "1", "22", "!!", "...", "́", "\x1c", "\x85", "\xa0", "<|endoftext|>", "The", "aaaa", "０", "Σ", "İ", "<|startoftext|>", "\x00"]


def odd_texts(n=3000, seed=2):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return made + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(500)] + [c * k for c in "a =-" for k in range(1, 100)]


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_automaton_against_the_library(tokenizers):
    codec, texts = BpeCodec(vocabulary("byte_bpe_50k.json")), odd_texts()
    for text, e in zip(texts, tokenizers["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == e.ids
        assert codec.decode(ids).decode() == text


def test_automaton_decodes_any_ids(tokenizers):
    codec, rng = BpeCodec(vocabulary("byte_bpe_50k.json")), random.Random(1)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert codec.decode(np.array(ids, np.int64)).decode(errors="replace") == tokenizers["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        BpeCodec(vocabulary("word_bpe_49k.json"))


def test_round_trip_query(spark, tokenizers):
    rows = corpus(4, 40) + [(None, "x <|endoftext|> y", None), (1, "same", "s"), (1, "same", "s")]
    found = bpe_round_trip(frame(spark, rows), vocabulary("byte_bpe_50k.json"), ids_too=True, texts_too=True).collect()
    by_text = {}
    for _, text, _ in rows:
        ids = tokenizers["byte_bpe_50k.json"].encode(text or "", add_special_tokens=False).ids
        by_text[text or ""] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == by_text[r.decoded]
    assert bpe_round_trip(frame(spark, rows).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_counts_query(spark, tokenizers):
    rows = corpus(4, 40) + [(None, "x <|endoftext|> y", None), (12345, "word " * 9000, "s"), (12346, "x" * 50000, "s")]
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, rows), vocabulary("word_bpe_49k.json")).collect()}
    for i, text, _ in rows:
        n = len(tokenizers["word_bpe_49k.json"].encode(text or "", add_special_tokens=False).ids)
        assert found[i] == (len((text or "").encode()), n, n > 2048)
    assert token_counts(frame(spark, rows).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces(tokenizers, name):
    count = lambda x: len(tokenizers[name].encode(x, add_special_tokens=False).ids)
    rng, odd = random.Random(7), odd_texts(400, 9)
    for _ in range(20):
        text = " ".join(rng.choice(odd) for _ in range(60))
        cut = pieces(text, 200)
        assert "".join(cut) == text and sum(map(count, cut)) == count(text)
    assert len(pieces("ab cd " * LONG)) > 2 and pieces("") == [""]


def test_sentence_pieces(spark):
    import sentencepiece

    rows = [(1, "Hello world", "s"), (2, None, "s")]
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    found = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, rows), vocabulary("piece_bpe_32k.model")).collect()}
    assert found == {1: len(model.encode("Hello world")), 2: 0}

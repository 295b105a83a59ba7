"""BPE against the library whose vocabulary it reads."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaselight.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.load(open(PATH, encoding="utf-8").read())


def same(model, library, texts):
    flat, counts = model.encode_batch(texts)
    at = 0
    for text, n, want in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False)):
        got = flat[at : at + n].tolist()
        assert got == want.ids, text
        assert model.decode(got) == library.decode(want.ids, skip_special_tokens=False)
        at += n


def test_every_code_point(model, library):
    same(model, library, [f"ab{chr(c)}c1{chr(c)}" + "Ж" * (c % 2) for c in range(0x110000) if not 0xD800 <= c < 0xE000])


def test_random_mixes(model, library):
    rng = random.Random(5)
    parts = ["the", "in", "ing", "er", "a", "b", "ti", "on", "é", "ß", "1", "'s", "'LL", "!!", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "aa", "AAAA", "ΣΑΣ", "İ", "é", "\U0001f600", "</w>", "\x1c"]
    same(model, library, ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(5000)])


def test_long_words(model, library):
    rng = random.Random(6)
    same(model, library, ["a" * 5000, "".join(rng.choices("abcdeing", k=20_000)), "!?" * 3000, "the" * 4000, ""])


def test_proposals_fail_only_where_merging_differs(model):
    rng = random.Random(7)
    words = {"".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(3000)}
    model.known.clear()
    model.learn(words)
    assert all(model.known[w] == model.merge(w) for w in words)


def test_frames(spark, library):
    rows = [(1, "Hello world, it's 2024", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "naïve <|endoftext|> Text", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == 5 and out[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    once = bpe.encode(df, PATH, decoded_col="decoded", drop=("text",))
    assert once.columns == ["doc_id", "ids", "decoded"] and sorted(map(str, once.collect())) == sorted(map(str, bpe.decode(bpe.encode(df, PATH), PATH, drop=("text",)).collect()))
    empty = bpe.encode(df.filter(F.lit(False)), PATH, ids_col="tokens")
    assert empty.columns == ["doc_id", "text", "IDS", "tokens"] and empty.count() == 0


def test_special_tokens_of_another_vocabulary():
    """Which texts may hold special tokens follows from the vocabulary, not from how one family writes them."""
    description = open(PATH, encoding="utf-8").read().replace("<|startoftext|>", "[START]").replace("<|endoftext|>", "~end~")
    model, library = bpe.WordBpe(description), Tokenizer.from_str(description)
    same(model, library, ["a [START] b~end~", "[START]", "[STAR T] ~en", "plain <|endoftext|>", "x~end~~end~y"])

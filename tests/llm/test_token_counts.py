import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelspark.llm.token_counts import LONG, Merger, count_tokens, merger

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


HARD = [
    None, "", "   ", "Hello  WORLD it's I'LL don't", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "ΑΣ Σ ΟΔΟΣ", "İstanbul straße", "é ́x", "x\x1cy\x1dz\x85w v​u t", "日本語テキスト 🎉🎉", "1234 12a b3", "?!?'s 's''t", "\x00\x01", "Ñandú Übermäßig", "ab" * 3000,
]


def test_hard_texts():
    assert merger(PATH).counts(HARD) == expected(HARD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_random_texts(texts):
    assert merger(PATH).counts(texts) == expected(texts)


@pytest.mark.parametrize("text", ["ê{}", "{}ê", "a {} b"])
def test_every_code_point(text):
    texts = [text.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert merger(PATH).counts(texts) == expected(texts)


def test_long_words():
    """Words that the library takes long for as well, of one letter, of few and of many, and two of them at once."""
    r = random.Random(4)
    words = ["".join(r.choices(letters, k=n)) for letters, n in (("a", 5001), ("ab", 4000), ("abcdefghijklmnopqrstuvwxyz", 6000), ("thé日", 3000), ("!?", 2000), ("etaoin", LONG), ("etaoin", LONG + 1))]
    words += [" ".join(words[:2]), words[2] + "1" + words[2]]
    assert Merger(PATH).counts(words) == expected(words)


def test_a_million_letters_take_seconds():
    text, began = "".join(random.Random(5).choices("etaoinshrdlu", k=1_000_000)), time.perf_counter()
    n = Merger(PATH).counts([text])[0]
    assert 200_000 < n < 700_000 and time.perf_counter() - began < 60


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = count_tokens(docs, PATH).toPandas().sort_values("doc_id")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == expected(rows.text.tolist())
    assert got.n_bytes.tolist() == [len(t.encode()) for t in rows.text]
    assert (got.over_limit == (got.n_tokens > 2048)).all()


@pytest.mark.parametrize("n", [0, 3])
def test_nulls_and_clashing_columns(spark, n):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 6), (1, None, 5)][:n], "doc_id long, text string, n_tokens long")
    assert [r.n_tokens for r in count_tokens(docs, PATH).collect()] == [0, 1, 0][:n]

"""The encoder against the library, decoding against its decoder."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsgrist.llm.bpe import BackTrackingBpe, byte_symbols, decode_documents, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def own():
    return BackTrackingBpe(SOURCE)


def same(own, library, text):
    goal = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == goal, text[:80]
    assert own.decode(ids).decode() == library.decode(goal, skip_special_tokens=False)


def test_random_texts(own, library):
    rnd = random.Random(11)
    signs = "abcdefghinorst'  \n\tAEéßñüΣσçИж漢字😀İI!?$%|.,0123<|endoftext|>́"
    for _ in range(4000):
        same(own, library, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))))


def test_every_code_point(own, library):
    """Alone, between letters, and doubled after a digit."""
    signs = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for start in range(0, len(signs), 20_000):
        texts = [t for c in signs[start : start + 20_000] for t in (c, f"a{c}b", f"1{c}{c}!")]
        goals = library.encode_batch(texts, add_special_tokens=False)
        assert [t for t, g in zip(texts, goals) if np.frombuffer(own.encode(t), "<u4").tolist() != g.ids] == []


def test_every_token_of_the_vocabulary(own, library):
    symbols = byte_symbols()
    for name in own.vocab:
        try:
            text = bytes(symbols[c] for c in name.removesuffix("</w>")).decode()
        except UnicodeDecodeError:
            continue
        same(own, library, text)


@pytest.mark.parametrize("text", [
    "", "<|endoftext|>a <|startoftext|> b", "éA", "a\u0085d\x1cq\x1fz", "ﬁ ẞ ǅ ᾈ", "don't I'LL 's'",
    "x" * 3000, "ab" * 800, "ΣΑΣ ας", "\x00\x01", "½²٣", "a" + "́" * 50,
])
def test_cases(own, library, text):
    same(own, library, text)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("newsgrist.llm.bpe.MEMO_WORDS", 3)
    small = BackTrackingBpe(SOURCE)
    for text in ["one two three four five six seven", "six seven eight one two nine"] * 3:
        same(small, library, text)


def test_documents(spark, docs, library):
    rows = [(1, "Hello World"), (2, None), (3, ""), (None, "null id"), (4, "twice"), (4, "twice"), (5, "long word " * 30_000)]
    encoded = encode_documents(spark, docs(rows), SOURCE)
    got = sorted(encoded.collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    goal = sorted(rows, key=lambda r: str(r[0]))
    for row, (doc, text) in zip(got, goal):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row.doc_id, row.n_tokens) == (doc, len(ids))
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = {r.doc_id: r.text for r in decode_documents(spark, encoded, SOURCE).collect()}
    assert texts[1] == "hello</w> world</w>" and texts[2] == ""
    assert encode_documents(spark, docs([]), SOURCE).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError, AttributeError)):
        BackTrackingBpe(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())

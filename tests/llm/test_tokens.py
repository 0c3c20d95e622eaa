import random

import numpy as np
import pytest

from tidewatch.llm import tokens
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("keep", [50, 400_000])
def test_equals_the_library(monkeypatch, plain, keep):
    monkeypatch.setattr(tokens, "_KEEP", keep)
    encoder = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(3)
    alphabet = "abzABZ019 .,'\"-_éÉßñ\t\n\x0b\x1c\x85\xa0ªµ×÷ΑαИ中🙂<|>́"
    said = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    said += ["a<|endoftext|>b", "it's we'LL 'twas", "İstanbul ΣΑΣ", "x " * 5000, "y" * 3000]
    for at in range(0, len(said), 97):
        part = said[at : at + 97]
        assert encoder.encode_many([t.encode() for t in part]) == [plain(t) for t in part]


def test_texts_and_empty_ones(spark, plain):
    encoder = tokens.encoder(tokens.default_vocabulary())
    said = [r.text for r in table(spark, SF, "documents").limit(300).collect()]
    assert encoder.encode_many([t.encode() for t in said]) == [plain(t) for t in said]
    assert encoder.encode_many([None, b"", b" \n\t ", b"\xff\xfe a"]) == [b"", b"", b"", plain("�� a")]
    assert encoder.encode_many([]) == []


def test_each_run_is_encoded_once():
    encoder = tokens.Encoder(tokens.default_vocabulary())
    asked = []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, text):
            asked.append(text)
            return self.model.tokenize(text)

    encoder.words.model = Model(encoder.words.model)
    ids = encoder.encode_many([b"strand Strand, STRAND! strand,strand", "Été été.".encode(), b"strand."])
    assert len(asked) == len(set(asked)) == 5  # strand , ! été .
    assert ids[0].count(encoder.encode_many([b"strand"])[0]) == 5

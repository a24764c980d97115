import random

import numpy as np
import public_tokenizers as P
import pytest

from quire.llm.tokens import encoder, pieces


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    rng = random.Random(1)
    odd = "abZ 's\n\t \x1c1é́́!İΣ​.,²Ⅷ'"
    texts = ["", "  a  b ", "\n\n x\t y   z\x1c q́ ' s it's  \r\n don't <|endoftext|>b", "x" * 3000, " " * 50 + "a" + " " * 3, "'tis, it's!! (don't) e≮"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    letters = "aZéÉßÿÀœŒŁłİıĞſŉÑñ"
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) + rng.choice(["", ",", "'s", "\n", "."]) for _ in range(12)) for _ in range(1000)]
    e = encoder(P.path(name))
    for text, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert "".join(pieces(text)) == text
        assert e.ids(text) == np.asarray(want.ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_untouched_librarys(name):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "the", " ", "\n", "tag", "it's", "é", "!", "<"]
    texts = ["the <|endoftext|> tag", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<<|startoftext|>>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    e = encoder(P.path(name))
    for text, want in zip(texts, Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)):
        assert e.ids(text) == np.asarray(want.ids, "<u4").tobytes(), repr(text)

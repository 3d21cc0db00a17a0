import random

import pyarrow as pa
import pytest

from passagelake.llm import queries, tokens

PARTS = ["a", "bc", " ", " ", "\n", "\t", "\xa0", ".", "'s", "1", "é", "　", "ß", "日", "\x1d", "<|endoftext|>", "Ž", "€", "'", "ª"]


@pytest.mark.parametrize("at_once", [1, 200, 8 << 20])
def test_many_texts_have_the_tokenizers_ids(monkeypatch, at_once):
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", at_once)
    bpe, rng = tokens.ByteBpe(queries.tokenizer_path()), random.Random(1)
    odd = [None, "", " ", "  b", "a b ", "a\n b", "a \nb", "\n \n", "a\x1c b", "a \x1cb", "é \xa0b c\x85 d", "x " + "y" * 3000 + " z", "a<|endoftext|>b c", "日本語 한글 \U0001f600"]
    odd += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [bpe.tokenizer.encode(x or "", add_special_tokens=False).ids for x in odd]
    got = [x.tolist() for x in bpe.encode_all(pa.array(odd, pa.string()))]
    assert got == want and [x.tolist() for x in bpe.encode_all(pa.array(odd).slice(7, 20))] == want[7:27]
    assert list(bpe.encode_all(pa.array([], pa.string()))) == []


def test_a_distinct_chunk_is_encoded_once_for_all_texts():
    bpe, rng, merged = tokens.ByteBpe(queries.tokenizer_path()), random.Random(2), []
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(200)]
    encoding = bpe.encoding

    class Counting:
        def encode_to_numpy(self, text, **kept):
            merged.append(text)
            return encoding.encode_to_numpy(text, **kept)

    bpe.encoding = Counting()
    assert [len(x) for x in bpe.encode_all(pa.array(texts))] == [len(bpe.encode(x)) for x in texts]
    assert sorted(" ".join(merged).split()) == sorted(words)

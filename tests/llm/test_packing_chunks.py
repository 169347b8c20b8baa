import time

import numpy as np

from annolytics.llm import bpe, queries


def encoder(**options):
    """An encoder, and the lists of words that it merges."""
    one, asked = bpe.ChunkEncoder(queries.tokenizer_path(), **options), []
    merged = one.merged
    one.merged = lambda words: asked.append(list(words)) or merged(words)
    return one, asked


def wanted(one, texts):
    return [np.array(e.ids, dtype="<u4").tobytes() for e in one.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_looking_up_chunks_takes_no_time_by_the_size_of_the_memo():
    one, _ = encoder()
    texts = [f"a b c {i}" for i in range(300)]

    def seconds():
        began = time.process_time()
        assert len(list(one.encode(texts, block=1))) == 300
        return time.process_time() - began

    seconds()
    few = seconds()
    one.memo.update((b"key %d" % i, b"") for i in range(90_000))
    assert seconds() < 20 * few + 0.1  # 300 walks through the memo take more than half a second


def test_chunks_in_use_outlive_a_full_memo():
    one, asked = encoder(most=100)
    texts = [f"often {' '.join(f'w{i}x{j}' for j in range(20))} common" for i in range(30)]
    assert list(one.encode(texts, block=1)) == wanted(one, texts)
    words = [w for words in asked for w in words]
    assert words.count(b"often") == words.count(b"common") == 1
    assert len(one.memo) + len(one.older) <= 100


def test_chunks_are_merged_once_in_any_case():
    one, asked = encoder()
    texts = ["Straße straße STRAßE Été ÉTÉ été", "word\nWord\tWORD"]
    assert list(one.encode(texts)) == wanted(one, texts)
    assert sorted(w for words in asked for w in words) == sorted(w.encode() for w in ("straße", "été", "word"))


def test_long_chunks_are_left_to_the_tokenizer():
    one, asked = encoder()
    texts = ["abcdefgh" * 1000 + " short", "Ab" * 128 + " " + "é" * 129]
    assert list(one.encode(texts)) == wanted(one, texts)
    assert sorted(map(len, asked[0])) == [5, 256]


def test_case_that_the_tokenizer_tells_apart():
    one, _ = encoder()
    # special tokens, letters that compose in lower case only, a capital whose lower case is two characters, a final sigma
    texts = ["<|endoftext|> <|ENDOFTEXT|>", "J̌ ǰ H̱ ẖ", "İstanbul i̇", "ΑΣ ας Σ", "DON'T don't IT'S 'S", "ſ ŉ Ÿ × ÷", "\x1c A B C\x85D", ""]
    assert list(one.encode(texts)) == wanted(one, texts)
    assert list(one.encode(texts, block=1)) == wanted(one, texts)

"""Texts on which a polynomial hash modulo 2^64 alone is equal, and encodings of awkward texts."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import quality_rules, textcore, token_output
from quarry.llm.queries import tokenizer_path

from .plain import rules_counts


def thue_morse(n, a, b):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_complementary_strings_differ():
    x, y = (s.encode() for s in thue_morse(4096, "a", "b"))
    buf = np.frombuffer(x + y, np.uint8)
    s = np.array([0, 4096])
    h = textcore.span_hash(textcore.prefix_hash(buf), s, s + 4096)
    assert h[0] != h[1]


def test_equal_spans_have_equal_hashes_anywhere():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(5000))
    for pad in (0, 1, 999, textcore.CHUNK + 5):
        buf = np.frombuffer(b"x" * pad + data, np.uint8)
        at = np.array([0, 17, 400]) + pad
        h = textcore.span_hash(textcore.prefix_hash(buf), at, at + 3000)
        assert pad == 0 or h.tolist() == first
        first = h.tolist()


def test_rules_count_equal_lines_only():
    x, y = thue_morse(1024, "a", "b")
    buf = np.frombuffer(f"{x}\n{y}\n{x}".encode(), np.uint8)
    from quarry.llm.features import Stats

    got = Stats(buf, np.array([0, len(buf)])).counts[0].tolist()
    assert got == list(rules_counts(f"{x}\n{y}\n{x}")) and got[3] == 1
    assert quality_rules.COUNTS[3] == "n_dup_lines"


AWKWARD = [
    *thue_morse(1024, "a", "b"), *thue_morse(2048, "q", "z"), "", " ", "\n", "  \n\n x", "a b 　c  d  e", "it's we'll they'RE 's 'sx ''s don't'll I'd", "x  ", "½ ² Ⅷ ① १२ 12a",
    "日本語のテキスト、です。 \t次", "emoji 👩‍👩‍👧 ok", "tab\there\r\nnew  line ", "'", "'s", " 's", "a's's", "́combining", "é" * 300, "a" * 5000, "0" * 400 + " " * 400 + "!" * 400,
]


@pytest.mark.parametrize("cache", [400_000, 40])
def test_encoder_is_the_library(monkeypatch, cache):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHE_WORDS", cache)
    monkeypatch.setattr(token_output, "RECENT", min(cache, 300))
    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(5)
    encode = token_output.Encoder(tokenizer_path())
    signs = "ab é'sdtm lre\n\t  日12!?_-"
    texts = AWKWARD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for lo in range(0, len(texts), 100):
        data = [t.encode() for t in texts[lo : lo + 100]]
        ids, n = encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        ends = np.cumsum(n)
        for t, a, b in zip(texts[lo : lo + 100], ends - n, ends):
            assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_bytes_that_are_no_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    data = [b"ok \xff\xfe", "é".encode()[:1], b"fine"]
    ids, n = token_output.Encoder(tokenizer_path())(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [tok.encode(d.decode("utf-8", "replace"), add_special_tokens=False).ids for d in data]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_records_survive_their_frames():
    rng = random.Random(9)
    rows = [(None if k == 3 else k, np.array([rng.randrange(1 << rng.choice([8, 16, 20])) for _ in range(rng.randrange(50))], np.uint32)) for k in range(40)]
    data = b"".join(token_output.frame(token_output.pack(i, x)) for i, x in rows)
    back = [token_output.unpack(p) for _, p in token_output.records(memoryview(data))]
    assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in rows]
    assert zlib.crc32(back[0][1].tobytes()) == zlib.crc32(rows[0][1].astype("<u4").tobytes())

"""Texts encoded by columns, against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lanewright.llm.bpe import WordCoder
from lanewright.llm.token_files import ByteCoder

ODD = [None, "", " ", "\n", "a", " a ", "It's  HERE\n\n now ", "'s 'hello ''s I'M we'll'd \"'s", "<|endoftext|> x<|endoftext|>y", "a <| b", "x" * 500, "ab" * 3000, "日本語 😀 É́　 \xa0 y\n", "a\x00b \x00 c", "a\x01b \x01 \x01", "\x1c\x1d a\x85b", "ΣΑΣ Σ İ ǅ ǆ ﬁ Å", "12 3.4 ½ ²x x1y2", "\t\ta\r\n b\n c\n\n", "né́e é ́a"]


@pytest.mark.parametrize("make, name", [(ByteCoder, "byte_bpe_50k.json"), (WordCoder, "word_bpe_49k.json")])
def test_a_column_is_encoded_as_the_library_does(make, name):
    path = public_tokenizers.path(name)
    coder, library, rng = make(path), Tokenizer.from_file(path), random.Random(5)
    signs = [chr(c) for c in [*range(256), *range(0x100, 0x250), *range(0x300, 0x310), *range(0x2000, 0x2070), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640)]]
    pools = [signs, signs[32:127], [*"abcdefgh   \n"], [*"'sdmtrelv \n\t.,"], [*"AbC1 .é́"]]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for pool in pools for _ in range(80)]
    texts += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 14))) for _ in range(400)) for _ in range(20)]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    found = coder.encode_column(pa.array(texts, pa.string()))
    assert [t for t, a, b in zip(texts, found, want, strict=True) if a != b] == []
    assert coder.encode_column(pa.array(texts, pa.string())[7:90]) == want[7:90]
    assert coder.encode_column(pa.array([], pa.string())) == []
    assert len(getattr(coder, "runs", getattr(coder, "known", None))) < 9000, "words that come alone are not kept"

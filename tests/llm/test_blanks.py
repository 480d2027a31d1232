"""White space that sends a text to the library whole."""

import re
import sys

import pytest

from morphloom.llm import bpe


def test_other_blanks_are_all_there_are():
    """op6: a pattern looked at every character of every text."""
    every = re.compile(r"[^\S \n]").findall("".join(map(chr, range(sys.maxunicode + 1))))
    assert every == bpe.OTHER_BLANKS


def test_texts_with_other_blanks_have_the_librarys_ids():
    tokens = pytest.importorskip("public_tokenizers")
    encode = bpe.ByteBpe(str(tokens.path("byte_bpe_50k.json")))
    for c in bpe.OTHER_BLANKS:
        for text in (f"one{c}two three", f"één {c} zwei.", c, f"so{c}\n"):
            assert encode(text) == encode.plain(text)

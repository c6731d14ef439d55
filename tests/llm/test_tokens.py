import unicodedata

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
import cases
from tokenizers import Tokenizer

from tracewright.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_count.TokenCounter(f.read())


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_hard_rows(spark):
    got = token_count.count_tokens(cases.hard(spark), PATH).collect()
    want = sorted(((r[0] is None, r[0] or 0, len((r[1] or "").encode()), expected(r[1] or "")) for r in cases.hard_rows()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_count.count_tokens(cases.empty(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t's'reand1é日  😀ſ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(counter, text):
    assert counter.count(text) == expected(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|endoftext|>\n\n  y", "<|endoftext|", " it's we'll I'D", "a  \n b", "  ", " x"])
def test_special_strings_and_space(counter, text):
    assert counter.count(text) == expected(text)


def test_whole_tokens_are_proved(counter):
    assert len(counter.whole) > 45_000
    for text in counter.whole[:: len(counter.whole) // 500]:
        assert len(LIBRARY.model.tokenize(text.encode().decode("latin-1").translate(counter.signs))) == 1


def test_characters_read_differently_go_to_the_library(counter):
    """Every character on which the pattern and the library's own split differ is one that Python doesn't assign."""
    own, theirs = regex.compile(token_count.PATTERN), LIBRARY.pre_tokenizer
    def differs(chars):
        s = "".join(f"a{c}1{c}{c} {c}." for c in chars)
        return [o for _, o in theirs.pre_tokenize_str(s)] != [m.span() for m in own.finditer(s)]
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    assert not any(differs(known[i : i + 512]) for i in range(0, len(known), 512))


def test_the_cache_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 10)
    texts = [f"qzx{i}wvk" for i in range(100)]
    assert list(counter.count_all(texts)) == [expected(t) for t in texts] and len(counter.counts) <= len(counter.base) + 20


def test_other_vocabularies_are_counted_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        other = token_count.TokenCounter(f.read())
    assert not other.direct and other.count("Hello  World") == len(Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids)

import hashlib
from collections import Counter, defaultdict

import cases
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import token_alignment, token_count

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
BACK = {s: b for b, s in token_count.byte_characters().items()}


def whole(text):
    """(id, first byte, end) of the tokens of both libraries for a whole text; nothing where they don't give its bytes."""
    a = A.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(BACK[s] for s in t) for t in a.tokens]
    b_ids = B.encode(text)
    b_bytes = []
    for i in b_ids:
        p = B.id_to_piece(i)
        b_bytes.append(bytes([int(p[1:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
    data = (" " + text).encode()
    if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return [], []

    def spans(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    return spans(a.ids, a_bytes), spans(b_ids, b_bytes)


def by_hand(rows):
    told, count = [], Counter()
    for i, text in rows:
        a, b = whole(text or "")
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 2000 else walk(a, b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        by_a, by_b = defaultdict(list), defaultdict(list)
        for spans, by in ((a, by_a), (b, by_b)):
            at = 0
            for t, _, e in spans:
                while e > cuts[at]:
                    at += 1
                by[at].append(str(t))
        groups = [f"{','.join(by_a[g])}|{','.join(by_b[g])}" for g in range(len(cuts))]
        count.update(links)
        told.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, na, nb, ng, len(ls), sha, sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls)) for i, na, nb, ng, ls, sha in told), key=repr)


def walk(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


def got(df, **options):
    return sorted((tuple(r) for r in token_alignment.align_tokenizers(df, A_PATH, B_PATH, **options).collect()), key=repr)


TEXTS = ["a", " a", "a ", "  ", "\n", "a\n b\n\n  c \t d\r\n", "<s> </s> <unk> <0x41> <|endoftext|>", "▁ a", "a▁b c", "日本語 と 漢字", "it's we'll DON'T", "  　 x", "a\x1cb \x1c c", "é é ̀", "\0 \x01", "tab\tend\t ", "zwj ‍ x​", "🙂🙂 🙂️"]


@pytest.mark.parametrize("options", [{}, {"salts": 3, "chunk": 400, "matrix": 8 << 20}])
def test_hard_rows(spark, options):
    rows = [(r[0], r[1]) for r in cases.hard_rows()]
    assert got(cases.hard(spark), **options) == by_hand(rows)
    assert got(cases.empty(spark), **options) == []


@pytest.mark.parametrize("options", [{}, {"salts": 2, "chunk": 100}])
def test_texts_and_one_pair_in_all_of_them(spark, options):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"the hot word {cases.prose(i, 12)} " + "the " * (400 if i == 7 else 3), "s") for i in range(150)]
    have = got(cases.docs(spark, rows), **options)
    assert have == by_hand([r[:2] for r in rows])


@pytest.fixture(scope="module")
def aligner():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


def joined(aligner, text):
    (numbers,) = aligner.numbers([text])
    if not text or any(aligner.n_a[u] < 0 for u in numbers):
        return ""
    return ";".join(aligner.groups[u] for u in numbers)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r's'reand1é日  　\x1c\x85😀▁"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
def test_units_give_what_the_libraries_give(aligner, text):
    (row,) = by_hand([(0, text)])
    found = joined(aligner, text)
    assert (hashlib.sha256(found.encode()).hexdigest() if found else "") == row[5]


def test_a_text_is_one_unit_where_places_to_cut_are_not_proved(aligner, monkeypatch):
    monkeypatch.setattr(aligner, "cuts", False)
    for text in TEXTS:
        (row,) = by_hand([(0, text)])
        aligner.units.pop(" " + text, None)
        found = joined(aligner, text)
        assert (hashlib.sha256(found.encode()).hexdigest() if found else "") == row[5], text
    aligner.forget()


def test_both_libraries_for_a_agree(aligner, monkeypatch):
    assert aligner.ranked
    texts = [cases.prose(i, 50) + f" x{i}y <|endoftext|> {'ab' * i} {'aaa ' * i}it's DON'T\t--{i}.{i}%" for i in range(60)]
    fast = [joined(aligner, t) for t in texts]
    aligner.forget()
    monkeypatch.setattr(aligner, "ranked", None)
    assert [joined(aligner, t) for t in texts] == fast
    aligner.forget()


def test_common_units_stay_when_the_cache_is_full(aligner, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 60)
    stripes = token_alignment.Stripes(*aligner.sizes)
    chunks = [[f"the common wörds of it {'ab' * i} r{c}x{i} rär{c}y{i} {'▁' if i == 7 else ''}\n" for i in range(20)] for c in range(5)]
    learned, learn = Counter(), aligner.learn
    monkeypatch.setattr(aligner, "learn", lambda units: (learned.update(units), learn(units)))

    def told(texts):
        figures, blobs = token_alignment._chunk(aligner, stripes, texts)
        return {k: list(v) for k, v in (figures | blobs).items()}, [joined(aligner, t) for t in texts]

    aligner.forget()
    kept = []
    for texts in chunks:
        kept.append(told(texts))
        aligner.thin()
        assert len(aligner.units) == len(aligner.groups) == len(aligner.n_a) == len(aligner.ends) - 1 <= 30
    assert [learned[u] for u in (" the", " common", " wörds", " of", " it")] == [1] * 5
    for texts, before in zip(chunks, kept, strict=True):
        aligner.forget()
        assert told(texts) == before
    aligner.forget()


def test_best_pairs(spark):
    df = cases.docs(spark, [(i, cases.prose(i, 30), "s") for i in range(20)])
    chunks, stripes = token_alignment.encoded(df, A_PATH, B_PATH, matrix=8 << 20)
    have = {(r["b_id"], r["a_id"]): (r["n_links"], r["best"]) for r in token_alignment.best_pairs(token_alignment.pair_counts(chunks, stripes, 2), stripes).collect()}
    count = Counter()
    for i in range(20):
        a, b = whole(cases.prose(i, 30))
        count.update((y, x) for x, y in walk(a, b))
    best = {y: max(n for (z, _), n in count.items() if z == y) for y, _ in count}
    assert have == {p: (n, n == best[p[0]]) for p, n in count.items()}

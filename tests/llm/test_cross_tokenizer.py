"""Alignment of two tokenizers against the libraries and plain Python."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tallyframe.llm import cross_tokenizer as ct
from tallyframe.llm.bpe import byte_symbols
from tallyframe.llm.common import tokenizer_path
from tallyframe.llm.words import steps
from tests.llm.helpers import docs, with_clashes

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

AWKWARD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb\n\nc", "\n a", "<s>x</s> <|endoftext|> <0x0A>", "▁a", "a▁b c", "tab\tand\r\nline",
           "été naïve ﬁ \U0001f600\U0001f600 中文 ภา", "é ́x", " x 　y", "x" * 3000, "a\x00b", "don't we'll  it's",
           "word " * 500, "é" * 50, "1234567 89,000.50", "    indented\n        more", "� "]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {s: b for b, s in enumerate(byte_symbols())}
    spelled = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", name)
        spelled.append(bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode())

    def both(text):
        if not text:
            return [], [], []
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        sa, sb = [bytes(back[x] for x in tok.id_to_token(i)) for i in a], [spelled[i] for i in b]
        if not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            return [], [], []
        ends_b, at = {}, 0
        for k, s in enumerate(sb):
            at += len(s)
            ends_b[at] = k + 1
        out, i, j, at = [], 0, 0, 0
        for k, s in enumerate(sa, 1):
            at += len(s)
            if at in ends_b:
                out.append((a[i:k], b[j:ends_b[at]]))
                i, j = k, ends_b[at]
        return a, b, out
    return both


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def random_texts(n):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "a", "the", "é", "<s>", "中", "ing", "'s", "▁", "1", "\t", "-", "\U0001f600", "Hello", "world", ".", "́"]
    return ["".join(r.choices(parts, k=r.randrange(1, 30))) for _ in range(n)]


def test_windows_match_the_libraries(libraries):
    windows = ct.Windows(A, B)
    texts = AWKWARD + random_texts(3000)
    at = 0
    for _, part in steps(pa.array(texts, pa.string()), 5000):
        for n_a, n_b, n, groups, links in windows.documents(part):
            a, b, want = libraries(texts[at])
            assert (n_a, n_b, n, bytes(groups[:-1]).decode()) == (len(a), len(b), len(want), as_text(want)), texts[at]
            assert len(links) == 8 * n
            at += 1
    assert at == len(texts)


def test_memo_starts_afresh(libraries, monkeypatch):
    monkeypatch.setattr(ct, "MEMO_WINDOWS", 3)
    windows = ct.Windows(A, B)
    for text in random_texts(50):
        for _, part in steps(pa.array([text], pa.string())):
            assert bytes(windows.documents(part)[0][3][:-1]).decode() == as_text(libraries(text)[2])


@pytest.mark.parametrize("at_once", [ct.PAIRS_AT_ONCE, 20])
def test_alignment(spark, libraries, at_once):
    given = [(i, t) for i, t in enumerate(AWKWARD + random_texts(40))] + [(4, "a tie"), (4, "a tie"), (None, "no id")]
    df = with_clashes(docs(spark, given).repartition(3), "links", "pair", "n", "n_a", "groups", "b")
    aligned = [(i, *libraries(t)) for i, t in given]
    count = Counter((a[-1], b[-1]) for *_, groups in aligned for a, b in groups)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for i, a, b, groups in aligned:
        links = [(x[-1], y[-1]) for x, y in groups]
        sha = hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else ""
        want.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                     sum(count[p] for p in links), sha))
    got = ct.alignment(df, A, B, pairs_at_once=at_once).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    texts = {(r.doc_id, r.groups) for r in ct.groups(df, A, B).collect()}
    assert texts == {(i, as_text(g)) for i, _, _, g in aligned}


def test_empty_table(spark):
    assert ct.alignment(docs(spark, []), A, B).count() == 0

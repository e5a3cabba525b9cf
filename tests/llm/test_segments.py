"""Sentences and terms of many texts at once against those of one text."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyloom.llm import segments, subjects


def packed(text):
    return sum(ord(c) << 21 * i for i, c in enumerate(text))


def plain(text):
    """The units of a text, one after the other, from the plain forms."""
    for piece in subjects._pieces(text or ""):
        clauses = subjects._clauses(piece)
        for k, clause in enumerate(clauses or [piece]):
            zh = bool(clauses)
            words = subjects.terms(clause)
            yield k == 0, packed(clause[:3]) if zh else 0, packed(clause[-2:][::-1]) if zh else 0, len(words), [w for w in words if segments.LETTER_PAIR.fullmatch(w)]


def check(texts):
    u = segments.units(texts)
    ends = np.append(0, np.cumsum(u.size))
    names: dict[int, str] = {}
    for d, text in enumerate(texts):
        rows = np.flatnonzero(u.doc == d)
        want = list(plain(text))
        assert [(bool(u.opens[i]), int(u.head[i]), int(u.tail[i]), int(u.size[i])) for i in rows] == [w[:4] for w in want], text
        for i, w in zip(rows, want):
            pairs = [k for k in u.terms[ends[i] : ends[i + 1]].tolist() if k < segments.WORDS_FROM]
            assert sorted(pairs) == sorted(ord(p[0]) << 21 | ord(p[1]) for p in w[4])
    for text in texts[:300]:  # one number for each word
        for word in set(subjects.terms(text or "")):
            key = segments.units([word]).terms[0]
            assert names.setdefault(int(key), word) == word


def test_documents(small):
    check(pq.read_table(f"{small}/documents.parquet")["text"].to_pylist() + [None, "", " \n", "x" * 5000, "```\ncode\n", "~~~\na\n~~~\nAfter it."])


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    rng = random.Random(seed)
    bits = ["a", "b'", "Ab", "A ", "x. ", "y.Z", ". ", "! ", "?", "“", "”", "'", "\"", ")", "(", "[", "]", "。", "！", "，", ",", "的", "了", "模块", "接口", "\n", "\n\n", "# ", "## h", "|", "---", "* ", "- ", "12. ", "3:04 ", "[00:12]", "User: ", "用户：", "```", "~~~\n", "$$", "<!--", "　", "\t", "Zed", "I", "don't", "low-cost", "𝒳", "é", "9", " "]
    check(["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(60)])


def test_long_texts_are_cut_at_line_ends(monkeypatch):
    text = "First it ran. Then it\n```\nno. No.\n\nstill no\n```\nstopped at once\n如果出错，请检查。\n" * 50
    whole = segments.units([text, "Another one."])
    monkeypatch.setattr(segments, "BLOCK_CHARS", 64)
    parts = segments.units([text, "Another one."])
    assert all((getattr(whole, f) == getattr(parts, f)).all() for f in (*segments.Units.FIELDS, "terms"))


def test_sums_in_few_and_many_members(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, row = rng.standard_normal((50, 4)).astype(np.float32), rng.integers(0, 50, 3000)
    index, weights = np.sort(np.append(rng.integers(0, 40, 1000), np.full(2000, 7))), rng.random(3000).astype(np.float32)
    for step in (1024, 16):
        monkeypatch.setattr(subjects, "STEP", step)
        for w in (None, weights):
            want = np.zeros((41, 4))
            np.add.at(want, index, vectors[row] * (1 if w is None else w[:, None]))
            assert np.allclose(subjects._embedded(vectors, row, index, 41, w), want, atol=1e-3)

import pytest

from fieldmark.llm import words


def test_hashes():
    texts = ["a", "B", "b", "ab", "ba", "é", "É", "x" * 3000]
    h, starts, ends = words.word_hashes(" ".join(texts).encode())
    assert h[1] == h[2] and len(set(h.tolist())) == len(texts) - 1
    assert starts.tolist()[:4] == [0, 2, 4, 6]
    assert len(words.word_hashes(b"")[0]) == 0


@pytest.mark.parametrize("chunk", [4, 10, 1 << 20])
def test_rows_and_places(chunk, monkeypatch):
    monkeypatch.setattr(words, "CHUNK", chunk)
    texts = [b"", b" a\tbb  ccc ", b"", b"\x1cx\xc2\xa0y", b"d" * 50, b" "]
    found = words.words_of(texts)
    got = [(r, found.data[a:b]) for r, a, b in zip(found.row.tolist(), found.start.tolist(), found.end.tolist())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in t.split(None)]
    whole = words.words_of([b" ".join(w for _, w in got)])
    assert whole.hash.tolist() == found.hash.tolist()

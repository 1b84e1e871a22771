"""Words cut into pieces at once."""

import numpy as np
import pyarrow as pa
import pytest

from phasefold.llm import base, pieces, token_output

P = pytest.importorskip("public_tokenizers")
ODD = ["don't", "'s", "x'LL", "<|endoftext|>", "a<", "|b", "İstanbul", "ΑΣ", "日本", "áb", "a­b", "x y", "a\x00b", "</w>", "Ⱥ1Ǆ", "12ab--", "é²½"]


def test_many_words_are_cut_as_each_one():
    words = ODD + [a + chr(c) + "1" for c in range(0x21, 0x400) for a in ("", "A", "é", "-")]
    here, cuts, n = pieces.cut_many(base.strings(pa.array(words)))
    assert here.any() and not here.all()
    at = base.starts_of(n)
    got = [cuts.to_pylist()[a:b] for a, b in zip(at, at[1:])]
    assert got == [pieces.cut_text(w) for w, x in zip(words, here) if x]
    # only apostrophes and what the library has to tell are left out, or a sign that meets the next word's
    left = [w for w, x in zip(words, here) if not x]
    assert all("'" in w or pieces.cut_text(w) is None or "İ" in w or w == "a<" for w in left), left


def test_plain_words_are_not_cut_one_by_one(monkeypatch):
    """Cutting word by word took op7_token_output beyond its CPU seconds."""
    each = []
    for name in ("cut", "cut_text"):
        monkeypatch.setattr(pieces, name, lambda w, f=getattr(pieces, name, None): each.append(w) or f(w), raising=False)
    e = token_output.Encoder(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcEéñß,.12"), rng.integers(1, 9))) for _ in range(2_000)]
    texts = [" ".join(plain[i : i + 100]) for i in range(0, 2_000, 100)] + [None, "", " \n", " ".join(ODD), *ODD]
    want = [x.ids for x in e.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # new words, then remembered ones
        ids, n = e.encode(base.strings(pa.array(texts, pa.string())))
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    assert set(each) <= set(ODD)

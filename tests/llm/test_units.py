"""Parts of the training-data operators that need no Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from retentia.llm import bpe, chat, langid, packing, recompression, toxicity, words
from retentia.llm.balltree import Tree

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODER = bpe.Encoder(bpe.Vocabulary(RANKS), public_tokenizers.PATTERN)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(st.one_of(st.sampled_from("ab thein'\n\t 0é!"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_tiktoken(text):
    ids = ENCODER.encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


def test_bpe_long_piece_and_empty():
    assert ENCODER.encode(None) == ENCODER.encode("") == []
    text = "ab" * 3000
    assert ENCODER.encode(text) == ENCODING.encode_ordinary(text)


def test_bpe_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "STEP", 3)
    text = "one two three four, five!  six"
    assert ENCODER.encode(text) == ENCODING.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=300), st.integers(0, 300), st.integers(0, 300), st.binary(max_size=8))
def test_bpe_append_and_replace_are_exact(a, b, i, j, new):
    p = bpe.Prefixes(ENCODER.vocabulary, a)
    p.append(b)
    assert p.last == bpe.Prefixes(ENCODER.vocabulary, a + b).last
    i, j = sorted((min(i, len(a + b)), min(j, len(a + b))))
    p.replace(i, j, new)
    assert p.data == (a + b)[:i] + new + (a + b)[j:]
    assert p.last == bpe.Prefixes(ENCODER.vocabulary, p.data).last


def test_bpe_edit_recomputes_only_near_the_edit():
    p = bpe.Prefixes(ENCODER.vocabulary, b" the quick brown fox jumps over the lazy dog" * 40)
    assert p.replace(100, 103, b"cat") < 400
    assert ENCODER.decode(p.tokens()) == p.data


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_tokenizer(text):
    w = _word_ids()
    assert list(w.ids(text)) == w.tokenizer.encode(text, add_special_tokens=False).ids


def _word_ids(memo=[]):
    if not memo:
        memo.append(packing.WordIds(public_tokenizers.path("word_bpe_49k.json")))
    return memo[0]


def test_word_ids_special_cases(monkeypatch):
    w = _word_ids()
    for t in ["it's WE'LL <|endoftext|>x", "ΑΣ ΣΑΣ", "İstanbul e\u0301", "a\u200bb\xa0c\x1cd\x85e", "", "A a"]:
        assert list(w.ids(t)) == w.tokenizer.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "LONG_TEXT", 8)
    assert list(w.ids("some longer text, cut")) == w.tokenizer.encode("some longer text, cut", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_keeps_pieces_and_capacity(lengths):
    x = np.array(lengths, np.int64)
    start = packing.best_fit(x, 100)
    end = packing.local_search(x, start, 100) if len(x) else start
    fill = np.bincount(end, x) if len(x) else np.zeros(0)
    assert (fill <= 100).all() and len(end) == len(x)
    assert len(np.unique(end)) <= len(np.unique(start))


def test_local_search_empties_bins():
    # Bins 6+2, 5+3, 4+4 (room 2 each) and 5: exchanges make three bins of ten and leave none over.
    x = np.array([6, 2, 5, 3, 4, 5, 4, 1], np.int64)
    start = np.array([0, 0, 1, 1, 2, 3, 2, 3])
    end = packing.local_search(x, start, 10)
    assert len(np.unique(end)) == 3 and (np.bincount(end, x) <= 10).all()


def test_word_names_match_words():
    h = words.WordHasher()
    texts = ["a b  a\tb\n", None, "", " lead trail ", "x" * 200_000 + " y " + "z " * 90_000, "é\u00a0b c"]
    names, ends = words.batch_names(h, texts)
    plain = [(t or "").encode().split() for t in texts]
    assert np.diff(ends).tolist() == [len(p) for p in plain]
    seen = {}
    for n, w in zip(names.tolist(), [w for p in plain for w in p]):
        assert seen.setdefault(w, n) == n
    assert len(set(seen.values())) == len(seen)
    low, _ = words.batch_names(words.WordHasher(lower=True), ["AbC É", "abc É"])
    assert low[0] == low[2] and low[1] == low[3]


def test_equal_windows_have_equal_anchors():
    rng, h = random.Random(5), words.WordHasher()
    for _ in range(150):
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        docs = [[rng.choice(letters) for _ in range(rng.randrange(60))] for _ in range(rng.randrange(1, 6))]
        d = rng.choice(docs)
        docs.append(d[rng.randrange(len(d) + 1):] + rng.choice(docs) + d)
        names, ends = words.batch_names(h, [" ".join(x) for x in docs])
        found, seen = recompression.anchors(names, ends, 13), {}
        for k, x in enumerate(docs):
            for p in range(len(x) - 12):
                assert seen.setdefault(tuple(x[p:p + 13]), found[ends[k] + p]) == found[ends[k] + p]


def test_high_levels_shrink():
    names, ends = words.batch_names(words.WordHasher(), [" ".join(f"w{i % 97}" for i in range(4000))])
    sizes = [len(s.name) for s in recompression.levels(names, ends, 6)]
    assert all(b < a for a, b in zip(sizes, sizes[1:])) and sizes[-1] < sizes[0] / 3


@pytest.mark.parametrize("copies", [0, 300])
def test_ball_tree_is_exact(copies):
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (700, 16)).astype(float)
    x[:copies] = x[0]
    ids = rng.permutation(700)
    tree = Tree(ids, x)
    for q in range(0, 700, 35):
        scores = (x @ x[q]).astype(int)
        best = sorted(((-s, i) for s, i in zip(scores, ids) if i != ids[q]))[:10]
        assert tree.search(x[q], int(ids[q]), 10, None) == [(-s, -i) for s, i in best]
        known = -best[-1][0]
        assert tree.search(x[q], int(ids[q]), 10, known) == [(-s, -i) for s, i in best]


def _two_languages():
    counts = {"haus": np.array([5.0, 0.0]), "house": np.array([0.0, 5.0])}
    words_ = langid._table(counts, np.array([5.0, 5.0]))
    grams = {n: {} for n in range(1, 6)}
    for w, c in counts.items():
        for n in grams:
            for g in langid.grams(w, n):
                grams[n][g] = grams[n].get(g, 0) + c
    tables = {n: langid._table(g, sum(g.values())) for n, g in grams.items()}
    return langid.Model(["de", "en"], {0: words_[0]}, {0: words_[1]}, {n: t[0] for n, t in tables.items()}, {n: t[1] for n, t in tables.items()})


def test_langid_backoff_uses_shorter_grams():
    s = langid.Scorer(_two_languages())
    assert s.predict("haus")[0] == "de" and s.predict("house")[0] == "en"
    assert s.predict("hausen")[0] == "de" and s.predict("ouse")[0] == "en"
    assert s.predict("12 !!") == s.predict(None) == ("und", 0.0)


def test_langid_batches_equal_single_texts(monkeypatch):
    """Whatever the number of words taken at once, and also while the memory is emptied."""
    texts = ["haus", None, "house of hausen", "", "12", "qqq zzz", "ouse aus haus " * 40, "h", "hausen " * 7 + "house"]
    alone = [langid.Scorer(_two_languages()).predict(t) for t in texts]
    for step, room in ((50_000, 200_000), (3, 200_000), (7, 2), (1, 1)):
        monkeypatch.setattr(langid, "STEP_WORDS", step)
        monkeypatch.setattr(langid, "MEMO_WORDS", room)
        got = langid.Scorer(_two_languages()).predict_all(texts)
        assert [g[0] for g in got] == [a[0] for a in alone]
        assert np.allclose([g[1] for g in got], [a[1] for a in alone])
    assert langid.Scorer(_two_languages()).predict_all([]) == []


def test_counterfactual_penalty_protects_group_mentions():
    """The labels connect a group with abuse by chance; the penalty takes that weight away, but not the abuse's."""
    rows = []
    for i in range(300):
        abusive = i % 3 == 0
        text = ("muslim " if abusive or i % 10 == 1 else "christian " if i % 10 < 4 else "") + ("idiot " if abusive else "") + f"w{i % 7}"
        rows.append((int(abusive), set(text.split())))
    names = sorted({f for w in ["muslim", "christian", "idiot", *toxicity._OTHERS] for f in toxicity.features(w)})
    scorer = toxicity.Scorer(toxicity.Model(names, np.zeros(len(names)), 0.0))
    data = [(y, scorer.indices(w), [scorer.indices(c) for c in toxicity.counterfactuals(w)]) for y, w in rows]

    def mention(penalty):
        w, b = toxicity._weights(data, len(names), penalty)
        s = toxicity.Scorer(toxicity.Model(names, w, b))
        return s.score("muslim people"), s.score("muslim idiot")

    free, held = mention(0.0), mention(5.0)
    assert held[0] < free[0] and held[1] > 0.5 > held[0]


def test_escape_template_constants():
    assert chat.MARKS == len("<s>[ROLE]\n\n[/ROLE]\n\n</s>\n")

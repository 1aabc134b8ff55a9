"""Manifest, phrases and token counts against brute force, on awkward rows and small parameters."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.llm import merkle, phrases, token_counts
from retentia.llm.frames import hold, ship
from retentia.session import staging_path

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, LIBRARY = token_counts.Tokenizer(BYTE_LEVEL), tokenizers.Tokenizer.from_file(BYTE_LEVEL)
TEXTS = ["a b\nc", "a b\nc", None, "", " ", "x", "A b. a b, a b; A B a b", "long text. " * 20_000, "\t\n", "z\rz\x0bz", "é ü é ü"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, columns named like the operators' own."""
    ship(spark)
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, i if i % 2 else None) for i, t in enumerate(TEXTS)]
    rows += [(3, "", "en", "s1", 1), (3, "", "en", "s1", 1), (None, None, None, None, None), (None, "a b", "de", "s1", 2), (None, "a b", "de", "s1", 2)]
    rows += [(100 + i, random.Random(i).choice(["p q r", "p q\nr s", "q r. p q r s"]), "fr", "large", 7) for i in range(70)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return hold(made.withColumns({c: F.lit(1) for c in (
        "tree", "place", "size", "digest", "leaf", "left", "path", "root", "spread", "part", "salt", "name", "words", "shard", "phrase", "f", "a", "n_bytes")}))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(r, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def _climb(nodes, arity):
    """The root of a list of digests, and the (left, right) siblings of each on the way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % arity:k - k % arity + arity]
            paths[i].append((run[:k % arity], run[k % arity + 1:]))
        at = [k // arity for k in at]
        nodes = [_h("".join(nodes[k:k + arity])) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_brute_force(odd, nothing, arity):
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(odd, tampered, arity).collect()
    rows = odd.select("doc_id", "source", "lang", "n_chars", "text").collect()
    by_source = {}
    for r in rows:
        other = r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and r.doc_id % 2 == 0 else r.text
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), _leaf(r, other), r.doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _climb([x[2] for x in sorted(by_source[s])], arity) for s in names}
    root, over = _climb([trees[s][0] for s in names], arity)
    want = Counter()
    for s, up in zip(names, over):
        for (_, _, leaf, other, doc_id), path in zip(sorted(by_source[s]), trees[s][1]):
            acc = other
            for left, right in path + up:
                acc = _h("".join(left) + acc + "".join(right))
            proof = _h("".join("".join(left + right) for left, right in path + up))
            want[(doc_id, leaf, trees[s][0], root, proof, acc, acc == root)] += 1
    mine = Counter((r.doc_id, *(bytes(x).hex() for x in (r.leaf, r.subroot, r.root, r.proof, r.folded_root)), r.verified) for r in got)
    # Rows with equal leaves are interchangeable: they may change places, and so proofs, with each other only.
    assert mine == want
    assert {r.verified for r in got} == {True, False}
    assert merkle.manifest(nothing).count() == 0


def test_manifest_of_one_row_and_untampered(odd):
    r = odd.where("doc_id = 5")
    got, = merkle.manifest(r).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified
    assert bytes(got.proof).hex() == _h("")
    assert merkle.manifest(odd).where("NOT verified").isEmpty()


def _brute_phrases(rows, threshold, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    inside = Counter()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * inside[lang, p] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return Counter((lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
                   for lang, x in out.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("bits, block, shards", [(12, 200, 3), (6, 200, 4), (20, 1 << 20, 1), (12, 60, 7)])
def test_phrases_brute_force(spark, odd, nothing, monkeypatch, bits, block, shards):
    """Also with a table so small that most phrases share a place, and with pieces longer than a block."""
    monkeypatch.setattr(phrases, "TABLE_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "SHARDS", shards)
    rng = random.Random(bits)
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect() if len(r.text or "") < 1000]
    for i in range(300):
        w = []
        for _ in range(rng.randrange(9)):
            w += rng.choice([["red", "fox"], ["the", "Red", "fox", "ran"], ["the"], [f"u{rng.randrange(40)}"], ["of", "the", "king."], ["a\tb", "c,d"]])
            w += rng.choice([[], [], ["!"], ["\n"]])
        rows.append((" ".join(w), rng.choice(["en", "en", "de", None, "und"])))
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"words": F.lit(1), "phrase": F.lit("x")}).repartition(5)
    want = _brute_phrases(rows, 7, 4, 10)
    got = Counter(map(tuple, phrases.collocations(docs, top=10, threshold=7).collect()))
    assert got == want and len(want) > 15
    assert phrases.collocations(nothing).count() == 0


def test_phrases_scores_pass_64_bits(spark):
    ship(spark)
    rows = [("x", "a", 1, 3 * 10**13), ("x", "b", 1, 4 * 10**13), ("x", "a b", 2, 2 * 10**13 + 1)]
    got, = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert (got.l, got.r, got.score) == (3 * 10**13, 4 * 10**13, 2_000_000 * (2 * 10**13 + 1) // (7 * 10**13))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, odd, nothing, name):
    path = public_tokenizers.path(name)
    docs = odd.select("doc_id", "text", "name", "n_bytes", "digest").union(spark.createDataFrame(
        [(900, "<|endoftext|> x </s><s>", 1, 1, 1), (901, "<|endoftext|> x </s><s>", 1, 1, 1)], "doc_id long, text string, a int, b int, c int"))
    if name.endswith(".model"):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(p.encode(t))
    else:
        t = tokenizers.Tokenizer.from_file(path)
        size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text or ""), size(r.text or "") > 9) for r in docs.select("doc_id", "text").collect())
    cache = staging_path(spark, "cache")
    assert token_counts.count(nothing, path, cache).count() == 0
    assert Counter(map(tuple, token_counts.count(docs, path, cache, limit=9).collect())) == want
    assert Counter(map(tuple, token_counts.count(docs, path, cache, limit=9).collect())) == want


def test_token_counts_encode_distinct_misses_only(spark, odd, monkeypatch):
    path, cache, seen = public_tokenizers.path("byte_bpe_50k.json"), staging_path(spark, "cache"), []
    real = token_counts.encoded

    def watched(texts, path):
        texts = hold(texts)
        seen.append([r.text for r in texts.collect()])
        return real(texts, path)

    monkeypatch.setattr(token_counts, "encoded", watched)
    docs = odd.select("doc_id", "text")
    distinct = {r.text or "" for r in docs.collect()}
    token_counts.count(docs.where("doc_id < 100 OR doc_id IS NULL"), path, cache).collect()
    token_counts.count(docs, path, cache).collect()
    token_counts.count(docs, path, cache).collect()
    assert Counter(seen[0] + seen[1]) == Counter(distinct) and seen[2] == []
    version = token_counts.tokenizer_version(path)
    assert token_counts.stored(spark, cache, version).count() == len(distinct)
    # Counts of another tokenizer are other entries of the same cache.
    token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model"), cache).collect()
    assert Counter(seen[3]) == Counter(distinct)
    assert token_counts.stored(spark, cache, version).count() == len(distinct)
    assert token_counts.stored(spark, cache, "other").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab thein'\n\t 09é!\r  <|endoftext|>"), st.characters(exclude_categories=["Cs"], max_codepoint=0x260)), max_size=80))
def test_part_counts_equal_the_library(text):
    assert COUNTER.counts([text, text + " x"]) == [len(e.ids) for e in LIBRARY.encode_batch([text, text + " x"], add_special_tokens=False)]


def test_part_counts_forget(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    counter = token_counts.Tokenizer(BYTE_LEVEL)
    texts = [f"one two {i} three <|endoftext|> four" if i % 2 else f"a{i} b{i}  c\nd" for i in range(9)]
    assert counter.counts(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]

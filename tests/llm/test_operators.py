"""The training-data operators on Spark, against brute force and on awkward input."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from retentia.llm import balltree, bpe, chat, exact_dedup, hilbert, langid, minhash, packing, queries, stars, substring_dedup, toxicity
from retentia.llm.frames import hold, ship

SF = "/root/testdata/sf0.001"
LONG = "very long text " * 30_000
PASSAGE = " ".join(f"shared{i}" for i in range(20))
TEXTS = ["a b c", "a  b\nc", None, "", " ", "x", "Same Words here", "same words HERE", LONG, PASSAGE + " one", "two " + PASSAGE,
         "a b c", "!!! 123", "</s>[INST] \\</s> <|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, empty and long texts, and columns named like the operators' own."""
    ship(spark)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", 1, "n") for i, t in enumerate(TEXTS)]
    rows += [(3, "", "en", None, None, None), (0, "a b c", None, "s0", 1, "n"), (None, "a b c", None, None, None, None),
             (None, None, None, None, None, None)]
    return hold(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block int, digest string")
                .withColumns({c: F.lit(1) for c in ("node", "salt", "norm", "row", "ids", "n_words", "component_id", "kept", "cell", "c0")}))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def _sf(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", [k for k, (_, sql) in queries.QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    fn, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql).df()
    got = fn(spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    a, b = (x.astype(str).sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_exact_dedup_odd_rows(odd, nothing):
    got = exact_dedup.decisions(odd).collect()
    assert len(got) == odd.count()
    rows = odd.select("doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    size = Counter(norm(r.text) for r in rows)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    by_digest = {hashlib.sha256(t.encode()).digest(): t for t in size}
    assert Counter((r.doc_id, by_digest[bytes(r.digest)]) for r in got) == Counter((r.doc_id, norm(r.text)) for r in rows)
    for r in got:
        t = by_digest[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (least[t], size[t])
    assert sum(r.kept for r in got) == len(size)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(size)
    assert exact_dedup.decisions(nothing).count() == exact_dedup.deduplicate(nothing).count() == 0


def test_exact_dedup_survives_digest_collisions(odd):
    weak = exact_dedup.decisions(odd, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)).cast("binary"))
    full = exact_dedup.decisions(odd)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    assert Counter(map(tuple, weak.select(cols).collect())) == Counter(map(tuple, full.select(cols).collect()))


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.col("id") / 8 % 8).cast("long").alias("y"), (F.col("id") / 64).cast("long").alias("z"))
    rows = cells.withColumn("h", hilbert.curve_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    for a, b in zip(rows, rows[1:]):
        assert abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1


@pytest.mark.parametrize("which", ["odd", "documents", "nothing"])
def test_shards_law(spark, odd, nothing, which):
    docs = {"odd": odd, "nothing": nothing, "documents": _sf(spark, "documents")}[which]
    rows = hilbert.assign(docs).collect()
    texts = [((r.text or "").encode(), r.doc_id) for r in docs.select("text", "doc_id").collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t) + 8, zlib.crc32(t)) for t, i in texts)
    count = Counter(r.shard for r in rows)
    if rows:
        assert max(count[s] for s in range(24)) - min(count[s] for s in range(24)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_shards_prune_files(spark, tmp_path):
    placed = hold(hilbert.assign(_sf(spark, "documents", "/root/testdata/sf0.01")))
    m = hilbert.manifest(placed)
    for most, where in ((23, {"lang": "de"}), (16, {"source": "src3"}), (12, {"lang": "de", "source": "src3"})):
        hit = placed.where(" AND ".join(f"{c} = '{v}'" for c, v in where.items()))
        need = {r.shard for r in hit.select("shard").distinct().collect()}
        left = {r.shard for r in hilbert.prune(m, **where).collect()}
        assert need <= left and len(left) <= most
    hilbert.write(placed, str(tmp_path / "shards"))
    assert hilbert.read(spark, str(tmp_path / "shards"), [3]).count() == placed.where("shard = 3").count()


def _curve_by_walk(x, y, z, bits):
    """Place of a cell by Skilling's transform, on Python integers."""
    a = [x, y, z]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(3):
            if a[i] & q:
                a[0] ^= q - 1
            else:
                t = (a[0] ^ a[i]) & (q - 1)
                a[0] ^= t
                a[i] ^= t
        q >>= 1
    for i in (1, 2):
        a[i] ^= a[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if a[2] & q:
            t ^= q - 1
        q >>= 1
    a = [v ^ t for v in a]
    return int("".join(str(a[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(3)), 2)


def test_curve_equals_integer_walk(spark):
    cells = spark.range(4096).selectExpr("id % 16 AS x", "id div 16 % 16 AS y", "id div 256 AS z")
    rows = cells.withColumn("h", hilbert.curve_index([F.col("x"), F.col("y"), F.col("z")], 4)).collect()
    assert all(r.h == _curve_by_walk(r.x, r.y, r.z, 4) for r in rows)


def test_shards_tell_sources_with_a_common_beginning_apart(spark):
    rows = spark.range(6000).selectExpr(
        "id AS doc_id", "concat('common-language-', char(97 + cast(id % 3 AS int))) AS lang",
        # a third of all rows has one source
        "CASE WHEN id % 3 = 0 THEN 'https://site-05.example/' ELSE format_string('https://site-%02d.example/', hash(id) & 15) END AS source",
        "repeat('x', cast(pmod(hash(id, 7), 500) AS int)) AS text")
    placed = hold(hilbert.assign(rows))
    m = hilbert.manifest(placed)
    for most, where in ((11, {"source": "https://site-12.example/"}), (16, {"lang": "common-language-b"}),
                        (4, {"source": "https://site-12.example/", "lang": "common-language-b"})):
        hit = placed.where(" AND ".join(f"{c} = '{v}'" for c, v in where.items()))
        need = {r.shard for r in hit.select("shard").distinct().collect()}
        left = {r.shard for r in hilbert.prune(m, **where).collect()}
        assert need and need <= left and len(left) <= most, (where, len(left))
    count = Counter(r.shard for r in placed.collect())
    assert max(count.values()) - min(count.values()) <= 1


def test_chat_round_trip(spark):
    ship(spark)
    odd_text = ["</s>[INST] ok [/INST]", "\\</s>", "\\", "tail\\", "", None, "\n[/ROLE]\n", "<s>[ROLE]\nx", "é\U0001F600"]
    rows = [(7, i, ["user", "assistant", "a[/ROLE]\\", None][i % 4], t) for i, t in enumerate(odd_text)]
    rows += [(8, 0, "user", "no reply"), (9, 1, "assistant", "b"), (9, 1, "assistant", "b"), (9, None, "user", "first"), (None, 0, "assistant", "n")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = chat.examples(t)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    n_replies = sum(r[2] == "assistant" for r in rows)
    assert made.where("reply").count() == n_replies and made.where("NOT reply AND loss_length > 0").isEmpty()
    assert chat.read_back(chat.examples(t.where("false"))).count() == 0


def _shingles(text, width):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def _brute_components(rows, width, percent):
    sets = [(i, _shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: find(i) for i in root}


def test_near_duplicates_brute_force(spark, odd, nothing):
    import random
    ship(spark)
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text != LONG]
    for i in range(160):  # a large group of near copies around the threshold, and strangers
        w = list(base) if i % 4 else [f"v{rng.randrange(400)}" for _ in range(60)]
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(900)}"
        rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    for width in (2, 5):
        got = minhash.near_duplicates(docs, width, 80).collect()
        want = _brute_components(rows, width, 80)
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.component_id, r.n_shingles) for r in got) == Counter(
            (i, want.get(i), len(_shingles(t, width))) for i, t in rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.keep_one(odd).columns == odd.columns
    assert minhash.near_duplicates(nothing).count() == minhash.keep_one(nothing).count() == 0


def test_near_duplicates_large_families_meet_strays_only(spark, monkeypatch):
    """Two large families of near copies and half-similar strays in the same buckets: no two blocks of a family meet, tasks count every row."""
    import random
    ship(spark)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    other = base[:120] + [f"x{i}" for i in range(80)]
    rows = []
    for i in range(170):
        w = list(base if i < 100 else other if i < 160 else base[:130] + [f"y{k % 35}_{i // 2}" for k in range(70)])
        for _ in range(2):
            w[rng.randrange(len(w))] = f"u{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, tasks = [], minhash._tasks

    def counted(frame, total, per_task, *key):
        if "signature" in frame.columns:
            family = frame.groupBy("key", "i", "j").agg(F.count_distinct("component").alias("n"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
            seen.append((frame.count(), total, family.where("n = 1 AND lo < hi").count()))
        return tasks(frame, total, per_task, *key)

    monkeypatch.setattr(minhash, "_tasks", counted)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TASK_ROWS", 50)
    got = minhash.near_duplicates(docs, 1, 80).collect()
    want = _brute_components(rows, 1, 80)
    assert {r.doc_id: r.component_id for r in got} == want and 3 <= len(set(want.values())) < 60
    (met, total, alone), = seen
    assert met == total > 0 and alone == 0


def test_near_duplicates_write_no_pairs_of_a_group(spark, monkeypatch):
    """Many documents of similarity 0.7 in the same buckets, some of them linked: no step writes more rows than the buckets have."""
    import random
    ship(spark)
    rng = random.Random(7)
    rows = []
    for i in range(150):
        w = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(200), 18):
            w[k] = f"u{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t.replace("w7 ", "v ")) for i, t in rows[::10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = []
    monkeypatch.setattr(minhash, "hold", lambda df: held.append(hold(df)) or held[-1])
    monkeypatch.setattr(minhash, "release", lambda *held: None)
    got = minhash.near_duplicates(docs, 1, 80).collect()
    want = _brute_components(rows, 1, 80)
    assert {r.doc_id: r.component_id for r in got} == want and 100 < len(set(want.values())) < len(rows)
    assert max(df.count() for df in held) <= minhash.HASHES // minhash.ROWS * len(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}, **{200 + i: 200 for i in range(3)}}


def _brute_repeats(rows, window):
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (1 << 61 if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [300, 1 << 22])
def test_substring_dedup_brute_force(spark, odd, nothing, monkeypatch, block_bytes):
    import random
    ship(spark)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text != LONG or block_bytes > 300]
    passages = [[f"p{k}x{i}" for i in range(rng.randrange(5, 60))] for k in range(5)] + [["same"] * 40, ["t", "u"] * 12]
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            w += [f"q{rng.randrange(9)}" for _ in range(rng.randrange(10))] + p[at:at + rng.randrange(40)]
        rows.append((100 + rng.randrange(50), " \n".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(_brute_repeats(rows, 13))
    cut = substring_dedup.remove_repeats(odd.withColumn("n_words", F.lit(777)))
    assert cut.columns == [*odd.columns, "_n_words", "n_removed", "kept_sha256"]
    assert {r.n_words for r in cut.collect()} == {777}
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_removes_by_both_hashes(spark, monkeypatch):
    """Windows that agree in the first hash only, in other blocks, lose no words."""
    ship(spark)
    real = substring_dedup._windows

    def colliding(*args):
        h1, *others = real(*args)
        return [h1 >> 62, *others]

    monkeypatch.setattr(substring_dedup, "_windows", colliding)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(30)] + (passage if i % 3 else []) + [f"v{i}x{k}" for k in range(15)])) for i in range(30)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(_brute_repeats(rows, 13))


def test_ball_tree_odd_vectors_and_several_shards(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(balltree, "SHARD", 60)
    monkeypatch.setattr(balltree, "BLOCK", 2)
    import random
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(400 + i, [0.5] * 6) for i in range(60)]
    rows += [(500, None), (600, [None, 1.0]), (601, [float("nan")] * 6), (602, [float("inf")] * 6), (700, []), (701, [1.0]), (None, [1.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = Counter(map(tuple, balltree.top_k(t, F.col("vec_id") % 100 == 0).collect()))
    import math
    q = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and i not in (600, 601, 602)}
    want = Counter()
    for a in (i for i in q if i % 100 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:10]
        want.update((a, r + 1, b, -s) for r, (s, b) in enumerate(best))
    assert got == want
    assert balltree.top_k(t.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert balltree.top_k(t, F.lit(False)).count() == 0


def test_ball_tree_joins_few_regions_with_a_query(spark, monkeypatch):
    """20 clusters in about 20 regions, ties and a hot copy: results as by brute force, most (query, region) pairs never made."""
    import numpy as np
    ship(spark)
    monkeypatch.setattr(balltree, "SHARD", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (20, 8))
    x = np.concatenate([centres[i % 20] + rng.normal(0, 0.05, 8) for i in range(1400)]).reshape(-1, 8)
    x = np.concatenate([x, np.repeat(x[:1], 700, 0)])  # one vector holds a third of all rows
    made = []
    pairs = balltree._pairs

    def watched(balls, width, first, end):
        run = pairs(balls, width, first, end)
        made.append((len(balls), run))
        return run

    monkeypatch.setattr(balltree, "_pairs", watched)
    counted = []
    hold_ = balltree.hold

    def counting(df, **options):
        out = hold_(df, **options)
        if df.columns == ["query_id", "q", "known", "region"]:
            counted.append(out.count())
        return out

    monkeypatch.setattr(balltree, "hold", counting)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = Counter(map(tuple, balltree.top_k(t, F.col("vec_id") % 20 == 7).collect()))
    q = np.floor(1024 * x).astype(np.int64)
    want = Counter()
    asked = range(7, len(q), 20)
    for a in asked:
        scores = q @ q[a]
        order = [b for b in np.lexsort((np.arange(len(q)), -scores)).tolist() if b != a][:10]
        want.update((a, r + 1, b, int(scores[b])) for r, b in enumerate(order))
    assert got == want
    regions = made[0][0]
    assert regions >= 12 and len(asked) <= sum(counted) < len(asked) * regions / 3


def test_bpe_on_rows(spark, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert set(made.columns) == {*odd.columns, "decoded"}
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in made.select("text", "decoded").collect())
    got = bpe.digests(odd, path, public_tokenizers.PATTERN).collect()
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.digests(nothing, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("group", [30, 8192])
def test_packing_covers_every_token_once(spark, odd, nothing, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    monkeypatch.setattr(packing, "SENT", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    docs = _sf(spark, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    cut = packing.pieces(docs, path, with_ids=True)
    rows = packing.pack(cut).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[(r.doc_id, k // 4096, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + (2 if group > 100 else 6)
    one = packing.sequences(packing.pack(cut)).first()
    assert 0 < len(one.ids) <= 4096
    assert packing.pack(packing.pieces(nothing, path)).count() == 0


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = _sf(spark, "documents", sf), _sf(spark, "labels", sf)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, langid.fit(docs)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r.held_out == fold(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    bad = [r.score for r in got if r.held_out and toxic.get(r.doc_id) == 1]
    good = [r.score for r in got if r.held_out and toxic.get(r.doc_id) == 0]
    assert sum(a > b for a in bad for b in good) > 0.85 * len(bad) * len(good)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_classifiers_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(14)] + [(None, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.where("false"))).count() == 0
    assert toxicity.keep_clean(odd, toxicity.fit(odd, labels.where("false"))).count() == odd.count()
    got = langid.predict(odd, langid.fit(odd)).collect()
    assert len(got) == odd.count()
    und = Counter(r.lang_pred == "und" for r in got)
    assert und[True] == sum(not any(c.isalpha() for c in r.text or "") for r in odd.select("text").collect())
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0


@pytest.mark.parametrize("fit_rows", [128_000, 10])
def test_langid_learns_every_language(spark, monkeypatch, fit_rows):
    """More than 64 languages, one of which is rare, and fewer rows to learn from than languages."""
    ship(spark)
    monkeypatch.setattr(langid, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(langid, "MEMO_CELLS", 80 * 6)
    a = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:02d}" for i in range(80)]
    rows = [(n * 80 + i, " ".join(a[i % 26] * k + a[i // 26] * 3 for k in range(3, 9)), names[i])
            for i in range(80) for n in range(30 if i else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == names
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_pipeline(spark, odd):
    import corpus_pipeline
    docs, seen = _sf(spark, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = hold(stage(spark, docs, SF))
        assert out.columns == docs.columns
        seen.append((docs.select("doc_id", "text").collect(), out.select("doc_id", "text").collect()))
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]
    before, after = seen[1]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in before:
        least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = seen[2]
    comp = _brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(set(comp.values()))
    before, after = seen[3]
    want = {i: (n, g, h) for i, n, g, h in _brute_repeats([(r.doc_id, r.text) for r in before], 13)}
    assert {r.doc_id for r in after} == {i for i, (n, g, _) in want.items() if g < n or n == 0}
    for r in after:
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id][2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in after}
    own = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "block", "digest")]
    for name, stage in corpus_pipeline.STAGES[:-1]:  # columns named like the operators' own come through as they were
        rows = stage(spark, odd, SF).collect()
        assert len(rows) and all(r[c] == 1 for r in rows for c in own), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= odd.count()

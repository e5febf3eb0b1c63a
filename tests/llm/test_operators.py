"""Each operator against a brute-force version, on ordinary and on awkward rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import edge, edge_rows, empty, sf  # noqa: F401

from ledgerlens.llm import (bpe, exact_dedup, jaccard_join, mixing, packing, quality, secret_scan, sharding, toxicity, viterbi,
                            wavelet)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
EMPTY_RUNS = {
    "pack": packing.pack, "shard": lambda d: sharding.shard(d, 100), "mix": mixing.mix, "mixed": mixing.mixed_documents,
    "quality": quality.quality, "keep_good": quality.keep_good, "secrets": secret_scan.secrets, "exact": exact_dedup.exact_groups,
    "dedup": exact_dedup.dedup, "join": jaccard_join.shingle_join, "similar": jaccard_join.drop_similar,
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int")),
    "round_trip": wavelet.round_trip, "counts": viterbi.token_counts,
}


@pytest.mark.parametrize("name", list(EMPTY_RUNS))
def test_empty_table(empty, name):
    assert EMPTY_RUNS[name](empty).collect() == []


def library_ids(text, end):
    return bpe.encoder(bpe.default_vocabulary()).library(text or "") + np.array([end], "<u4").tobytes()


# ---- 1

def check_packing(rows, texts, capacity=2048):
    """Every row's pieces are its ids, cut as promised; sequences are gapless and not too long."""
    want = Counter()
    for doc, t in texts:
        ids = library_ids(t, 0)
        n = len(ids) // 4
        first = n % capacity or capacity
        for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
            want[doc, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_awkward_rows(edge, edge_rows):
    check_packing(packing.pack(edge).collect(), [(r[0], r[1]) for r in edge_rows])


def test_packing_needs_few_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    hist = Counter(r.length for r in rows)
    assert used <= packing.lower_bound(hist, 2048) + 2


def test_planner_finds_optima_that_best_fit_misses():
    hist = Counter({6: 2, 5: 2, 4: 2, 3: 2, 2: 1})  # 38 in 4 bins of 10
    assert sum(n for _, n in packing.plan_packing(hist, 10)) == 4
    hard = Counter({7: 1, 6: 1, 4: 3, 3: 1, 2: 1})
    assert sum(n for _, n in packing.best_fit_decreasing(hard, 10)) >= sum(n for _, n in packing.plan_packing(hard, 10)) == 3


@pytest.mark.parametrize("seed", [105, 177, 297])
def test_planner_completes_bins_of_many_pieces(seed):
    """Eight pieces or more a sequence, where best-fit decreasing needs one sequence more than the bound."""
    r = random.Random(seed)
    capacity = r.choice([100, 150, 2048])
    hist = dict(Counter(r.randint(max(2, capacity // 16), capacity // 8) for _ in range(r.choice([25, 40, 60]))))
    plan = packing.plan_packing(hist, capacity)
    assert sum(n for _, n in packing.best_fit_decreasing(hist, capacity)) == packing.lower_bound(hist, capacity) + 1
    assert sum(n for _, n in plan) == packing.lower_bound(hist, capacity)
    assert sum((Counter({x: n * f.count(x) for x in set(f)}) for f, n in plan), Counter()) == hist and all(sum(f) <= capacity for f, _ in plan)


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    r = random.Random(seed)
    hist = Counter(r.randint(1, 500) for _ in range(r.choice([1, 30, 4000])))
    used = Counter()
    for filling, n in packing.plan_packing(hist, 500):
        assert sum(filling) <= 500
        for x in filling:
            used[x] += n
    assert used == hist


# ---- 2

def test_shards_follow_the_splitting_rule(edge, edge_rows):
    limit = 2000
    rows = sharding.shard(edge, limit).collect()
    assert len(rows) == len(edge_rows)
    size = Counter()
    for r in rows:
        bits = bin(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
        size[r.shard] += r.n_bytes
    for r in rows:
        assert size[r.shard] == r.shard_bytes and r.oversize == (r.shard_bytes > limit)
        if r.oversize:  # nothing to split on: one key
            assert len({x.doc_id for x in rows if x.shard == r.shard}) == 1
        if r.depth:  # the bucket that was split was too large
            assert sum(n for s, n in size.items() if s.startswith(r.shard[:-1])) > limit


def test_oversized_cells_get_more_bits(spark):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(300)] + [(7, "y" * 50)] * 40, "doc_id long, text string")
    rows = sharding.shard(docs, 120).collect()
    assert len(rows) == 340
    shards = defaultdict(int)
    for r in rows:
        shards[r.shard] += r.n_bytes
    assert all(shards[r.shard] <= 120 or r.oversize for r in rows)
    assert {r.doc_id for r in rows if r.oversize} == {7}


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(50)] + [(None, None)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 51


# ---- 3

def test_mix_targets_and_thresholds(edge, edge_rows):
    rows = mixing.mix(edge).collect()
    size = Counter()
    for r in edge_rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:  # share, cap, share the excess again
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(3.0 * size[s] for s in over)
        free -= set(over)
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
    for s in order:
        mine = [r for r in rows if r.source == s]
        longest = max(sum(r.size for r in mine if r.doc_id == x.doc_id) for x in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= longest / 2 + 1e-6


def test_larger_budgets_take_supersets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = ({r.doc_id: r.copies for r in mixing.mix(docs, share=x).collect()} for x in (0.3, 0.6))
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())


def test_mixed_documents_repeat_rows(edge):
    want = Counter()
    for r in mixing.mix(edge).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed_documents(edge)
    assert got.columns == edge.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


# ---- 4

def plain_quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(edge, edge_rows, spark, sf):
    for docs, texts in ((edge, [(r[0], r[1]) for r in edge_rows]),
                        (d := spark.read.parquet(f"{sf}/documents.parquet"), [(r.doc_id, r.text) for r in d.collect()])):
        want = Counter((i, *plain_quality(t)) for i, t in texts)
        rows = quality.quality(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "garden", "letter", "window", "paper") for b in ("", "s", "ly", "ed", "ing")]
    prose = " ".join(r.choice(words) + ("." if r.random() < .1 else "") for _ in range(600))
    noise = " ".join("".join(chr(r.randint(0x4e00, 0x9fff)) for _ in range(8)) for _ in range(400))
    loop = " ".join(f"{i % 7} the same phrase again and" for i in range(400))
    half = prose + " " + " ".join(["tick tock"] * 2500)
    docs = spark.createDataFrame([(0, prose), (1, noise), (2, loop), (3, half)], "doc_id long, text string")
    s = {x.doc_id: x for x in quality.statistics(docs).collect()}
    assert s[0].band_ok and not s[1].band_ok and not s[2].band_ok and not s[3].band_ok
    assert s[2].whole_ratio < 0.1 and s[3].bad_chunk_share > 0.5


def test_keep_good_keeps_columns(edge):
    got = quality.keep_good(edge)
    assert got.columns == edge.columns
    kept = {r.doc_id for r in quality.quality(edge).filter("kept").collect()}
    assert {r.doc_id for r in got.collect()} == kept


# ---- 5

PATTERNS = (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""),
            re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def plain_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_patterns(edge, edge_rows, spark):
    extra = ["API_KEY='abc' apikey: abcdef, Key toKen=xſecret=abcdefg", "secret=token=abcdef", "é password:\"0123456789abcdef01234567\"",
             "AKIA" + "B" * 15, "AKIA" + "B" * 16 + "b", "f" * 23, "g" + "f" * 24, "password =  : abcdefgh", "api__key=abcdefgh"]
    texts = [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(extra)]
    rows = secret_scan.secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = Counter()
    for i, t in texts:
        spans = plain_spans(t)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in spans)
        want[i, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    assert len(secret_scan.secrets(edge).collect()) == len(edge_rows)


def test_network_adds_unknown_keys_and_leaves_addresses(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(["river", "stone", "cloud", "and", "the", "garden", "of"]) for _ in range(n))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for i in range(300):
        texts.append(f"{prose(9)} password={key(18)} {prose(9)}")
        texts.append(f"{prose(9)} {key(40)} {prose(9)}")
        texts.append(f"{prose(9)} mail{i}.server.example.com {prose(9)}")
    unknown = [f"{prose(9)} {key(12)}Z{key(12)} {prose(9)}" for _ in range(60)]  # no pattern has it
    docs = spark.createDataFrame(list(enumerate(texts + unknown)), "doc_id long, text string")
    rows = {x.doc_id: x for x in secret_scan.secrets(docs).collect()}
    found = sum(rows[900 + i].n_network == 1 for i in range(60))
    false = sum(rows[i].n_network for i in range(2, 900, 3))
    assert found >= 50 and false <= 6
    base = [x for x in rows[0].spans.split(",") if x]
    assert base == [f"assign:{texts[0].index('password')}:{texts[0].index('password') + 27}"]


def test_keys_far_inside_runs_and_beside_findings(spark):
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["river", "stone", "cloud", "and", "the", "garden", "of"]) for _ in range(n))
    key = lambda n, c="0123456789abcdef": "".join(r.choice(c) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    link = lambda i, tail: f"https://hooks.host{i % 7}.com/services/T00000000/B00000000/{tail}"
    texts = []
    for i in range(300):
        texts += [f"{prose(9)} password={key(18)} {prose(9)}", f"{prose(9)} {key(40)} {prose(9)}", f"{prose(9)} AKIA{key(20, upper)} {prose(9)}",
                  f"{prose(9)} {link(i, '-'.join(prose(5).split()))} {prose(9)}"]
    far = [f"{prose(9)} {link(i, key(10) + 'Z' + key(13))} {prose(9)}" for i in range(60)]
    beside = [f"{prose(9)} {key(12)}Z{key(11)}Z{key(24)} {prose(9)}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + far + beside)), "doc_id long, text string")
    rows = {x.doc_id: x for x in secret_scan.secrets(docs).collect()}
    assert sum(rows[i].n_network for i in range(3, 1200, 4)) <= 6  # links without a key
    assert sum(rows[1200 + i].n_network == 1 for i in range(60)) >= 50
    for i in range(1260, 1320):
        assert rows[i].n_hex == 1
    assert sum(rows[i].n_network == 1 for i in range(1260, 1320)) >= 50


def test_windows_reach_every_character():
    for n in (6, 40, 41, 60, 61, 100, 1000):
        text = "b" * 30 + "".join(chr(200 + i) for i in range(n)) + "c" * 9
        got = list(secret_scan.windows(secret_scan.padded(text, 30, 30 + n)))
        inside = {c for w in got for c in w[secret_scan.BEFORE:secret_scan.BEFORE + secret_scan.INSIDE]}
        assert set(text[30:30 + n]) <= inside and {len(w) for w in got} == {secret_scan.LENGTH}


# ---- 6

@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(edge, edge_rows, keep):
    groups = defaultdict(list)
    for r in edge_rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    pick = max if keep == "largest" else min
    want = Counter()
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        for i in ids:
            want[i, pick(real) if real else None, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    rows = exact_dedup.exact_groups(edge, keep).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    stays = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_many_runs_and_slices_merge(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RADIX", 2)
    monkeypatch.setattr(exact_dedup, "SLICE_DIGESTS", 40)
    texts = [(i, f"text {i % 97 if i % 3 else 0}") for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    last = {t: i for i, t in texts}
    size = Counter(t for _, t in texts)
    for r in exact_dedup.exact_groups(docs).collect():
        t = texts[r.doc_id][1]
        assert (r.keep_id, r.group_size, r.kept) == (last[t], size[t], r.doc_id == last[t])


def test_dedup_returns_one_row_of_each_text(edge, edge_rows):
    got = exact_dedup.dedup(edge)
    assert got.columns == edge.columns
    texts = Counter((r.text or "").translate(LOWER) for r in got.collect())
    assert set(texts.values()) == {1} and set(texts) == {(r[1] or "").translate(LOWER) for r in edge_rows}


# ---- 7

def plain_groups(docs, k, percent):
    """(n_shingles, component) of each row number of (doc_id, text) pairs."""
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(len(sets[i]), low.get(find(i))) for i in range(len(docs))]


def near_copies(seed):
    r = random.Random(seed)
    out = []
    for _ in range(25):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.choice([3, 5, 9, 11, 12, 20, 60, 200]))]
        for _ in range(r.choice([1, 2, 4, 25])):
            rate = r.choice([0, .01, .03, .08])
            out.append(" ".join(w if r.random() > rate else f"e{r.randint(0, 400)}" for w in base))
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_copies_equal_brute_force(spark, k, percent):
    docs = near_copies(k)
    got = jaccard_join.shingle_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(plain_groups(docs, k, percent)))


def test_small_sets_need_deletion_neighbourhoods(spark):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{r.randint(0, 11)}" for _ in range(r.randint(4, 16)))) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert jaccard_join.signature_rows(df, 1, 80).filter("up0 is not null or up1 is not null").count() > 0
    got = jaccard_join.shingle_join(df, 1, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(plain_groups(docs, 1, 80)))


def test_join_of_awkward_rows(edge, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    want = Counter((d[0], n, c) for d, (n, c) in zip(docs, plain_groups(docs, 3, 90)) if n)
    got = jaccard_join.shingle_join(edge).collect()
    assert len(got) == len(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles) == want
    assert all(r.component_id == r.doc_id for r in got if not r.n_shingles)


def test_drop_similar_leaves_one_of_each_group(edge, edge_rows, spark):
    for docs, percent in ((near_copies(1), 80), ([(r[0], r[1]) for r in edge_rows], 80)):
        df = spark.createDataFrame(docs, "doc_id long, text string") if docs[0][1] else edge
        names = [(i, t) for i, (_, t) in enumerate(docs)]
        groups = Counter(c if n else ("empty", i) for i, (n, c) in enumerate(plain_groups(names, 5, percent)))
        got = jaccard_join.drop_similar(df)
        assert got.columns == df.columns and got.count() == len(groups)


def half_similar(n, copies):
    """Texts that share a passage of half their words; each comes in ``copies`` near copies."""
    r = random.Random(n)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(n // copies):
        own = [f"o{i}x{j}" for j in range(55)]
        for c in range(copies):
            edited = [w if r.random() > .01 else f"e{i}x{c}x{j}" for j, w in enumerate(own)]
            out.append(" ".join([*edited[:20], *passage, *edited[20:]]))
    return list(enumerate(out))


def counted(monkeypatch):
    """Rows of every table of candidate pairs that is verified."""
    sizes = []
    plain = jaccard_join.verified

    def verified(pairs, sets, percent):
        pairs = jaccard_join.landed(pairs.select("a", "b"), "counted")
        sizes.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", verified)
    return sizes


@pytest.mark.parametrize("copies", [1, 2])
def test_half_similar_groups_are_not_paired(spark, monkeypatch, copies):
    """2,000 texts that share a passage, linked to none or in pairs: the pairs made grow with the rows, not with their square."""
    sizes = counted(monkeypatch)
    made = []
    for n in (500, 2000):
        sizes.clear()
        docs = half_similar(n, copies)
        got = jaccard_join.shingle_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 5, 80).collect()
        made.append(sum(sizes))
        if n == 500:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(plain_groups(docs, 5, 80)))
    assert made[1] <= 6 * max(made[0], 500)


def test_group_of_distant_copies_becomes_one_component(spark, monkeypatch):
    """Copies of one text of which about half are linked with each other: stars with changing heads join them."""
    sizes = counted(monkeypatch)
    made = []
    for n in (100, 400):
        sizes.clear()
        r = random.Random(3)
        base = [f"b{i}" for i in range(400)]
        docs = list(enumerate(" ".join(w if r.random() > .012 else f"e{c}x{j}" for j, w in enumerate(base)) for c in range(n)))
        got = jaccard_join.shingle_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 5, 80).collect()
        made.append(sum(sizes))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(plain_groups(docs, 5, 80)))
    assert made[1] <= 8 * made[0]  # four times the rows; all pairs: 16 times


def test_components_of_a_long_chain(spark):
    from ledgerlens.llm.components import components
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002)]
    random.Random(1).shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


# ---- 8

def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    insults = [f"insult{i}" for i in range(12)]
    texts, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        w = [r.choice(words) for _ in range(r.randint(5, 200))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(insults)
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    texts += [(900, None), (901, ""), (None, "insult1 insult2 insult3"), (902, "insult1 " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    got = toxicity.toxicity(docs, spark.createDataFrame(labels + [(901, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(texts)
    rows = {x.doc_id: x for x in got}
    assert all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    test = [i for i in range(800) if held(i)]
    assert sum(rows[i].predicted == labels[i][1] for i in test) / len(test) > 0.95
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    again = toxicity.toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {x.doc_id: x.score for x in again} == {x.doc_id: x.score for x in got}


def toxic_corpus(spark, r, n, insults, each):
    """Documents of ordinary words, every second one with ``each`` insults of the lexicon; labels follow."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        if i % 2:
            for _ in range(each):
                w[r.randrange(len(w))] = r.choice(insults)
        texts.append((i, " ".join(w)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


@pytest.mark.parametrize("n, n_insults, each", [(600, 3, 1), (600, 1, 1), (12_000, 240, 1)])  # few words; each in 0.4 % of the toxic texts
def test_toxicity_of_small_and_long_tailed_lexicons(spark, n, n_insults, each):
    docs, labels = toxic_corpus(spark, random.Random(8), n, [f"insult{i}" for i in range(n_insults)], each)
    rows = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert sum(x.predicted == x.doc_id % 2 for x in rows) / len(rows) > 0.95



def half_toxic(spark, r, make, n=1200):
    """``make(r, toxic)`` texts, every second one toxic; labels follow."""
    docs = [(i, make(r, i % 2 == 1)) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def no_spaces(r, toxic):
    """A script without spaces; phrases of five characters mark toxic texts."""
    c = [chr(0x4E00 + r.randrange(300)) for _ in range(r.randint(60, 200))]
    if toxic:
        at = r.randrange(len(c))
        c[at:at] = r.choice(["\u5929\u5730\u7384\u9ec3\u5b87", "\u65e5\u6708\u76c8\u6603\u8fb0", "\u5bd2\u4f86\u6691\u5f80\u79cb"])
    return "".join(c)


def endings(r, toxic):
    """Insults with many endings: hardly one whole word comes twice."""
    w = [f"w{r.randrange(400)}" for _ in range(r.randint(20, 60))]
    if toxic:
        for _ in range(2):
            w[r.randrange(len(w))] = r.choice(["gromblak", "fiztupor", "quenjabi"]) + "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 5)))
    return " ".join(w)


def long_marker(r, toxic):
    """One word of 70 characters."""
    w = [f"w{r.randrange(400)}" for _ in range(r.randint(20, 60))]
    if toxic:
        w[r.randrange(len(w))] = "qzxj" * 17 + "qz"
    return " ".join(w)


@pytest.mark.parametrize("make", [no_spaces, endings, long_marker])
def test_toxicity_reads_text_not_words(spark, make):
    docs, labels = half_toxic(spark, random.Random(5), make)
    rows = toxicity.toxicity(docs, labels).filter("held_out").collect()
    right = [x.predicted == x.doc_id % 2 for x in rows]
    assert sum(right) / len(right) > 0.95
    assert sum(x.predicted for x in rows if not x.doc_id % 2) / len(rows) < 0.03


def test_toxicity_of_awkward_rows(edge, edge_rows, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(edge, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (9, 10)}) == 1  # equal texts score alike


def test_windows_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    cut = b"".join(toxicity.windows("a\u00e9\u4e2d " * 50 + "end", 8))
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 18)
    assert cut == b"".join(toxicity.windows("a\u00e9\u4e2d " * 50 + "end", 8)) and len(cut) == 8 * 204
    assert list(toxicity.windows("", 8)) == []

# ---- 9

def test_wavelet_matrix_queries():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (100, 3), (70_000, 50_000), (140_000, 900)):
        ids = np.minimum((r.pareto(0.8, n) * 5).astype(np.int64), top).astype(np.uint32)
        w = wavelet.WaveletMatrix(wavelet.build(ids, np.array([1, wavelet._NO_ID]), np.array([n // 2, n - n // 2])))
        assert (w.tokens() == ids).all() and w.lengths.sum() == n
        for i in (r.integers(0, n, 25) if n else []):
            token = int(ids[i])
            assert w.access(int(i)) == token
            assert w.rank(token, int(i)) == (ids[:i] == token).sum()
            assert w.count(token) == (ids == token).sum()
            assert w.select(token, w.rank(token, int(i))) == i
        assert w.rank(999_999, n) == w.count(999_999) == 0
    few = np.array([5, 7, 5, 5, 9], np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(few, np.array([1]), np.array([5])))
    assert w.occurrences(5) == [0, 2, 3] and w.occurrences(4) == []


def test_token_files_round_trip(edge, edge_rows, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 1000)
    rows = sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = Counter(), 0
    for doc, t in rows:
        ids = library_ids(t, 2)
        want[doc, at, len(ids) // 4, zlib.crc32(ids)] += 1
        at += len(ids) // 4
    got = wavelet.round_trip(edge).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


# ---- 10

def test_counts_equal_the_library(edge, edge_rows, monkeypatch):
    vocabulary = viterbi.read_vocabulary(viterbi.default_vocabulary())
    library = viterbi.library_tokenizer(vocabulary)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids) if t else 0
    rows = viterbi.token_counts(edge).collect()
    assert Counter((r.doc_id, r.n_chars, r.n_tokens) for r in rows) == Counter((r[0], len(r[1] or ""), count(r[1])) for r in edge_rows)
    r = random.Random(2)
    c = viterbi.Counter(vocabulary)
    monkeypatch.setattr(viterbi, "PIECE_CHARS", 9)
    for _ in range(4000):
        t = "".join(r.choice(["ab", " ", "the", "\n", "中", "😀", "1", ".", viterbi.MARK, "<0x41>", "<unk>", "\0", "ing"]) for _ in range(r.randint(0, 14)))
        assert c.text(t)[0] == count(t), repr(t)


def test_ties_go_to_the_piece_that_starts_first():
    vocabulary = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], (viterbi.MARK, -1.0), ("a", -2.0), ("b", -2.0),
                  ("ab", -4.0), ("abc", -6.0), ("c", -2.0), ("bc", -4.0)]
    library, c = viterbi.library_tokenizer(vocabulary), viterbi.Counter(vocabulary)
    for t in ("abc", "ab c", "aabbcc", "abcabc bca", "xay"):
        assert c.text(t)[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_secret_fit_takes_every_window(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(12))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, f"secret: {key(30)} and then goes on {word()}") for i in range(400)]
    found = secret_scan.findings(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {(x["y"], x["count"]) for x in secret_scan.fit_windows(found).groupBy("y").count().collect()} == {(1, 800), (0, 400)}
    seen, held = [], []
    plain = secret_scan.calibrated
    monkeypatch.setattr(secret_scan, "calibrated", lambda net, rows, p: held.append(rows.count()) or plain(net, rows, p))
    landed = secret_scan.landed
    monkeypatch.setattr(secret_scan, "landed", lambda df, name: seen.append((name, landed(df, name))) or seen[-1][1])
    p = secret_scan.Params(fit_rows=100, epochs=10)
    net = secret_scan.fit_findings(found, p)
    shards = next(d for name, d in seen if name == "shards").collect()
    assert len(shards) == 8  # of 100 findings each; more windows than fit_rows are not left out
    assert len({(x["y"], x["w"]) for s in shards for x in s["rows"]}) == 640 + 320 and held == [160 + 80]
    same = secret_scan.fit_findings(found.repartition(7), p)
    assert np.array_equal(net.conv, same.conv) and abs(net.threshold - same.threshold) < 1e-9
    fresh = [secret_scan.window(t, 0, len(t)) for t in (key(30) for _ in range(50))] + [secret_scan.window(t, 0, len(t)) for t in (word() for _ in range(50))]
    said = net.probabilities(secret_scan.encode(fresh)) >= net.threshold
    assert said[:50].sum() >= 45 and said[50:].sum() <= 5

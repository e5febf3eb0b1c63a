"""The automaton against a sorted list; the audit against its SQL and a plain version."""
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_fixtures import edge, edge_rows, empty, sf  # noqa: F401

from ledgerlens.llm import divergence
from ledgerlens.llm.transducer import Transducer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(r, n):
    alphabet = r.choice(["ab", "abcdefgh", "aé中😀", "xyzü"])
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 9))).encode() for _ in range(n)})


@pytest.mark.parametrize("seed", range(5))
def test_ordinals_and_terms(seed):
    r = random.Random(seed)
    terms = words(r, r.choice([1, 5, 500]))
    t = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    assert [t.term(i) for i in range(len(terms))] == terms
    ask = terms + words(r, 300) + [x + b"q" for x in terms] + [x[:-1] for x in terms if len(x) > 1]
    data = np.frombuffer(b"".join(ask), np.uint8)
    ends = np.cumsum([len(x) for x in ask])
    got = t.ordinals(data, ends - [len(x) for x in ask], ends)
    place = {x: i for i, x in enumerate(terms)}
    assert got.tolist() == [place.get(x, -1) for x in ask]
    with pytest.raises(IndexError):
        t.term(len(terms))


def test_automaton_is_minimal():
    """Equal endings are shared: as many states as there are different sets of endings."""
    terms = sorted(a + b for a in (b"walk", b"talk", b"jump", b"x") for b in (b"", b"ed", b"ing", b"s"))
    endings = {frozenset(t[i:] for t in terms if t.startswith(p)) for t in terms for i, p in ((i, t[:i]) for i in range(len(t) + 1))}
    assert len(Transducer.build(terms).final) == len(endings)


def test_terms_must_ascend():
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def test_no_terms():
    t = Transducer.from_bytes(Transducer.build([]).to_bytes())
    assert t.ordinals(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3])).tolist() == [-1]


def plain(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(total)
        for s in sources:
            pairs = [(sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            best = [((x - y) ** 2 // (x + y), t) for t, x, y in zip(kept, p[s], q) if counts[lang, s][t] and x > y]
            for part, found in (("pair", pairs), ("term", best)):
                for k, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.append((lang, s, part, item, value, k))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_awkward_rows(edge, edge_rows, min_docs):
    assert rows_of(divergence.divergence(edge, min_docs=min_docs, top=3)) == plain([(r[1], r[2], r[3]) for r in edge_rows], min_docs, 3)


def test_small_parts_and_several_passes(spark, sf, monkeypatch):
    """Many automata, a few a pass, and many blocks give the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.text, r.lang, r.source) for r in docs.collect()], 3, 10)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 200)
    assert rows_of(divergence.divergence(docs, min_docs=3, part_terms=150, broadcast_bytes=20_000)) == want


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = con.execute(f"select lang, source, part, item, value, rank from ({divergence.oracle(min_docs=4)})").fetchall()
    assert rows_of(divergence.divergence(spark.read.parquet(f"{sf}/documents.parquet"), min_docs=4)) == sorted(got)


def test_ties_go_by_bytes(spark):
    rows = [("zeta éa ea 中 Zeta", "x", s) for s in "abc"] + [("only", "x", "d"), (None, "y", "a"), ("", "y", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.divergence(docs, min_docs=1)) == plain(rows, 1, 10)


def test_large_counts_stay_exact(spark):
    """Shares whose numerators exceed 64 bits."""
    from pyspark.sql import functions as F
    n, total, v = 8_000_000_000_007, 90_000_000_000_001, 1234567
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(v).cast("long")).alias("p")).first()
    assert got.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_passes_keep_to_the_limit():
    sizes = [("a", i, s) for i, s in enumerate([5, 5, 5, 30, 1, 9])]
    assert divergence.passes(sizes, 10) == [[("a", 0), ("a", 1)], [("a", 2)], [("a", 3)], [("a", 4), ("a", 5)]]
    assert divergence.passes([], 10) == []


def test_empty_table(empty):
    assert divergence.divergence(empty).collect() == []

"""How the sources of a language differ in their words, by exact integer arithmetic.

A term is a run of ASCII letters and of characters beyond ASCII, A-Z in lower case.
Each language keeps its terms that at least ``min_docs`` of its documents hold.
Every (language, source) group and every language gives each kept term, with its
count there, p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares p, q differ by
f = floor((p - q)^2 / (p + q)).

1. Terms are counted by documents, and the kept ones sorted over range partitions;
   their place in that order is their ordinal.
2. Parts of at most PART_TERMS neighbouring terms become minimal acyclic automata
   (see ``transducer``), one task each.
3. Every text is streamed through its language's automata, which give each word's
   ordinal; tasks add up (group, ordinal) counts before they are shuffled. The
   automata are broadcast while their bytes stay within BROADCAST_BYTES; a larger
   vocabulary is recounted in as many passes as that takes, part after part.
4. Counts are compared block by block of ordinals (a block's table of sources by
   terms is bounded), giving partial sums of f for each two sources and each block's
   best terms; ordinals decide ties.

Rules: null text, language and source count as ''; texts without terms still name
their group; a language without kept terms has pairs with value 0 and no terms;
repeated rows are documents of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, column, landed, text_slices
from .transducer import Transducer
from .words import LOWER, U, mix, word_hashes

#: What a term is, and the scale of the shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000

PART_TERMS = 1 << 17
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 50_000
#: Cells of a block's table: sources times terms.
BLOCK_CELLS = 1 << 18
#: Counts and terms that a task holds before it hands them on.
HELD_COUNTS = 1 << 20
HELD_TERMS = 1 << 19

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The terms ``data[start:end]`` as strings."""
    size = ends - starts
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at])])


def document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, n: how many of the task's texts of a language hold a term (several rows a term where they are many).

    Terms of one slice are told apart by 64-bit hashes, those of several slices by their letters."""
    held: list[pa.Table] = []
    n_held = 0

    def squeezed() -> pa.Table:
        got = pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")])
        return got.rename_columns(["lang", "term", "n"])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)

    for b in batches:
        for part, data, off in text_slices(b):
            coded = column(part, "lang").dictionary_encode()
            lang, names = coded.indices.to_numpy().astype(np.uint64), coded.dictionary
            data = LOWER[data]
            starts, ends, row = term_bounds(data, off)
            h = word_hashes(data, starts, ends)
            _, once = np.unique(mix(h ^ mix(row.astype(np.uint64) + U(0x2545F4914F6CDD1D))), return_index=True)
            _, first, n = np.unique(mix(h[once] ^ mix(lang[row[once]] + U(0x5851F42D4C957F2D))), return_index=True, return_counts=True)
            first = once[first]
            held.append(pa.table({"lang": names.take(pa.array(lang[row[first]].astype(np.int64))),
                                  "term": term_strings(data, starts[first], ends[first]), "n": pa.array(n)}))
            n_held += len(n)
            if n_held > HELD_TERMS:
                held = [squeezed()]
                n_held = held[0].num_rows
                if n_held > HELD_TERMS // 2:
                    yield from rows(held[0])
                    held, n_held = [], 0
    if held:
        yield from rows(squeezed())


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, ordinal of the terms in at least ``min_docs`` of the language's documents."""
    kept = _texts(docs).select("lang", "text").mapInArrow(document_terms, "lang string, term string, n long") \
        .groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")
    kept = landed(kept, "kept-terms")
    # Places in the order: a partition's number and the place in it, then offsets of the partitions.
    placed = landed(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
                    .withColumn("id", F.monotonically_increasing_id()).withColumn("run", F.shiftright("id", 33)), "placed-terms")
    runs = placed.groupBy("lang", "run").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("lang").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = landed(runs.select("lang", "run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "term-runs")
    return placed.join(broadcast_if_small(runs, BROADCAST_ROWS), ["lang", "run"]) \
        .select("lang", "term", (F.col("id") - F.col("first") + F.col("before")).alias("ordinal"))


def automata(terms: DataFrame, part_terms: int) -> DataFrame:
    """lang, part, automaton: one row per ``part_terms`` neighbouring terms."""
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        made = Transducer.build(t.as_buffer().to_pybytes() for t in rows.column("term"))
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()),
                         "automaton": pa.array([made.to_bytes()], pa.binary())})

    return terms.withColumn("part", F.floor(F.col("ordinal") / part_terms)).groupBy("lang", "part") \
        .applyInArrow(build, "lang string, part long, automaton binary")


def passes(sizes: list[tuple[str, int, int]], limit: int) -> list[list[tuple[str, int]]]:
    """Parts (lang, part, bytes) in groups of at most ``limit`` bytes (a larger part alone)."""
    out: list[list[tuple[str, int]]] = []
    room = 0
    for lang, part, size in sizes:
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append((lang, part))
        room -= size
    return out


class _Counts:
    """(group, ordinal) counts of a task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def squeeze(self) -> None:
        if len(self.keys) > 1:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.squeeze()
        if self.held:
            keys, counts = self.keys[0], self.counts[0]
            names = list(self.groups)
            group = pa.array(keys >> 40)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], pa.string()).take(group), pa.array([n[1] for n in names], pa.string()).take(group),
                 pa.array(keys & ((1 << 40) - 1)), pa.array(counts)], names=["lang", "source", "ordinal", "n"])
        self.__init__()


def term_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all terms of a slice."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def recount(docs: DataFrame, parts: DataFrame, part_terms: int, limit: int) -> DataFrame | None:
    """lang, source, ordinal, n: occurrences of the terms that the automata know; None without terms."""
    sizes = [(r["lang"], r["part"], r["size"]) for r in
             parts.select("lang", "part", F.length("automaton").alias("size")).orderBy("lang", "part").toLocalIterator()]
    spark = docs.sparkSession
    out = None
    for chosen in passes(sizes, limit):
        wanted = spark.createDataFrame(chosen, "lang string, part long")
        sent: dict[str, list[tuple[int, bytes]]] = {}
        for r in parts.join(F.broadcast(wanted), ["lang", "part"], "left_semi").toLocalIterator():
            sent.setdefault(r["lang"], []).append((r["part"] * part_terms, bytes(r["automaton"])))
        shared = spark.sparkContext.broadcast(sent)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = {lang: [(base, Transducer.from_bytes(raw)) for base, raw in got] for lang, got in shared.value.items()}
            held = _Counts()
            for b in batches:
                for rows, data, off in text_slices(b):
                    names = list(zip(column(rows, "lang").to_pylist(), column(rows, "source").to_pylist()))
                    group = np.array([held.groups.setdefault(n, len(held.groups)) for n in names], np.int64)
                    data = LOWER[data]
                    starts, ends, row = term_bounds(data, off)
                    langs = [n[0] for n in names]
                    for lang in set(langs) & known.keys():
                        mine = np.array([x == lang for x in langs])[row]
                        s, e, g = starts[mine], ends[mine], group[row[mine]]
                        for base, automaton in known[lang]:
                            number = automaton.ordinals(data, s, e)
                            hit = number >= 0
                            held.add(*np.unique((g[hit] << 40) + base + number[hit], return_counts=True))
                    if held.held > HELD_COUNTS:
                        held.squeeze()
                        if held.held > HELD_COUNTS // 2:
                            yield from held.rows()
            yield from held.rows()

        found = _texts(docs).mapInArrow(count, "lang string, source string, ordinal long, n long") \
            .groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        found = landed(found, "term-counts")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among N = ``total`` occurrences of V = ``terms`` terms; integer division of decimals, so nothing is rounded or overflows."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)"))


def compare_block(top: int):
    """Sums of f for each two sources over a block's terms, and each source's best terms of the block."""
    def compare(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
        place = sources.column("place").to_numpy()
        none = np.zeros(int(place.max()) + 1, np.int64)
        none[place] = sources.column("p0").to_numpy()
        at, ordinal, p = (counts.column(c).to_numpy() for c in ("place", "ordinal", "p"))
        low = int(ordinal.min())
        width = int(ordinal.max()) - low + 1
        table = np.repeat(none[:, None], width, axis=1)
        there = np.zeros(table.shape, bool)
        q = np.zeros(width, np.int64)
        whole = at < 0  # the language itself
        q[ordinal[whole] - low] = p[whole]
        at, ordinal, p = at[~whole], ordinal[~whole] - low, p[~whole]
        table[at, ordinal] = p
        there[at, ordinal] = True
        used = q > 0
        table, there, q = table[:, used], there[:, used], q[used]
        numbers = np.flatnonzero(used) + low
        out: list[list[int]] = [[], [], [], []]
        for a in range(len(table)):
            apart = table - table[a]
            sums = (apart * apart // (table + table[a])).sum(axis=1)
            for b, value in enumerate(sums.tolist()):
                if a != b:
                    for col, x in zip(out, (0, a, b, value)):
                        col.append(x)
            more = np.flatnonzero(there[a] & (table[a] > q))
            apart = table[a, more] - q[more]
            f = apart * apart // (table[a, more] + q[more])
            for k in np.lexsort((more, -f))[:top].tolist():
                for col, x in zip(out, (1, a, int(numbers[more[k]]), int(f[k]))):
                    col.append(x)
        lang = pa.array([key[0].as_py()] * len(out[0]), pa.string())
        return pa.table([lang, *(pa.array(c, pa.int64()) for c in out)], names=["lang", "kind", "place", "other", "value"])

    return compare


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, part_terms: int = PART_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: every two sources of a language, and the terms that each source has more of."""
    groups = landed(_texts(docs).select("lang", "source").distinct(), "sources")
    terms = landed(kept_terms(docs, min_docs), "terms")
    parts = landed(automata(terms, part_terms), "automata")
    counts = recount(docs, parts, part_terms, broadcast_bytes)
    by_lang = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumn("place", F.row_number().over(by_lang) - 1)
    sums = None
    if counts is not None:
        sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sources = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang") \
            .withColumn("total", F.coalesce("total", F.lit(0))) \
            .withColumn("n_sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        sources = landed(sources.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v")))
                         .withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / F.col("n_sources")))), "source-totals")
        whole = sources.groupBy("lang").agg(F.lit("").alias("source"), F.lit(-1).alias("place"), F.sum("total").alias("total"),
                                            F.first("v").alias("v"), F.first("width").alias("width"))
        facts = ["lang", "source", "place", "total", "v", "width"]
        # A language's own counts: kept apart from its sources' by the place -1.
        of_source = counts.join(broadcast_if_small(sources, BROADCAST_ROWS).select(*facts), ["lang", "source"])
        of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")) \
            .join(broadcast_if_small(landed(whole, "lang-totals"), BROADCAST_ROWS).select(*facts), "lang")
        cols = ["lang", "place", "ordinal", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                F.floor(F.col("ordinal") / F.col("width")).alias("block")]
        cells = landed(of_source.select(*cols).unionByName(of_lang.select(*cols)), "shares")
        blocks = landed(cells.select("lang", "block").distinct().join(broadcast_if_small(sources, BROADCAST_ROWS).select("lang", "place", "p0"), "lang"), "blocks")
        sums = landed(cells.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block"))
                      .applyInArrow(compare_block(top), "lang string, kind long, place long, other long, value long"), "block-sums")
    one, two = groups.alias("one"), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    pairs = one.join(two, "lang").filter("place != other")
    if sums is None:
        pairs = pairs.withColumn("value", F.lit(0).cast("long"))
    else:
        added = sums.filter("kind = 0").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
        pairs = pairs.join(added, ["lang", "place", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    out = ["lang", "source", "part", "item", "value", "rank"]
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked)).select(*out)
    if sums is None:
        return pairs
    best = Window.partitionBy("lang", "place").orderBy(F.col("value").desc(), "other")
    words = landed(sums.filter("kind = 1").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
                   .select("lang", "place", F.col("other").alias("ordinal"), "value", "rank"), "best-terms")
    words = terms.join(broadcast_if_small(words, BROADCAST_ROWS), ["lang", "ordinal"]).join(groups, ["lang", "place"]) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(words)


def oracle(min_docs: int = 10, top: int = 10) -> str:
    """The same in DuckDB SQL."""
    return f"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER_CASE}', '{LOWER_CASE}'), '{TERM}') as terms
           from documents),
w as (select rid, lang, source, unnest(terms) as term from d),
k as (select lang, term from (select distinct rid, lang, term from w) group by lang, term having count(*) >= {min_docs}),
v as (select lang, count(*) as v from k group by lang),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
g as (select distinct lang, source from d),
gt as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total, any_value(v.v)::hugeint as v
       from g join v using (lang) left join c using (lang, source) group by g.lang, g.source),
lt as (select lang, sum(total)::hugeint as total, any_value(v) as v from gt group by lang),
p as (select gt.lang, gt.source, k.term, coalesce(c.n, 0) as n,
             1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (gt.total + 2 * gt.v) as p
      from gt join k using (lang) left join c using (lang, source, term)),
q as (select k.lang, k.term, 1 + 1000000000::hugeint * (sum(c.n) + 2) // (any_value(lt.total) + 2 * any_value(lt.v)) as q
      from k join lt using (lang) join c using (lang, term) group by k.lang, k.term),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
       from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source != b.source
          left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
words as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
          from p join q using (lang, term) where n > 0 and p > q),
every as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
          from (select * from pairs union all select * from words))
select lang, source, part, item, value, rank from every where part = 'pair' or rank <= {top}"""

"""Phrases of two to four words that occur more often than their parts suggest, per language.

Phrases are counted by length: words, then pairs, then threes and fours. A phrase can only be frequent if the pairs inside
are, so each pass counts what the pass before leaves; a Bloom filter of at most ``MOST_BITS`` bits carries that on. It may
let more pass, never less, and every count that is used is exact.

A task counts in a HAT-trie: one hash container until it holds ``BURST`` phrases, then a node for each prefix (one word id
of a pair, two of longer phrases, a range of ids of single words) with a hash container of the endings below. Over ``LIMIT`` phrases the largest subtrees
leave the trie whole. Their phrases are sorted and sent as runs, one for each prefix partition, front-coded by a general
compressor. Runs of a prefix partition are added up; only frequent phrases leave. The number of partitions grows with
the text, and a partition is found by the first two words, so that a frequent first word is dealt over many.

Scores need only frequent phrases, as the parts of a frequent phrase are frequent: joins and windows of DataFrames.

Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words, A-Z lowered. Null or empty
text: no words. A null language is ``und``. Repeated rows count again; doc_id is not read. Empty table: no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, text_slices, tidy, written
from ledgerloom.llm.words import cut, distinct, hashes, mixed

#: Least count of a phrase, share in percent at which a longer phrase takes a shorter one's place, rows per language.
LEAST, TAKES, TOP = 30, 80, 2000
#: Phrases of an unsplit container, phrases and words of a trie, text at once, text of a prefix partition.
BURST, LIMIT, WORD_LIMIT, SLICE_BYTES, PART_BYTES = 1 << 14, 1 << 19, 1 << 18, 2 << 20, 4 << 20
#: Bloom filter: bits for each phrase, most bits, probes, bits of a chunk.
BITS, MOST_BITS, PROBES, CHUNK = 16, 1 << 28, 4, 1 << 19

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_CUT = _BREAK.copy()
_CUT[[0x20, 0x09]] = True
_ID = 31  # bits of a word id; two ids are one number
_FACTORS = np.random.Generator(np.random.PCG64(12)).integers(1 << 62, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)

_RUNS = "part int, n int, langs array<string>, sizes array<int>, phrases binary, counts binary"
_COUNTS = "lang string, n int, phrase string, f long"


class HatTrie:
    """Counts of phrases as (prefix, ending) numbers."""

    def __init__(self):
        self.whole: dict | None = {}
        self.children: dict[int, dict[int, int]] = {}

    def add(self, prefix: np.ndarray, ending: np.ndarray) -> None:
        if len(prefix) and max(int(prefix.max()), int(ending.max())) < 1 << _ID:  # both in one number: sorted several times faster
            both = np.sort(prefix << _ID | ending)
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            prefix, ending = both >> _ID, both & ((1 << _ID) - 1)
        else:
            order = np.lexsort((ending, prefix))
            prefix, ending = prefix[order], ending[order]
            fresh = np.ones(len(prefix), bool)
            fresh[1:] = (prefix[1:] != prefix[:-1]) | (ending[1:] != ending[:-1])
            first = np.flatnonzero(fresh)
        self.merge(prefix[first], ending[first], np.diff(np.append(first, len(prefix))))

    def merge(self, prefix: np.ndarray, ending: np.ndarray, counts: np.ndarray) -> None:
        """Distinct phrases in order, with their counts."""
        if self.whole is not None:
            for p, e, n in zip(prefix.tolist(), ending.tolist(), counts.tolist()):
                self.whole[p, e] = self.whole.get((p, e), 0) + n
            if len(self.whole) > BURST:
                self._burst()
            return
        if not len(prefix):
            return
        edges = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        ends = np.append(edges[1:], len(prefix)).tolist()
        ending, counts, children = ending.tolist(), counts.tolist(), self.children
        for p, a, b in zip(prefix[edges].tolist(), edges.tolist(), ends):
            child = children.get(p)
            if child is None:
                children[p] = dict(zip(ending[a:b], counts[a:b]))
                continue
            get = child.get
            for e, n in zip(ending[a:b], counts[a:b]):
                child[e] = get(e, 0) + n

    @property
    def size(self) -> int:
        return len(self.whole) if self.whole is not None else sum(map(len, self.children.values()))

    def _burst(self) -> None:
        held, self.whole = self.whole, None
        for (p, e), n in held.items():
            self.children.setdefault(p, {})[e] = n

    def take(self, at_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefixes, endings and counts of the largest subtrees, taken out until ``at_most`` phrases are left."""
        if self.whole is not None:
            self._burst()
        chosen, left = [], self.size
        for p in sorted(self.children, key=lambda p: len(self.children[p]), reverse=True) if at_most else list(self.children):
            if left <= at_most:
                break
            child = self.children.pop(p)
            chosen.append((p, child))
            left -= len(child)
        sizes = [len(child) for _, child in chosen]
        prefix = np.repeat(np.array([p for p, _ in chosen], np.int64), sizes)
        ending, counts = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int64)
        at = 0
        for _, child in chosen:
            ending[at : at + len(child)] = list(child)
            counts[at : at + len(child)] = list(child.values())
            at += len(child)
        return prefix, ending, counts


class Counter:
    """The tries of a task and the words that their ids stand for."""

    def __init__(self, lengths: tuple[int, ...], parts: int):
        self.lengths, self.parts = lengths, parts
        self._clear()

    def _clear(self) -> None:
        self.tries = {n: HatTrie() for n in self.lengths}
        self.following = itertools.count()
        self.ids: dict[str, defaultdict[bytes, int]] = {}

    def number(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Ids of words of a language; a new word gets the next one."""
        ids = self.ids.setdefault(lang, defaultdict(self.following.__next__))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def _names(self) -> tuple[list[str], np.ndarray, pa.Array]:
        """Languages, and of every id the place of its language and its word."""
        langs = sorted(self.ids)
        total = sum(map(len, self.ids.values()))
        lang, order, words = np.empty(total, np.int64), np.empty(total, np.int64), []
        for k, name in enumerate(langs):
            own = np.fromiter(self.ids[name].values(), np.int64, len(self.ids[name]))
            lang[own], order[own] = k, len(words) + np.arange(len(own))
            words += self.ids[name]
        return langs, lang, pa.array(words, pa.binary()).take(pa.array(order))

    def full(self) -> Iterator[pa.RecordBatch]:
        """Runs of subtrees that the task has no room for."""
        if sum(map(len, self.ids.values())) > WORD_LIMIT:
            yield from self.rest()
        for n, trie in self.tries.items():
            if trie.size > LIMIT // len(self.tries):
                yield self._runs(n, *trie.take(LIMIT // len(self.tries) // 2))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for n, trie in self.tries.items():
            yield self._runs(n, *trie.take(0))
        self._clear()

    def _runs(self, n: int, prefix: np.ndarray, ending: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A row per prefix partition: phrases in order of language and words, joined by line feeds."""
        low = (1 << _ID) - 1
        columns = {1: [ending], 2: [prefix, ending], 3: [prefix >> _ID, prefix & low, ending],
                   4: [prefix >> _ID, prefix & low, ending >> _ID, ending & low]}[n]
        langs, lang, words = self._names()
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        own = hashes(words)
        part = own[columns[0]] * _FACTORS[0] + lang_hashes(langs)[lang[columns[0]]]
        if n > 1:
            part = part + own[columns[1]] * _FACTORS[1]
        part = (mixed(part) % np.uint64(self.parts)).astype(np.int64)
        ranks = [rank[c] for c in columns]
        pairs = [ranks[i] << _ID | ranks[i + 1] if i + 1 < n else ranks[i] for i in range(0, n, 2)]
        order = np.lexsort([*reversed(pairs), part * len(langs) + lang[columns[0]]])
        part, spoken = part[order], lang[columns[0]][order]
        joined = words.take(pa.array(columns[0][order]))
        for c in columns[1:]:
            joined = pc.binary_join_element_wise(joined, words.take(pa.array(c[order])), b" ")
        counts = counts[order].astype("<u8")
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        ends = [*edges[1:].tolist(), len(part)]
        offsets = pa.array(np.append(edges, len(part)), pa.int64())
        texts = pc.binary_join(pa.LargeListArray.from_arrays(offsets, joined), b"\n")
        compress = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for a, b, text in zip(edges.tolist(), ends, texts):
            found, sizes = np.unique(spoken[a:b], return_counts=True)
            planes = counts[a:b].view(np.uint8).reshape(-1, 8).T.tobytes()
            names = [langs[k] for k in found.tolist()]
            rows.append((int(part[a]), n, names, sizes.tolist(), compress(text.as_buffer()), compress(planes)))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=[f.split()[0] for f in _RUNS.split(", ")]
        )


def lang_hashes(langs: list[str]) -> np.ndarray:
    return hashes(pa.array([lang.encode() for lang in langs], pa.binary())) * _FACTORS[2]


# --- a Bloom filter of frequent phrases


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(h + _FACTORS[0] * np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(PROBES)]


def passes(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _positions(h, 8 * len(filter_bytes)):
        found &= (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def phrase_hashes(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Of one or two columns of word hashes and one of language hashes."""
    return mixed(sum(w * f for w, f in zip(words, _FACTORS)) + lang)


def bloom(frequent: DataFrame) -> np.ndarray:
    """Bits of all phrases (of one length, one or two words); the driver gets ``MOST_BITS`` / 8 bytes at most."""
    n = frequent.count()
    bits = min(MOST_BITS, max(CHUNK, 1 << (BITS * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            words = pc.split_pattern(batch.column(1), " ")
            n_words = len(words[0]) if len(words) else 1
            columns = [hashes(pc.list_element(words, k).cast(pa.binary())) for k in range(n_words)]
            coded = batch.column(0).dictionary_encode()
            lang = lang_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            for at in _positions(phrase_hashes(columns, lang), bits):
                np.bitwise_or.at(whole, at >> 3, (1 << (at & 7)).astype(np.uint8))
        chunks = whole.reshape(-1, CHUNK // 8)
        used = np.flatnonzero(chunks.any(axis=1)).tolist()
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunks[k].tobytes()])], names=["chunk", "bits"])

    def united(rows: pa.Table) -> pa.Table:
        whole = np.zeros(CHUNK // 8, np.uint8)
        for one in rows.column(1).to_pylist():
            whole |= np.frombuffer(one, np.uint8)
        return pa.table({"chunk": rows.column(0).slice(0, 1), "bits": pa.array([whole.tobytes()])})

    schema = "chunk int, bits binary"
    found = frequent.select("lang", "phrase").mapInArrow(run, schema).groupBy("chunk").applyInArrow(united, schema).toArrow()
    whole = np.zeros(bits // 8, np.uint8)
    for k, one in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        whole.reshape(-1, CHUNK // 8)[k] = np.frombuffer(one, np.uint8)
    return whole


# --- counting


def counted(docs: DataFrame, lengths: tuple[int, ...], parts: int, least: int, known: np.ndarray | None) -> DataFrame:
    """(lang, n, phrase, f) of phrases of ``lengths`` words that occur ``least`` times; of length 0 all words of a part.

    ``known``: filter of frequent words for pairs, of frequent pairs for longer phrases.
    """
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lengths, parts)
        for batch in batches:
            for some in text_slices(batch, "text", SLICE_BYTES):
                _add(counter, some, lengths, None if shared is None else shared.value)
                yield from counter.full()
        yield from counter.rest()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        tables = []
        for batch in batches:
            for _, n, langs, sizes, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words = pa.array(expand(phrases).split(b"\n"), pa.binary()).cast(pa.string())
                counts = np.ascontiguousarray(np.frombuffer(expand(counts), np.uint8).reshape(8, -1).T).view("<i8").ravel()
                spoken = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(langs), dtype=np.int32), sizes)), pa.array(langs))
                tables.append(pa.table({"lang": spoken.cast(pa.string()), "n": pa.array(np.full(len(words), n, np.int32)), "phrase": words, "f": counts}))
        whole = pa.concat_tables(tables)
        del tables
        summed = whole.group_by(["lang", "n", "phrase"], use_threads=False).aggregate([("f", "sum")]).rename_columns(["lang", "n", "phrase", "f"])
        frequent = summed.filter(pc.greater_equal(summed.column("f"), least))
        yield from frequent.to_batches()
        if 1 in lengths:
            total = summed.group_by("lang", use_threads=False).aggregate([("f", "sum")])
            yield pa.RecordBatch.from_arrays(
                [c.combine_chunks() for c in (total.column("lang"), pa.chunked_array([pa.array([0] * total.num_rows, pa.int32())]),
                                              pa.chunked_array([pa.nulls(total.num_rows, pa.string())]), total.column("f_sum"))],
                names=["lang", "n", "phrase", "f"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add_up(batches)

    return docs.mapInArrow(tidy(count), _RUNS).groupBy("part").applyInArrow(merge, _COUNTS)


def _add(counter: Counter, docs: pa.RecordBatch, lengths: tuple[int, ...], known: np.ndarray | None) -> None:
    found = cut(docs.column(1), lower=True, space=_CUT)
    if not len(found.codes):
        return
    # words that follow one another in one piece of one text
    breaks = np.flatnonzero(_BREAK[found.data])
    piece = np.searchsorted(breaks, found.starts)
    text = np.repeat(np.arange(docs.num_rows), np.diff(found.begins))
    follows = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    coded = docs.column(0).dictionary_encode()
    langs = coded.dictionary.to_pylist()
    lang = coded.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
    # distinct words by language
    size = len(found.distinct)
    key = lang * size + found.codes
    if len(langs) * size <= 8 * len(key) + (1 << 20):
        present = np.bincount(key, minlength=len(langs) * size) > 0
        pair, spoken = np.flatnonzero(present), (np.cumsum(present) - 1)[key]
    else:
        pair, spoken = np.unique(key, return_inverse=True)
    of_lang, of_word = np.divmod(pair, size)
    own, tongue = hashes(found.distinct)[of_word], lang_hashes(langs)[of_lang]

    def number(chosen: np.ndarray) -> np.ndarray:
        """Ids of the distinct words that are used, which come by language."""
        ids = np.full(len(pair), -1, np.int64)
        edges = np.searchsorted(of_lang[chosen], np.arange(len(langs) + 1))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if b > a:
                ids[chosen[a:b]] = counter.number(langs[k], found.distinct.take(pa.array(of_word[chosen[a:b]])).to_pylist())
        return ids

    if lengths == (1,):
        times = np.bincount(spoken, minlength=len(pair))
        ids = number(np.arange(len(pair)))
        order = np.argsort(ids)
        counter.tries[1].merge(ids[order] >> 10, ids[order], times[order])
        return
    if lengths == (2,):
        frequent = passes(known, phrase_hashes([own], tongue))
        first = np.flatnonzero(follows & frequent[spoken[:-1]] & frequent[spoken[1:]])
        ids = number(np.flatnonzero(frequent))[spoken]
        counter.tries[2].add(ids[first], ids[first + 1])
        return
    together = follows.copy()
    at = np.flatnonzero(follows)
    together[at] = passes(known, phrase_hashes([own[spoken[at]], own[spoken[at + 1]]], tongue[spoken[at]]))
    three = np.flatnonzero(together[:-1] & together[1:])
    four = np.flatnonzero(together[:-2] & together[1:-1] & together[2:])
    used = distinct(spoken[np.concatenate([three, three + 1, three + 2])])
    ids = number(used)[spoken]
    pairs = np.where(together, ids[:-1] << _ID | ids[1:], -1)
    counter.tries[3].add(pairs[three], ids[three + 2])
    counter.tries[4].add(pairs[four], pairs[four + 2])


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of up to four words that occur ``least`` times in a language, and of all words (n 0)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    words = written(counted(docs, (1,), parts, least, None), "phrases-1")
    pairs = written(counted(docs, (2,), parts, least, bloom(words.where("n = 1"))), "phrases-2")
    longer = written(counted(docs, (3, 4), parts, least, bloom(pairs)), "phrases-4")
    return words.union(pairs).union(longer)


# --- scores


def _join(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, takes: int = TAKES, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found = frequent_phrases(docs, least)
    totals = found.where("n = 0").groupBy(F.col("lang").alias("of")).agg(F.sum("f").alias("total"))
    parts = found.where("n > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f"))
    phrases = found.where("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*", _join(words, F.lit(1), F.col("k")).alias("left"), _join(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    for side in ("left", "right"):
        named = parts.withColumnRenamed("f", side[0])
        cuts = cuts.join(named, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = phrases.where("size > 2").select(
        F.col("lang").alias("of"), "a", words.alias("w"), F.explode(F.expr("sequence(2, size - 1)")).alias("n"), "size"
    ).select("of", "a", "w", "n", F.explode(F.expr("sequence(1, size - n + 1)")).alias("at"))
    covered = inside.groupBy("of", _join(F.col("w"), F.col("at"), F.col("n")).alias("part")).agg(F.max("a").alias("longer"))
    left = best.join(covered, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").where(
        F.expr(f"longer is null or cast(longer as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {takes}")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_SQL = r"""
with docs as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) p from docs),
words as (select row_number() over () p, lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
one as (select lang, p, unnest(w) x, generate_subscripts(w, 1) i from words),
totals as (select lang, count(*)::bigint n from one group by 1),
led as (select lang, x, lead(x, 1) over o x2, lead(x, 2) over o x3, lead(x, 3) over o x4 from one window o as (partition by p order by i)),
grams as (select lang, 1 n, x phrase from led union all select lang, 2, x || ' ' || x2 from led where x2 is not null
          union all select lang, 3, x || ' ' || x2 || ' ' || x3 from led where x3 is not null
          union all select lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 from led where x4 is not null),
f as (select lang, n, phrase, count(*)::bigint f from grams group by all having count(*) >= 30),
c as (select lang, n size, phrase, f a, string_split(phrase, ' ') w from f where n > 1),
cuts as (select c.*, k from c, (select unnest([1, 2, 3]) k) where k < size),
scored as (select cuts.lang, cuts.phrase, a, k, x.f l, y.f r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint score
           from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(w[1:k], ' ')
           join f y on y.lang = cuts.lang and y.phrase = array_to_string(w[k + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) longer
            from c, (select unnest([2, 3]) m), (select unnest([1, 2, 3]) i) where m < size and i + m - 1 <= size group by 1, 2),
kept as (select best.* from best left join covered using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint rank, phrase, a, l, r, totals.n, score
from kept join totals using (lang) qualify rank <= 2000
"""

QUERIES: dict[str, tuple[Callable, str | None]] = {"op12_collocations": (op12_collocations, _SQL)}

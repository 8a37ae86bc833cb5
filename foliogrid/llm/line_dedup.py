"""Line dedup by an exact set-similarity join.

A line is the set of its words. Prefix, positional and length filters of ``setjoin`` leave few pairs, which are
verified on the full sets. A line goes if an earlier line is similar enough; earlier means by identifier, then
place in the input.

One earlier match is enough for a line to go. The prefixes of all sets are sorted by word and place once; in that
one pass each set is compared with the earlier sets of the word until one passes all filters by far, or ``TRIES`` of
them just so; a group of near copies costs a few pairs a line. Only sets that no such pair removed and that had more earlier sets than were looked
at are joined with all of them.

The order of words comes from their counts over all documents. Words of more than a million occurrences are dealt
over sub-keys in the first pass; what that pass leaves open is the join's, which splits hot words by itself.

Defined results: a null or empty text is one empty line; lines without words are never removed and match nothing;
equal sets match; A-Z equals a-z; a row that repeats an identifier comes after it in the order of the input, so its
lines go; null identifiers come first; an empty table gives an empty result; other columns are ignored; long texts
are read whole. The texts of ``docs`` are read twice more to verify and must then be the same, in any order.
"""

from __future__ import annotations

from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliogrid.llm.common import discard, free_name, is_small, lookup, materialize, slices, table, whole_text
from foliogrid.llm.near_dedup import confirmed
from foliogrid.llm.setjoin import PACKED, SKETCH_BITS, may_match, packed_counts, packed_sketch, prefix_length, rare_first
from foliogrid.llm.words import distinct_by_owner, mixed, word_hashes

PERCENT = 80
#: Words that a task counts, and sets it remembers, before it hands them on.
TASK_WORDS, TASK_SETS = 4_000_000, 200_000
#: Earlier sets of a word that the first pass looks at, and pairs of a set that it makes, at most; the join does the rest.
SCAN, TRIES = 4096, 16
#: Pairs of a set that are verified before all others, the likeliest first.
VERIFIED = 16
#: Sets of so many words have wide marks too, this many times 64 parities.
WIDE_FROM, WIDE = 50, 4
#: Rows of the first pass that a task works on at a time, words whole unless they have more rows than the second.
ROWS, MOST_ROWS = 1 << 18, 1 << 20
#: Sub-keys of words whose class of frequency is that of a million occurrences or more.
HOT_CLASS, HOT_SALTS = 81, 64


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Occurrences of words by bucket of the sketch, as ``packed_sketch`` takes them: a task counts ``TASK_WORDS`` words at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for lo, hi in slices(raw):
                held.append((word_hashes(raw[lo:hi])[0] & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32))
                size += len(held[-1])
                if size > TASK_WORDS:
                    yield packed_counts(held)
                    held, size = [], 0
        if held:
            yield packed_counts(held)

    return docs.select(text_col).mapInArrow(run, PACKED)


DIGEST_SALTS = (np.uint64(0), np.uint64(0xD6E8FEB86659FD93))


class LineSets:
    """Word sets of the lines of texts given as bytes, words in order of rarity."""

    def __init__(self, sketch: np.ndarray, percent: int):
        self.percent, self.sketch = percent, sketch

    def __call__(self, texts: list[bytes]):
        """``line counts, set sizes, digests, marks, keys, lines``; keys of one line are distinct and rare first.

        A digest has 128 bits. The marks of a set are 64 parities of its words: sets differ in at least as many
        words as their marks in bits. Long sets need more parities than the sorted prefixes carry, see ``wide_marks``.
        """
        hashes, starts, buffer = word_hashes(texts)
        keys, breaks = rare_first(hashes, self.sketch), np.flatnonzero(buffer == 10)
        line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(starts, breaks), prepend=0))
        line, keys = distinct_by_owner(line, keys)
        sizes = np.bincount(line, minlength=len(breaks))
        digests, marks = np.zeros((len(breaks), 2), np.uint64), np.zeros(len(breaks), np.uint64)
        full = sizes > 0
        if len(keys):
            first = (np.cumsum(sizes) - sizes)[full]
            for i, salt in enumerate(DIGEST_SALTS):
                digests[full, i] = mixed(np.add.reduceat(mixed(keys ^ salt), first) + sizes[full].astype(np.uint64))
            marks[full] = np.bitwise_xor.reduceat(np.uint64(1) << (keys & np.uint64(63)), first)
        return [t.count(b"\n") + 1 for t in texts], sizes, digests.view("V16").ravel(), marks.astype(np.int64), keys, line

    def wide_marks(self, sizes: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
        """``64 * WIDE`` parities of the words of each set; null for sets of fewer than ``WIDE_FROM`` words."""
        wide = sizes >= WIDE_FROM
        keys = keys[np.repeat(wide, sizes)]
        bit, word = np.uint64(1) << (keys & np.uint64(63)), (keys >> np.uint64(6)) & np.uint64(WIDE - 1)
        first = np.cumsum(sizes[wide]) - sizes[wide]
        out = []
        for k in range(WIDE):
            marks = np.zeros(len(sizes), np.uint64)
            if len(keys):
                marks[wide] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), first)
            out.append(pa.array(marks.view(np.int64), mask=~wide))
        return out

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """Words of a set of which a similar set has one; sets of few words are similar to equal ones only."""
        return np.where(sizes * (100 - self.percent) >= self.percent, prefix_length(sizes, self.percent), 0)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: type = np.int64) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.astype(kind)))


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests))]).cast(pa.binary())


def _text_key(text_col: str) -> Column:
    return F.xxhash64(whole_text(text_col))


def line_table(docs: DataFrame, sketch: Broadcast, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``id, row, line, text_key, h, n, b, skip, prefix`` and wide marks of every line; a task gives the prefix of a set for the first of its lines.

    ``row + line`` numbers all lines; ``row`` is the number of a document's first line. The prefix leaves out the
    ``skip`` words that occur once in all documents and so in no other set. ``first`` tells the lines with words of
    which the task has seen no earlier one of their set. The first line of a document has its ``n_lines``, and
    ``again``, its lines with words that are not ``first``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wide = [f"w{k}" for k in range(WIDE)]

    def run(batches):
        sets, seen, number = LineSets(sketch.value, percent), {}, TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = [(i is not None, i) for i in batch.column(0).to_pylist()]
            for lo, hi in slices(raw):
                per_text, sizes, digests, marks, keys, line = sets(raw[lo:hi])
                owner = np.repeat(np.arange(lo, hi), per_text)
                if len(seen) > TASK_SETS:
                    seen.clear()
                # the earliest line of a set by identifier; of equal ones the first
                picks = {}
                for i, (h, o) in enumerate(zip(digests.tolist(), owner.tolist(), strict=True)):
                    at = ids[o]
                    if h not in seen or at < seen[h]:
                        seen[h], picks[h] = at, i
                fresh = np.zeros(len(sizes), bool)
                fresh[list(picks.values())] = True
                lengths = np.where(fresh, sets.prefix(sizes), 0)
                place = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[line]
                inside = place < lengths[line]
                shared = inside & (keys >> np.uint64(56) > 0)
                taken = np.bincount(line[shared], minlength=len(sizes))
                skip = np.bincount(line[inside], minlength=len(sizes)) - taken
                counts = np.array(per_text)
                rows = number + np.cumsum(counts) - counts
                number += int(counts.sum())
                numbers = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first, top = fresh & (sizes > 0), numbers == 0
                again = ~first & (sizes > 0)
                repeats = np.zeros(len(owner), np.int64)
                repeats[top] = np.bincount(owner[again] - lo, minlength=hi - lo)
                told = [pa.array(first), pa.array(np.repeat(counts, counts).astype(np.int32), mask=~top), _lists(numbers[again], repeats, np.int32)]
                columns = [batch.column(0).take(pa.array(owner)), pa.array(np.repeat(rows, counts)), pa.array(numbers.astype(np.int32)), batch.column(2).take(pa.array(owner)), _binary(digests), pa.array(sizes.astype(np.int32)), pa.array(marks), pa.array(skip.astype(np.int32)), _lists(keys[shared], taken), *told, *sets.wide_marks(sizes, keys)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "text_key", "h", "n", "b", "skip", "prefix", "first", "n_lines", "again", *wide])

    return docs.select(id_col, text_col, _text_key(text_col)).mapInArrow(run, f"id {kind}, row long, line int, text_key long, h binary, n int, b long, skip int, prefix array<long>, first boolean, n_lines int, again array<int>, " + ", ".join(f"{w} long" for w in wide))


def _wanted_sets(docs: DataFrame, text_col: str, wanted: DataFrame, sketch: Broadcast, percent: int) -> DataFrame:
    """``id, s``: the words of the lines in ``wanted`` (``text_key`` of a document, ``asked`` lines) by digest, each once."""

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["text_key", "body"])

    def run(batches, unpack):
        sets = LineSets(sketch.value, percent)
        for batch in batches:
            held = []
            for body, asked in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = unpack(body or b"").split(b"\n")
                held += [lines[k] for k in asked]
            for lo, hi in slices(held):
                _, sizes, digests, _, keys, _ = sets(held[lo:hi])
                yield pa.RecordBatch.from_arrays([_binary(digests), _lists(keys, sizes)], ["id", "s"])

    texts = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("body"))
    if is_small(wanted, 64):
        bodies, unpack = texts.join(F.broadcast(wanted), "text_key"), bytes
    else:
        # texts that are shuffled travel compressed
        bodies, unpack = texts.mapInArrow(packed, "text_key long, body binary").join(wanted, "text_key"), zstandard.decompress
    return bodies.select("body", "asked").mapInArrow(partial(run, unpack=unpack), "id binary, s array<long>").dropDuplicates(["id"])


def _marks_allow(percent: int) -> Column:
    """Sets of n and m words with marks b and d do not differ in too many words for the similarity."""
    return F.bit_count(F.col("b").bitwiseXOR(F.col("d"))) * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def plausible(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """``pairs`` of line numbers ``l, r`` without those whose wide marks differ in too many words."""

    def marks(side: str, n: str, w: str) -> DataFrame:
        named = [(F.col("row") + F.col("line")).alias(side), F.col("n").alias(n), *(F.col(f"w{k}").alias(f"{w}{k}") for k in range(WIDE))]
        return lines.filter("w0 IS NOT NULL").select(*named).hint("merge")

    both = pairs.join(marks("l", "n_l", "w"), "l", "left").join(marks("r", "n_r", "v"), "r", "left")
    apart = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(WIDE)), F.lit(0))
    return both.filter(F.coalesce(apart * (100 + percent) <= (F.col("n_l") + F.col("n_r")) * (100 - percent), F.lit(True))).select(*pairs.columns)


def prefix_rows(lines: DataFrame) -> DataFrame:
    """``token, id, number, n, i, b``: one row for each word of a prefix and its place in the set."""
    each = lines.filter(F.size("prefix") > 0).select("id", (F.col("row") + F.col("line")).alias("number"), "n", "b", "skip", F.posexplode("prefix").alias("p", "token"))
    return each.select("token", "id", "number", "n", (F.col("skip") + F.col("p")).alias("i"), "b")


def earlier_candidates(rows: DataFrame, percent: int, scan: int = SCAN, tries: int = TRIES, most_rows: int = MOST_ROWS) -> DataFrame:
    """``l, r, apart, more``: a set and the first earlier one of a word that passes by far, or else up to ``tries`` that pass, for each word.

    ``apart`` is the difference of their marks in percent of what is allowed, up to 50 if a pair passes by far.
    ``more`` tells that not all earlier sets of the word have been looked at; rows of which only this is known have
    ``r = l``. One sort by word; a task holds a word of up to ``most_rows`` sets, more are worked on in parts.
    """

    def work(ids, g, number, b, ni, cut: bool):
        """The pairs of whole words, or of a part of one."""
        order = _word_order(g, _ranks(ids), number)
        g, number, b, ni = g[order], number[order], b[order], ni[order]
        n, i = ni >> 32, ni & 0xFFFFFFFF
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        first = np.repeat(begin, np.diff(np.append(begin, len(g))))
        pos, count, more, sure = np.arange(len(g)) - first, np.zeros(len(g), np.int64), np.zeros(len(g), bool), np.zeros(len(g), bool)
        found, others, percents = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left, after, least, largest = np.flatnonzero(pos > 0), n - i, -(-n * percent // 100), n * 100 // percent
        for j in range(scan):
            if not len(left):
                break
            e = first[left] + j
            at = np.flatnonzero((n[e] >= least[left]) & (n[e] <= largest[left]))
            l, e = left[at], e[at]
            fits = np.minimum(after[l], after[e]) * (100 + percent) >= (n[l] + n[e]) * percent
            at, l, e = at[fits], l[fits], e[fits]
            apart, most = np.bitwise_count((b[l] ^ b[e]).view(np.uint64)).astype(np.int64) * (100 + percent), (n[l] + n[e]) * (100 - percent)
            ok = apart <= most
            at, l, e, apart, most = at[ok], l[ok], e[ok], apart[ok], most[ok]
            far = 2 * apart <= most
            found.append(l)
            others.append(e)
            percents.append((apart * 100 + most - 1) // most)
            count[l] += 1
            sure[l[far]] = True
            done, goes_on = np.zeros(len(left), bool), pos[left] > j + 1
            done[at] = far | (count[l] >= tries)
            more[left[done & goes_on]] = True
            left = left[~done & goes_on]
        # pairs that are not told, and sets beyond those looked at, in another part or another sub-key
        more |= sure & (count > 1)
        more |= cut | (pos >= scan) | ((g.view(np.uint64) >> np.uint64(56)) >= HOT_CLASS)
        alone = np.flatnonzero(more & (count == 0))
        found, others, percents = np.concatenate(found), np.concatenate(others), np.concatenate(percents)
        keep = (percents <= 50) | ~sure[found]
        l, r = np.concatenate([found[keep], alone]), np.concatenate([others[keep], alone])
        return pa.RecordBatch.from_arrays([pa.array(number[l]), pa.array(number[r]), pa.array(np.concatenate([percents[keep], np.full(len(alone), 101)]).astype(np.int32)), pa.array(more[l])], ["l", "r", "apart", "more"])

    def run(batches):
        waiting, size, parted = [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if not waiting or (batch is not None and size < ROWS):
                continue
            held = pa.Table.from_batches(waiting)
            g = held.column(1).to_numpy()
            # the last word may go on
            at = int(np.searchsorted(g, g[-1])) if batch is not None else len(g)
            if not at and size < most_rows:
                continue
            cut = not at or parted == g[0]
            ends = [int(np.searchsorted(g, g[0], "right"))] if cut and at else [at or len(g)]
            for lo, hi in zip([0, *ends], [*ends, at or len(g)], strict=True):
                if hi > lo:
                    part = held.slice(lo, hi - lo)
                    yield work(part.column(0).combine_chunks(), *(part.column(k).to_numpy() for k in range(1, 5)), cut and not lo)
            parted = g[0] if not at else None
            waiting = held.slice(at or len(g)).to_batches()
            size = sum(b.num_rows for b in waiting)

    hot = F.shiftrightunsigned("token", 56) >= HOT_CLASS
    low = F.xxhash64("token", F.pmod(F.xxhash64("number"), F.lit(HOT_SALTS))).bitwiseAND((1 << 56) - 1)
    dealt = rows.select("id", F.when(hot, F.col("token").bitwiseAND(-1 << 56).bitwiseOR(low)).otherwise(F.col("token")).alias("g"), "number", "b", (F.col("n") * F.lit(1 << 32) + F.col("i")).alias("ni"))
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "l long, r long, apart int, more boolean")


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers that sort as the identifiers, null first."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy()
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _word_order(g: np.ndarray, ranks: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order by word, rank and number of rows that are in order of words."""
    word, low = np.cumsum(np.concatenate([[False], g[1:] != g[:-1]])), int(ranks.min())
    bits = (int(ranks.max()) - low).bit_length()
    if int(word[-1]).bit_length() + bits < 63:
        # one fast sort of both in one number unless it leaves lines of a document out of order
        key = (word << bits) | (ranks.astype(np.int64) - low)
        order = np.argsort(key, kind="stable")
        key, numbers = key[order], number[order]
        if not ((key[1:] == key[:-1]) & (numbers[1:] < numbers[:-1])).any():
            return order
    return np.lexsort((number, ranks, g))


def picked(pairs: DataFrame) -> DataFrame:
    """``l, r, more``: the likeliest pair of each set if it passes by far, or else the ``VERIFIED`` likeliest."""
    by_set = W.partitionBy("l")
    likeliest = by_set.orderBy("apart", "r")
    ranked = pairs.select("l", "r", "more", F.dense_rank().over(likeliest).alias("nth"), F.lag("r").over(likeliest).alias("before"), F.first("apart").over(likeliest).alias("best"))
    ranked = ranked.withColumns({"more": F.max("more").over(by_set), "of": F.max("nth").over(by_set)})
    taken = F.when(F.col("best") <= 50, 1).otherwise(VERIFIED)
    # a pair that several words gave has one rank
    once = ranked.filter((F.col("nth") <= taken) & (F.col("before").isNull() | (F.col("before") != F.col("r"))))
    return once.select("l", "r", (F.col("more") | (F.col("of") > taken)).alias("more"))


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``line_table`` and, of its lines that are ``first``, ``row, line`` of those that go."""
    sketch = packed_sketch(word_counts(docs, text_col))
    lines = materialize(line_table(docs, sketch, percent, id_col, text_col), "lines")
    number = F.col("row") + F.col("line")
    nth = F.row_number().over(W.partitionBy("h").orderBy("id", "row", "line"))
    sets = materialize(lines.filter("first").select("h", "id", "row", "line").select("h", "row", "line", (nth == 1).alias("earliest")), "line-sets")
    earliest = sets.filter("earliest")
    # only the first line of a set counts: the others go anyway
    pairs = picked(earlier_candidates(prefix_rows(lines), percent))
    found = materialize(pairs.hint("merge").join(earliest.select(number.alias("l"), "h"), "l"), "line-candidates")

    def matches(pairs: DataFrame) -> DataFrame:
        """Digests of the sets whose line ``l`` is similar to line ``r`` of some pair."""
        numbers = materialize(pairs.select(F.col("l").alias("number")).union(pairs.select("r")).distinct(), "line-numbers")
        named = materialize(lines.select(number.alias("number"), "line", "h", "text_key").join(lookup(numbers, 16), "number"), "line-names")
        wanted = named.groupBy("h").agg(F.min(F.struct("text_key", "line")).alias("at")).groupBy("at.text_key").agg(F.collect_set("at.line").alias("asked"))
        # both joins read one exchange of the sets
        full = _wanted_sets(docs, text_col, materialize(wanted, "line-wanted"), sketch, percent)
        by_set = pairs.join(named.select(F.col("number").alias("l"), F.col("h").alias("x")), "l").join(named.select(F.col("number").alias("r"), F.col("h").alias("y")), "r")
        by_set = by_set.filter("x <> y").select(F.col("x").alias("l"), F.col("y").alias("r")).distinct()
        out = materialize(confirmed(by_set.hint("merge"), full.hint("merge"), percent).select("l").distinct(), "line-matched")
        discard(numbers, named)
        return out

    matched = matches(materialize(plausible(found.filter("l <> r").select("l", "r"), lines, percent), "line-plausible"))
    open_ = materialize(found.filter("more").select("h", F.col("l").alias("number")).distinct().join(lookup(matched.withColumnRenamed("l", "h"), 64), "h", "left_anti"), "line-open")
    if not open_.isEmpty():
        mine = prefix_rows(lines.join(lookup(open_.select(F.col("number").alias("open")), 16), number == F.col("open")))
        mine = materialize(mine.select("token", F.col("number").alias("l"), "n", "i", "b", F.struct("id", "number").alias("place")), "line-open-words")
        others = prefix_rows(lines).select("token", F.col("number").alias("r"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("b").alias("d"), F.struct("id", "number").alias("earlier"))
        both = others.join(lookup(mine, 128), "token").filter((F.col("earlier") < F.col("place")) & may_match("n", "i", "m", "j", percent) & _marks_allow(percent))
        apart = F.bit_count(F.col("b").bitwiseXOR(F.col("d"))) / (F.col("n") + F.col("m"))
        rest = both.groupBy("l", "r").agg(F.min(apart).alias("apart")).join(found.select("l", "r"), ["l", "r"], "left_anti")
        rest = plausible(rest, lines, percent)
        rest = materialize(rest.withColumn("nth", F.row_number().over(W.partitionBy("l").orderBy("apart", "r"))), "line-rest")
        if is_small(rest, 64):
            matched = matched.union(matches(rest))
        else:
            # most sets have a match among the likeliest; only those without are compared with all
            more = matches(rest.filter(F.col("nth") <= VERIFIED))
            still = materialize(open_.join(lookup(more.withColumnRenamed("l", "h"), 64), "h", "left_anti").select(F.col("number").alias("l")), "line-still")
            matched = matched.union(more).union(matches(rest.filter(F.col("nth") > VERIFIED).join(lookup(still, 16), "l", "left_semi")))
    # of the lines of a set the earliest stays if the set has no match
    near = earliest.join(lookup(materialize(matched.select(F.col("l").alias("h")).distinct(), "line-near"), 64), "h", "left_semi")
    gone = materialize(sets.filter("NOT earliest").select("row", "line").union(near.select("row", "line")), "lines-gone")
    discard(sets, found, open_)
    return lines, gone


def similar_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row, line, removed`` of every line."""
    lines, gone = _judged(docs, percent, id_col, text_col)
    out = lines.select("id", "row", "line", "n", "first").join(gone.withColumn("goes", F.lit(True)), ["row", "line"], "left")
    return out.select("id", "row", "line", ((F.col("n") > 0) & (~F.col("first") | F.col("goes").isNotNull())).alias("removed"))


def line_report(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_lines, n_removed, removed_lines`` (numbers from 0, comma-joined)."""
    lines, gone = _judged(docs, percent, id_col, text_col)
    per_row = lines.filter("n_lines IS NOT NULL").select("id", "row", "n_lines", "again")
    per_row = per_row.join(gone.groupBy("row").agg(F.collect_list("line").alias("gone")), "row", "left")
    per_row = per_row.withColumn("all", F.array_sort(F.concat("again", F.coalesce("gone", F.array().cast("array<int>")))))
    removed = F.array_join(F.col("all").cast("array<string>"), ",").alias("removed_lines")
    return per_row.select(F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.size("all").cast("long").alias("n_removed"), removed)


def without_lines(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the reported lines taken out of their texts; identifiers are taken to be distinct."""
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    known = report.select(F.col(id_col).alias(key), F.split("removed_lines", ",").alias(gone))
    rows = docs.join(known, F.col(id_col).eqNullSafe(F.col(key)), "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i.cast("string")))
    return rows.withColumn(text_col, F.array_join(kept, "\n")).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES: dict[str, str] = {}

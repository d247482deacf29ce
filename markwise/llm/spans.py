"""Long exact spans shared between records.

Units of the texts are hashed, the digests are grouped over the whole corpus, and what a digest says about its unit
goes back to the text with the original offsets. Two kinds of units:

* lines: each line's digest keeps its earliest occurrence and marks every later one;
* windows: a passage need not begin or end with a line, so here the units follow the content. Every passage of the
  wanted length holds the same fingerprints of half that length wherever it stands (the least hash of each stretch of
  neighbours). Fingerprints that two documents share are compared with what stands around them: occurrences of one
  surrounding fall into a class, a class of two documents is shared as far as the surrounding reaches, and the others are
  matched against the classes of their fingerprint. So a match costs one row per fingerprint, not one per character, and
  the result is exactly the characters that lie in a shared passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise.session import stored

#: Code points of the shortest passage that counts.
LEAST = 200

_U = np.uint64
#: Odd multipliers of the two polynomial hashes and of the mixing steps.
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_WORD = 1 << 64
#: Characters hashed in one go.
_BLOCK = 1 << 20
_powers: dict[tuple[int, int], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit number stirred, one to one."""
    x = (x ^ (x >> _U(30))) * _U(_MIX[0])
    x = (x ^ (x >> _U(27))) * _U(_MIX[1])
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    kept = _powers.get((base, 0))
    if kept is None or len(kept) < n:
        size = max(n, 4096)
        kept = np.full(size, base, dtype=_U)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        _powers[base, 0] = kept
    return kept[:n]


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(points: np.ndarray, length: int, seed: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the window of ``length`` at each of ``starts`` (by default at every one), the same for equal windows."""
    n = len(points)
    if starts is None:
        starts = np.arange(max(0, n - length + 1))
    out = np.empty(len(starts), dtype=_U)
    base = _BASE[seed]
    inverse = pow(base, -1, _WORD)
    k = 0
    while k < len(starts):  # starts ascend; blocks keep the powers in a bounded table
        first = int(starts[k])
        until = int(np.searchsorted(starts, first + _BLOCK))
        part = starts[k:until] - first
        chars = mixed(points[first : int(starts[until - 1]) + length].astype(_U) + _U(base))
        total = np.zeros(len(chars) + 1, dtype=_U)
        np.cumsum(chars * _power(base, len(chars)), out=total[1:])
        out[k:until] = (total[part + length] - total[part]) * _power(inverse, int(part[-1]) + 1)[part]
        k = until
    return mixed(out)


def fingerprints(points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: of half the wanted length, one in every stretch of a passage.

    Of each ``least // 2 + 1`` neighbouring windows the one of the least hash is taken, the last of equal ones. Equal
    passages of ``least`` characters hold an equal fingerprint at an equal place.
    """
    length = least - least // 2
    stretch = least - length + 1
    hashes = window_hashes(points, length, 0)
    if len(hashes) < stretch:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
    # least of each stretch, from running minima within blocks of one stretch forwards and backwards; the low bits hold
    # the place in the block, counted down, so that of equal hashes the last is the least
    bits = _U(int(stretch).bit_length())
    pad = -len(hashes) % stretch
    places = np.arange(len(hashes) + pad, dtype=np.int64) % stretch
    keys = (np.concatenate([hashes, np.full(pad, _U(_WORD - 1))]) >> bits << bits) | (_U(stretch) - places.astype(_U))
    blocks = keys.reshape(-1, stretch)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(len(hashes) - stretch + 1)
    last = first + stretch - 1
    back, ahead = back[first], ahead[last]
    later = (ahead >> bits) <= (back >> bits)
    place = np.where(later, ahead, back) & ((_U(1) << bits) - _U(1))
    at = np.where(later, last, first) // stretch * stretch + stretch - place.astype(np.int64)
    positions = at[np.concatenate([[True], at[1:] != at[:-1]])]  # they ascend
    return positions, hashes[positions]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _wide(df: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """Documents that can hold a passage; each id once."""
    return df.where(F.col(doc).isNotNull() & (F.length(text) >= least)).select(F.col(doc).alias("doc"), F.col(text).alias("text"))


def marks(docs: DataFrame, least: int) -> DataFrame:
    """doc, pos, h: the fingerprints of every document of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, hs, held = [], [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                positions, hashes = fingerprints(code_points(text.as_py()), least)
                ids.append(np.full(len(positions), doc.as_py(), dtype=np.int64))
                at.append(positions.astype(np.int64))
                hs.append(hashes)
                held += len(positions)
                if held > 100_000:
                    yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(at)), _longs(np.concatenate(hs))], ["doc", "pos", "h"])
                    ids, at, hs, held = [], [], [], 0
            if held:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(at)), _longs(np.concatenate(hs))], ["doc", "pos", "h"])

    return docs.mapInArrow(run, "doc bigint, pos bigint, h bigint")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur in more than one document. Groups are only counted, never gathered."""
    twice = rows.groupBy(*keys).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select(*keys)
    return rows.join(twice, keys, "left_semi")


def occurrences(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """doc, pos, h, before, around of every fingerprint of ``places``: the text around it as far as a passage may reach.

    ``before`` counts the characters that stand before the fingerprint in ``around``.
    """
    length = least - least // 2
    reach = least - length
    held = places.groupBy("doc").agg(F.collect_list(F.struct("pos", "h")).alias("places"))  # at most the marks of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, at in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("places"), strict=True):
                n = len(text)
                points = code_points(text)
                positions = np.asarray(at.values.field("pos"), dtype=np.int64)
                wanted = np.asarray(at.values.field("h"), dtype=np.int64)
                order = np.argsort(positions)
                positions, wanted = positions[order], wanted[order]
                inside = positions + length <= n
                positions, wanted = positions[inside], wanted[inside]
                true = window_hashes(points, length, 0, positions).view(np.int64) == wanted if len(positions) else inside[:0]
                for pos, h in zip(positions[true].tolist(), wanted[true].tolist(), strict=True):
                    left = max(0, pos - reach)
                    for column, value in zip(out, (doc, pos, h, pos - left, text[left : pos + length + reach]), strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield _occurrence_batch(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _occurrence_batch(out)

    return docs.join(held, "doc").select("doc", "text", "places").mapInArrow(run, "doc bigint, pos bigint, h bigint, before int, around string")


def _occurrence_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "pos", "h", "before", "around"])


#: Classes of one fingerprint that one task compares in memory; fingerprints of more are compared by shuffled windows.
FEW = 4096


def _window_table(befores: np.ndarray, arounds: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, offset, two hashes of every window that holds the fingerprint of its row; offsets count from the leftmost possible start."""
    length = least - least // 2
    reach = least - length
    sizes = np.array([len(a) for a in arounds], dtype=np.int64)
    ends = np.cumsum(sizes)
    low, high = reach - befores, np.minimum(sizes - befores - length, reach)
    counts = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
    starts = (ends - sizes)[row] + offset - low[row]
    points = code_points("".join(arounds))
    return row, offset, window_hashes(points, least, 0, starts), window_hashes(points, least, 1, starts)


def _lone_runs(groups: np.ndarray, befores: np.ndarray, arounds: list[str], a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, lo, hi: for rows of a single document the runs of window offsets that another document of the group shares."""
    row, offset, h1, h2 = _window_table(befores, arounds, least)
    if not len(row):
        return row, row, row
    key = mixed(h1 ^ mixed(groups[row].view(_U) + offset.astype(_U) * _U(_MIX[0])))
    order = np.argsort(key, kind="stable")
    k, second = key[order], h2[order]
    begins = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (second[1:] != second[:-1])]))
    low, high = np.minimum.reduceat(a[row[order]], begins), np.maximum.reduceat(b[row[order]], begins)
    shared = np.empty(len(row), dtype=bool)
    shared[order] = np.repeat(low < high, np.diff(np.append(begins, len(row))))
    shared &= (a == b)[row]
    at = np.flatnonzero(shared)
    new = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (offset[at][1:] != offset[at][:-1] + 1)]) if len(at) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[at][first], offset[at][first], offset[at][last]


def shared_offsets(found: DataFrame, least: int) -> DataFrame:
    """h, before, around, lo, hi: for every class of occurrences the runs of window offsets that two documents share.

    A class of two documents shares all its windows. A class of one document is compared with the other classes of its
    fingerprint, in memory where they are few, else by windows that are counted after a shuffle.
    """
    length = least - least // 2
    reach = least - length
    classes = found.groupBy("h", "before", "around").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    whole = classes.where("a < b").select("h", "before", "around", (F.lit(reach) - F.col("before")).alias("lo"), F.least(F.length("around") - F.col("before") - length, F.lit(reach)).alias("hi")).where("lo <= hi")
    sizes = classes.groupBy("h").agg(F.count("*").alias("classes"), F.count_if(F.col("a") == F.col("b")).alias("lone")).where("lone > 0 and classes > 1").select("h", "classes")
    open_ = classes.join(sizes, "h")
    schema = "h bigint, before int, around string, lo int, hi int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last group may go on
            rest = table.slice(cut)
            if cut:
                yield from _lone_batch(table.slice(0, cut), least)
        if rest is not None and rest.num_rows:
            yield from _lone_batch(rest, least)

    few = open_.where(F.col("classes") <= FEW).select("h", "before", "around", "a", "b").repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                row, offset, h1, h2 = _window_table(part.column("before").to_numpy().astype(np.int64), part.column("around").to_pylist(), least)
                at = pa.array(row)
                yield pa.record_batch([*(part.column(c).take(at) for c in ("h", "before", "around", "a", "b")), pa.array(offset.astype(np.int32)), _longs(h1), _longs(h2)], ["h", "before", "around", "a", "b", "lo", "h1", "h2"])

    wide = open_.where(F.col("classes") > FEW).select("h", "before", "around", "a", "b").mapInArrow(spread, "h bigint, before int, around string, a bigint, b bigint, lo int, h1 bigint, h2 bigint")
    both = wide.groupBy("h", "lo", "h1", "h2").agg(F.min("a").alias("x"), F.max("b").alias("y")).where("x < y").select("h", "lo", "h1", "h2")
    many = wide.where("a = b").join(both, ["h", "lo", "h1", "h2"], "left_semi").select("h", "before", "around", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(few).unionByName(many)


def _lone_batch(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    part = table.combine_chunks()
    number = lambda c: part.column(c).to_numpy().astype(np.int64)
    row, lo, hi = _lone_runs(number("h"), number("before"), part.column("around").to_pylist(), number("a"), number("b"), least)
    held = part.select(["h", "before", "around"]).take(pa.array(row)).combine_chunks()
    if len(row):
        yield pa.record_batch([*(held.column(c).chunk(0) for c in held.column_names), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["h", "before", "around", "lo", "hi"])


def shared_spans(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, span_start, span_chars: the maximal runs of characters that lie in a passage of at least ``least`` code
    points which stands verbatim in the text of another document.

    Runs that touch or overlap are one. Null texts and texts shorter than ``least`` share nothing; exact copies share
    their whole text. Repetition inside one document, and a repeated row of one document, do not count; of different
    texts of one id the greatest counts. Fingerprints count as equal when their 64-bit hashes agree, windows of different
    surroundings when two more independent 64-bit hashes agree. An empty table gives no row; other columns are not read.
    """
    reach = least // 2
    docs = _wide(df, doc, text, least)
    places = _shared(stored(marks(docs, least)), ["h"])
    found = stored(occurrences(docs.groupBy("doc").agg(F.max("text").alias("text")), places, least))
    runs = shared_offsets(found, least).select("h", "before", F.xxhash64("around").alias("c"), "lo", "hi")
    spots = found.select("doc", "pos", "h", "before", F.xxhash64("around").alias("c")).join(runs, ["h", "before", "c"])
    starts = spots.groupBy("doc", (F.col("pos") - reach + F.col("lo")).alias("first")).agg(F.max(F.col("pos") - reach + F.col("hi")).alias("last"))
    order = Window.partitionBy("doc").orderBy("first")
    so_far = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > so_far + least, F.lit(True))
    numbered = starts.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "run").agg(F.min("first").alias("span_start"), F.max("last").alias("last")).select(F.col("doc").alias("doc_id"), "span_start", (F.col("last") + least - F.col("span_start")).alias("span_chars"))


def shares(df: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chars, shared_chars, share of every document: how much of it stands elsewhere too.

    A null or empty text has 0 characters and share 0.
    """
    total = spans.groupBy(F.col("doc_id").alias(doc)).agg(F.sum("span_chars").alias("shared_chars"))
    size = df.select(doc, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars")).groupBy(doc).agg(F.max("chars").alias("chars"))
    joined = size.join(total, doc, "left").select(F.col(doc).alias("doc_id"), "chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"))
    return joined.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))


#: Everything that is trimmed from a line before it is compared: blanks of all kinds, carriage returns, separators.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF]))
#: Lines of fewer code points are not compared: short lines (numbers, headings, single words) repeat by chance.
LEAST_LINE = 20


def line_units(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_LINE) -> DataFrame:
    """doc_id, unit, unit_start, unit_chars, compared, occurrences, elsewhere, kept: every line of every text.

    A line is normalised by trimming blanks of all kinds; its digest (two 64-bit hashes) is grouped over all documents.
    ``kept`` marks the earliest occurrence by (doc_id, unit); later ones are what a deduplicated corpus leaves out. A line of
    fewer than ``least`` code points is not ``compared``: it is kept, and counts as one occurrence. Offsets count code points
    of the original text from 0. Null texts have no line, an empty text has one empty line. Groups are reduced to their
    earliest member before they are shuffled, and only groups of several lines are joined back.
    """
    line = F.btrim("line", F.lit(BLANKS))
    lines = stored(
        df.where(F.col(doc).isNotNull() & F.col(text).isNotNull())
        .select(F.col(doc).alias("doc_id"), F.split(text, "\n").alias("lines"))
        .withColumn("sizes", F.transform("lines", lambda x: F.length(x)))
        .withColumn("starts", F.aggregate("sizes", F.array(F.lit(0).cast("bigint")), lambda s, y: F.concat(s, F.array(F.element_at(s, -1) + y + 1))))
        .select("doc_id", F.posexplode(F.arrays_zip("lines", F.slice("starts", F.lit(1), F.size("lines")).alias("starts"))).alias("unit", "l"))
        .select("doc_id", "unit", F.col("l.starts").alias("unit_start"), F.col("l.lines").alias("line"))
        .select("doc_id", "unit", "unit_start", F.length("line").cast("bigint").alias("unit_chars"), (F.length(line) >= least).alias("compared"), F.xxhash64(line).alias("d1"), F.xxhash64(F.lit(1), line).alias("d2"))
    )
    groups = lines.where("compared").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    joined = lines.join(groups.withColumn("compared", F.lit(True)), ["d1", "d2", "compared"], "left")
    return joined.select(
        "doc_id", "unit", "unit_start", "unit_chars", "compared", F.coalesce("n", F.lit(1)).cast("bigint").alias("occurrences"), F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("elsewhere"),
        F.coalesce(F.struct("doc_id", "unit") == F.col("first"), F.lit(True)).alias("kept"),
    )


def without_repeats(df: DataFrame, units: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, lines_left, lines_removed, removed: each text without the lines that ``units`` does not keep.

    ``removed`` names the lines left out by their place in the original text, as start:chars, in order, joined by commas;
    empty where none was. Null texts stay null. Ids must be unique: lines are removed by id.
    """
    gone = units.where("not kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "unit_start", "unit_chars"))).alias("gone"))  # the lines of one text
    docs = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(gone, "doc_id", "left")
    out = F.coalesce(F.transform("gone", lambda g: g["unit"]), F.array().cast("array<int>"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(out, i))
    return docs.select(
        "doc_id", F.when(F.size(out) == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.size(left).cast("bigint").alias("lines_left"), F.size(out).cast("bigint").alias("lines_removed"),
        F.array_join(F.transform(F.coalesce("gone", F.expr("cast(array() as array<struct<unit:int,unit_start:bigint,unit_chars:bigint>>)")), lambda g: F.concat_ws(":", g["unit_start"].cast("string"), g["unit_chars"].cast("string"))), ",").alias("removed"),
    )

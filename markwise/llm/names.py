"""Variant spellings of names typed by people.

Names become weighted vectors of character n-grams: the whole name, whatever the order of its parts, and each part that
may be its surname. Within a block (a class) a sparse similarity join gives every pair of names whose surnames reach a
cosine and whose given names begin alike: names are indexed by the heaviest n-grams that any partner must share, each
together with a letter of the given name's beginning, so that common n-grams hardly meet even in a block that holds a
third of all names; keys that are still heavy are salted. A pair's similarity is the cosine of the whole names, unless the
check that follows finds a part that contradicts (surname, given name, middle names; typing slips, initials and short
forms allowed). Average-linkage clustering of these similarities groups the students.

Names in Chinese characters go through the same join as a whole: their n-grams are characters and pairs of characters
with their position, characters of one Mandarin reading (ICU, without tones) counted as the same.

Short forms of given names, and characters typed for one another, are learned from the table itself: from refs that
carry several spellings of one student.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.session import checkpointed, stored

# Letters that Unicode does not take apart, and doubled spellings of marked vowels.
PLAIN = {"ø": "o", "æ": "a", "œ": "o", "ß": "ss", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "þ": "th"}
DOUBLED = (("oe", "o"), ("ae", "a"), ("ue", "u"), ("aa", "a"))
# Words added to a name that are no part of it.
ADDED = ("同学",)
#: Least cosine of two surnames that are looked at, and least similarity of two clusters that are one student.
COSINE, LINKED = 0.35, 0.6
#: An n-gram rarer than one in so many name parts weighs no more than one of that rarity: slips make rare n-grams.
RAREST = 200
#: A pair of given names, or of characters, that so many refs show counts if it is not rarer than one in SHARE of the best
#: pairs of either end; one that fewer show only if that holds for both ends, so that one ref with a wrong name teaches
#: nothing about a name that many refs show.
SUPPORT, SHARE = 2, 50
#: Keys of more names in one block are salted.
HEAVY = 1000
#: Blocks of more names are joined through the distributed index instead of one matrix; the pairs are the same.
MANY_NAMES = 500
#: Blocks of more links are clustered by distributed rounds instead of in one task; the groups are the same.
MANY_LINKS = 2000
#: Hash slots of the n-gram weights: the table of weights that is sent to the workers has this size, whatever the corpus.
SLOTS = 1 << 16
#: Similarity of two names in Chinese characters of the same sounds, and of two that differ in the sound of one character.
#: The second alone links nobody (brothers and sisters differ so); it counts in the mean of two clusters.
SAME_SOUND, ONE_SOUND = 0.9, 0.5
#: Combining marks of the four tones.
TONES = dict.fromkeys(map(ord, "\u0304\u0301\u030c\u0300"))
HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: The same for rlike.
HAN_SQL = HAN.pattern


@lru_cache(maxsize=100_000)
def folded(name: str) -> tuple[str, ...]:
    """Parts of a name, without case, accents, order marks and additions; surname last where a comma tells it.

    A name in Chinese characters is one part, its characters without blanks. Empty for a name without letters.
    """
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]|（[^）]*）", " ", text)
    for word in ADDED:
        text = text.replace(word, " ")
    if HAN.search(text):
        return ("".join(c for c in text if c.isalpha()),)
    text = unicodedata.normalize("NFD", text.casefold())
    text = "".join(PLAIN.get(c, c) for c in text if not unicodedata.combining(c))
    before, comma, after = text.partition(",")
    if comma:
        text = f"{after} {before}"
    parts = ["".join(c for c in p if c.isalpha()) for p in re.split(r"[\s._\-,;/]+", text)]
    out = []
    for part in parts:
        for double, single in DOUBLED:
            part = part.replace(double, single) if len(part) > 2 else part
        if part:
            out.append(part)
    return tuple(out)


def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if before2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


@lru_cache(maxsize=200_000)
def spelled_alike(a: str, b: str) -> float:
    """How alike two parts are by their letters alone."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4:
        return 0.0
    d = slips(a, b)
    return 0.9 if d == 1 else 0.75 if d == 2 and min(len(a), len(b)) >= 6 else 0.0


def parts_alike(a: str, b: str, short: dict[str, tuple[str, ...]]) -> float:
    """How alike two given names are, short forms counted: the better of the letters and of any known other form."""
    best = spelled_alike(a, b)
    if best < 0.9:
        for x in short.get(a, ()):
            best = max(best, 0.95 * spelled_alike(x, b))
        for x in short.get(b, ()):
            best = max(best, 0.95 * spelled_alike(a, x))
    return best


def begins(given: str, short: dict[str, tuple[str, ...]]) -> set[str]:
    """The first two letters of a given name and of its other forms, of which one survives any slip at the beginning."""
    return {letter for form in (given, *short.get(given, ())) for letter in form[:2]}


def splits(name: tuple[str, ...]) -> list[tuple[str, tuple[str, ...]]]:
    """The ways to read a name as surname and given names: the surname stands first or last and has two letters or more."""
    if len(name) < 2:
        return []
    return [(s, rest) for s, rest in {name[0]: name[1:], name[-1]: name[:-1]}.items() if len(s) > 1]


def heard(name: str, short: dict[str, tuple[str, ...]]) -> str:
    """A name in Chinese characters by its sounds, which ``short`` holds as its other form; as it is written if unknown."""
    return short.get(name, (name,))[0]


def characters_alike(a: str, b: str, short: dict[str, tuple[str, ...]], near: Callable[[str, str], bool]) -> float:
    """Similarity of two different names in Chinese characters: by the characters whose sounds differ."""
    a, b = heard(a, short), heard(b, short)
    if a == b:
        return SAME_SOUND
    differ = sum(x != y for x, y in zip(a, b, strict=False))
    return ONE_SOUND if len(a) == len(b) >= 3 and differ == 1 and near(a, b) else 0.0


def names_alike(a: tuple[str, ...], b: tuple[str, ...], short: dict[str, tuple[str, ...]], near: Callable[[str, str], bool] = lambda x, y: True) -> float:
    """Similarity of two folded names in [0, 1]; 0 where a part contradicts.

    The surname is the first or the last part; two surnames must be ``near`` and within two slips. The given name is the
    first of the rest, and must begin alike; middle names may be missing on one side, but must not contradict. Latin
    names of one part are alike only if equal; names in Chinese characters are compared by their sounds.
    """
    if a == b:
        return 1.0
    if len(a) == len(b) == 1 and HAN.search(a[0]) and HAN.search(b[0]):
        return characters_alike(a[0], b[0], short, near)
    best = 0.0
    for surname_a, rest_a in splits(a):
        for surname_b, rest_b in splits(b):
            if not near(surname_a, surname_b) or not begins(rest_a[0], short) & begins(rest_b[0], short):
                continue
            surname = spelled_alike(surname_a, surname_b)
            if surname < 0.7:
                continue
            given = parts_alike(rest_a[0], rest_b[0], short)
            middles = [parts_alike(x, y, short) for x, y in zip(rest_a[1:], rest_b[1:], strict=False)]
            if not given or 0.0 in middles:
                continue
            middle = min(middles) if middles else 1.0 if len(rest_a) == len(rest_b) else 0.7
            best = max(best, 0.5 * surname + 0.4 * given + 0.1 * middle)
    return best


def grams(part: str) -> list[str]:
    """The two-letter n-grams of a part with its ends; of Chinese characters each and each two, with their position.

    Two letters, since one slip leaves at least two in five of them, but hardly any longer n-gram of a short name.
    """
    if HAN.search(part):
        return [f"{i}{part[i : i + n]}" for n in (1, 2) for i in range(len(part) - n + 1)]
    whole = f"^{part}$"
    return sorted({whole[i : i + 2] for i in range(len(whole) - 1)})


def slot(gram: str) -> int:
    """Hash slot of a feature; those of Chinese characters have slots of their own behind the others."""
    return xxhash.xxh32_intdigest(gram) % SLOTS + (SLOTS if HAN.search(gram) else 0)


def sounded(form: tuple[str, ...], short: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The parts of a name; a name in Chinese characters by its sounds."""
    return (heard(form[0], short),) if len(form) == 1 and HAN.search(form[0]) else form


def surnames(form: tuple[str, ...], short: dict[str, tuple[str, ...]]) -> list[tuple[str, set[str]]]:
    """What of a name becomes vectors, each with the letters that a partner's given name may begin with.

    Each possible surname; a name in Chinese characters as a whole by its sounds, with no letter asked.
    """
    if len(form) == 1 and HAN.search(form[0]):
        return [(heard(form[0], short), {""})]
    return [(s, begins(rest[0], short)) for s, rest in splits(form)]


def other_forms(others: list | None) -> dict[str, tuple[str, ...]]:
    """The other forms of a node's parts as a dict."""
    return {x["key"]: tuple(x["value"]) for x in others} if others is not None else {}


def spellings(attempts: DataFrame, ref: str = "student_ref", name: str = "student_name", block: str = "class_id") -> DataFrame:
    """ref, block, parts: the distinct folded names of each ref, with the block that most of its rows name.

    Null or empty names, and names without letters, are left out; so are refs without any block. Ties between blocks go
    to the greater one.
    """
    rows = attempts.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("ref"), F.col(block).alias("block"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    place = rows.where("block <> ''").groupBy("ref", "block").agg(F.sum("n").alias("n")).groupBy("ref").agg(F.max(F.struct("n", "block")).alias("m")).select("ref", F.col("m.block").alias("block"))

    @F.pandas_udf("array<string>")
    def fold(names: pd.Series) -> pd.Series:
        return pd.Series([list(folded(n)) for n in names], dtype=object)

    forms = rows.where("name <> ''").select("ref", "name").distinct().select("ref", fold("name").alias("parts")).where(F.size("parts") > 0).distinct()
    return forms.join(place, "ref").select("ref", "block", "parts")


def shown_often(pairs: DataFrame, a: str, b: str, share: int = SHARE) -> DataFrame:
    """The ``pairs`` (a, b, n) that are shown often enough beside the best pairs of both ends; see SUPPORT."""
    ends = pairs.select(F.col(a).alias("end"), "n").unionByName(pairs.select(F.col(b).alias("end"), "n")).groupBy("end").agg(F.max("n").alias("best"))
    joined = pairs.join(ends.withColumnsRenamed({"end": a, "best": "best_a"}), a).join(ends.withColumnsRenamed({"end": b, "best": "best_b"}), b)
    return joined.where((F.col("n") * share >= F.greatest("best_a", "best_b")) | ((F.col("n") >= SUPPORT) & (F.col("n") * share >= F.least("best_a", "best_b")))).select(a, b, "n")


def short_forms(names: DataFrame) -> DataFrame:
    """part, others: for each given name the other forms that refs show beside the same surname and middle names.

    Pairs are counted by ref and surname; nothing is gathered but the distinct forms of one given name.
    """
    latin = names.where((F.size("parts") > 1) & ~F.col("parts")[0].rlike("[\u2e80-\uffff]"))
    first = latin.select("ref", F.col("parts")[0].alias("surname"), F.expr("slice(parts, 2, size(parts) - 1)").alias("rest"))
    last = latin.select("ref", F.element_at("parts", -1).alias("surname"), F.expr("slice(parts, 1, size(parts) - 1)").alias("rest"))
    split = first.unionByName(last).where(F.length("surname") > 3).select("ref", "surname", F.col("rest")[0].alias("given"), F.expr("slice(rest, 2, size(rest))").alias("middle")).where(F.length("given") > 1).distinct()
    shown = split.groupBy("ref", "surname", "middle").agg(F.collect_set("given").alias("givens")).where(F.size("givens") > 1)  # the spellings of one ref
    pairs = shown.select("ref", F.explode("givens").alias("given"), "givens").select("ref", "given", F.explode("givens").alias("other")).where("given <> other").groupBy("given", "other").agg(F.count_distinct("ref").alias("n"))
    return shown_often(checkpointed(pairs), "given", "other").groupBy(F.col("given").alias("part")).agg(F.sort_array(F.collect_set("other")).alias("others"))


def same_characters(names: DataFrame) -> dict[str, str]:
    """For each Chinese character that refs show in place of another one of the same name, the first of its group.

    A name of one character says nothing about what stands for it. What reaches the driver are the pairs that are shown
    often enough, which the number of Chinese characters in use bounds.
    """
    han = names.where((F.size("parts") == 1) & F.col("parts")[0].rlike("[\u3400-\uffff]")).select("ref", F.col("parts")[0].alias("name")).where("length(name) >= 2").distinct()
    several = han.groupBy("ref").agg(F.collect_list("name").alias("names")).where(F.size("names") > 1).select("ref", F.explode("names").alias("name"))  # the spellings of one ref
    masked = several.select("ref", "name", F.explode(F.expr("sequence(1, length(name))")).alias("at")).select(
        "ref", "at", F.expr("concat(substring(name, 1, at - 1), '*', substring(name, at + 1))").alias("mask"), F.expr("substring(name, at, 1)").alias("char")
    )
    shown = masked.groupBy("ref", "at", "mask").agg(F.collect_set("char").alias("chars")).where(F.size("chars") > 1)
    pairs = shown.select("ref", F.explode("chars").alias("char"), "chars").select("ref", "char", F.explode("chars").alias("other")).where("char < other").groupBy("char", "other").agg(F.count_distinct("ref").alias("n"))
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for a, b in sorted((r["char"], r["other"]) for r in shown_often(checkpointed(pairs), "char", "other").collect()):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {c: find(c) for c in list(root)}


def readings(spark: SparkSession, chars: list[str]) -> dict[str, str]:
    """The Mandarin reading of each character without its tone, by the ICU library that Spark brings along.

    A character without a reading stands for itself.
    """
    latin = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin").transliterate("\n".join(chars)).split("\n")
    return {c: unicodedata.normalize("NFC", unicodedata.normalize("NFD", x.strip()).translate(TONES)) for c, x in zip(chars, latin, strict=True)} if chars else {}


def same_sounds(names: DataFrame) -> dict[str, str]:
    """For each Chinese character of the names the first of its reading; bounded by the number of characters."""
    han = names.select(F.explode("parts").alias("name")).where(F.col("name").rlike(HAN_SQL))
    chars = sorted(r["char"] for r in han.select(F.explode(F.expr("transform(sequence(1, length(name)), i -> substring(name, i, 1))")).alias("char")).distinct().collect())
    first: dict[str, str] = {}
    return {c: first.setdefault(sound, c) for c, sound in readings(names.sparkSession, chars).items()}


def nodes(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct students-to-be: (node, block, forms, others), and the membership (ref, node).

    A ref keeps its fullest forms: those with the most parts of more than one letter. Characters typed for one another
    count as the first of their group. Refs of one block with the same forms are one node, named by the least ref.
    ``others`` maps the parts of the forms to their other forms, names in Chinese characters to their sounds.
    """
    spark = names.sparkSession
    same, sounds = spark.sparkContext.broadcast(same_characters(names)), spark.sparkContext.broadcast(same_sounds(names))

    @F.pandas_udf("array<string>")
    def unified(parts: pd.Series) -> pd.Series:
        leader = same.value
        return pd.Series([["".join(leader.get(c, c) for c in p) if HAN.search(p) else p for p in ps] for ps in parts], dtype=object)

    @F.pandas_udf("string")
    def spoken(parts: pd.Series) -> pd.Series:
        first = sounds.value
        return pd.Series(["".join(first.get(c, c) for c in p) for p in parts], dtype=object)

    forms = names.select("ref", "block", unified("parts").alias("parts")).distinct().withColumn("full", F.size(F.filter("parts", lambda p: F.length(p) > 1)))
    most = forms.groupBy("ref").agg(F.max("full").alias("most"))
    kept = forms.join(most, "ref").where("full = most").groupBy("ref", "block").agg(F.sort_array(F.collect_set("parts")).alias("forms"))
    kept = stored(kept)
    heads = kept.groupBy("block", "forms").agg(F.min("ref").alias("node"))
    members = kept.join(heads, ["block", "forms"]).select("ref", "node")
    each = heads.select("node", F.explode(F.array_distinct(F.flatten("forms"))).alias("part"))
    han = each.where(F.col("part").rlike(HAN_SQL)).select("node", "part", F.array(spoken("part")).alias("others"))
    parts = each.join(short_forms(names), "part").select("node", "part", "others").unionByName(han).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "others"))).alias("others"))
    return stored(heads.join(parts, "node", "left").select("node", "block", "forms", "others")), members


def gram_weights(heads: DataFrame) -> np.ndarray:
    """Weight of each hash slot: the log of how rare its n-grams are among all parts of names. Its size is fixed.

    Names in Chinese characters are counted among themselves, in the second half.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(2 * SLOTS + 2, dtype=np.int64)
        for batch in batches:
            for forms, others in zip(batch["forms"], batch["others"], strict=True):
                short = other_forms(others)
                for part in {x for form in forms for x in sounded(tuple(form), short)}:
                    seen[2 * SLOTS + bool(HAN.search(part))] += 1
                    for g in grams(part):
                        seen[slot(g)] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": at, "n": seen[at]})

    counts = np.zeros(2 * SLOTS + 2)
    for r in heads.select("forms", F.map_entries("others").alias("others")).mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    whole = np.repeat(counts[2 * SLOTS :], SLOTS)
    return np.log1p(whole / np.maximum(counts[: 2 * SLOTS], np.maximum(1.0, whole / RAREST)))


def vector(surname: str, weights: np.ndarray) -> dict[str, float]:
    """The n-gram vector of a surname, of length 1."""
    v = {g: float(weights[slot(g)]) for g in grams(surname)}
    length = sum(x * x for x in v.values()) ** 0.5
    return {g: x / length for g, x in v.items()} if length else {}


def whole_vector(form: tuple[str, ...], short: dict[str, tuple[str, ...]], weights: np.ndarray) -> dict[str, float]:
    """The n-gram vector of a whole name, of length 1, whatever the order of its parts."""
    v: dict[str, float] = {}
    for part in sounded(form, short):
        for g in grams(part):
            v[g] = v.get(g, 0.0) + float(weights[slot(g)])
    length = sum(x * x for x in v.values()) ** 0.5
    return {g: x / length for g, x in v.items()} if length else {}


def index_grams(v: dict[str, float], cosine: float) -> list[str]:
    """The heaviest n-grams of a vector, so many that the others alone cannot reach ``cosine`` with any vector."""
    rest, out = 1.0, []
    for gram, weight in sorted(v.items(), key=lambda x: (-x[1], x[0])):
        if rest < cosine * cosine:
            break
        out.append(gram)
        rest -= weight * weight
    return out


def index_keys(form: tuple[str, ...], short: dict[str, tuple[str, ...]], weights: np.ndarray, cosine: float) -> set[tuple[str, str]]:
    """Keys, with their surname, of which two names share one if their surnames reach ``cosine`` and their given names begin alike.

    A name that has no surname to split off has itself as its key.
    """
    keys = {(f"{g}{letter}", surname) for surname, letters in surnames(form, short) for g in index_grams(vector(surname, weights), cosine) for letter in letters}
    whole = " ".join(form)
    return keys or {(f"={whole}", whole)}


def cosine_of(a: dict[str, float], b: dict[str, float]) -> float:
    """Cosine of two vectors of length 1."""
    return sum(x * b.get(g, 0.0) for g, x in a.items())


def links(heads: DataFrame, cosine: float = COSINE) -> DataFrame:
    """block, a, b, alike: all pairs of nodes of one block with surnames of at least ``cosine``, and how alike they are (above 0).

    No partner is capped. A block of up to MANY_NAMES nodes is one product of its sparse n-gram matrix with itself; larger
    ones go through the distributed index of :func:`links_by_index`. Blocks come sorted, so a task holds one at a time.
    """
    spark = heads.sparkSession
    sent = spark.sparkContext.broadcast(gram_weights(heads))
    size = heads.groupBy("block").agg(F.count("*").alias("n"))
    flat = ("node", "block", "forms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for node, block, forms, others in zip(batch["node"], batch["block"], batch["forms"], batch["others"], strict=True):
                if block != at:
                    out += block_links(at, held, sent.value, cosine)
                    at, held = block, []
                held.append((node, [tuple(f) for f in forms], other_forms(others)))
            yield pd.DataFrame(out, columns=["block", "a", "b", "alike"])
        yield pd.DataFrame(block_links(at, held, sent.value, cosine), columns=["block", "a", "b", "alike"])

    sized = heads.join(size, "block")
    few = sized.where(F.col("n") <= MANY_NAMES).select(*flat, F.map_entries("others").alias("others")).repartition("block").sortWithinPartitions("block").mapInPandas(run, "block string, a string, b string, alike double")
    if size.where(F.col("n") > MANY_NAMES).isEmpty():
        return few
    return few.unionByName(links_by_index(sized.where(F.col("n") > MANY_NAMES).drop("n"), sent, cosine))


def block_links(block: str | None, held: list[tuple], weights: np.ndarray, cosine: float) -> list[tuple]:
    """The links of one block whose nodes are held as (node, forms, other forms)."""
    # a name that has no surname to split off meets only itself
    rows = [(i, surname, letters) for i, (_, forms, short) in enumerate(held) for form in forms for surname, letters in surnames(form, short) or [(" ".join(form), {"="})]]
    if not rows:
        return []
    columns: dict[str, int] = {}
    vectors = [vector(surname, weights) for _, surname, _ in rows]
    for v in vectors:
        for g in v:
            columns.setdefault(g, len(columns))
    matrix = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for r, v in enumerate(vectors):
        for g, w in v.items():
            matrix[r, columns[g]] = w
    # a little below the threshold, since the product is of single precision; the check decides
    left, right = np.nonzero(np.triu(matrix @ matrix.T >= cosine - 1e-4))
    pairs = {tuple(sorted((rows[x][0], rows[y][0]))) for x, y in zip(left.tolist(), right.tolist(), strict=True) if rows[x][0] != rows[y][0] and rows[x][2] & rows[y][2]}
    of = {surname: v for (_, surname, _), v in zip(rows, vectors, strict=True)}
    near = lambda x, y: cosine_of(of[x], of[y]) >= cosine
    out = []
    for i, j in sorted(pairs):
        (a, forms_a, short_a), (b, forms_b, short_b) = held[i], held[j]
        short = short_a | short_b
        alike = max(similarity(x, y, short, near, weights) for x in forms_a for y in forms_b)
        if alike > 0:
            out.append((block, min(a, b), max(a, b), alike))
    return out


def links_by_index(heads: DataFrame, sent: Broadcast, cosine: float) -> DataFrame:
    """The same pairs by an inverted index: block, a, b, alike.

    Two vectors of that cosine share one of each other's index n-grams, because both order n-grams by the same weights and
    cut where the rest cannot reach the threshold.
    """
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, block, forms, others in zip(batch["node"], batch["block"], batch["forms"], batch["others"], strict=True):
                short = other_forms(others)
                out += [(node, block, *k) for k in set().union(*(index_keys(tuple(f), short, sent.value, cosine) for f in forms))]
            yield pd.DataFrame(out, columns=["node", "block", "key", "surname"])

    rows = stored(heads.select("node", "block", "forms", F.map_entries("others").alias("others")).mapInPandas(index, "node string, block string, key string, surname string"))
    # a heavy key meets itself in salted parts: each name once on the left, in every part on the right
    heavy = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("block", "key", F.ceil(F.col("n") / HEAVY).cast("int").alias("salts"))
    salted = rows.join(heavy, ["block", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted.select("block", "key", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.col("node").alias("a"), F.col("surname").alias("x"))
    right = salted.select("block", "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("b"), F.col("surname").alias("y"))
    met = left.join(right, ["block", "key", "salt"]).where("a < b")
    # two slips are at most four edits, a swap being two, and of Chinese characters one may differ: most pairs of a common
    # n-gram end here, inside the JVM
    pairs = met.where(F.when(F.col("x").rlike(HAN_SQL), F.levenshtein("x", "y", 1) >= 0).otherwise(F.levenshtein("x", "y", 4) >= 0)).select("block", "a", "b").distinct()
    side = lambda name: heads.select(F.col("node").alias(name), F.col("forms").alias(f"forms_{name}"), F.map_entries(F.col("others")).alias(f"others_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("double")
    def alike(forms_a: pd.Series, forms_b: pd.Series, others_a: pd.Series, others_b: pd.Series) -> pd.Series:
        weights, out = sent.value, []
        of = lru_cache(maxsize=50_000)(lambda surname: vector(surname, weights))
        near = lambda x, y: cosine_of(of(x), of(y)) >= cosine
        for fa, fb, oa, ob in zip(forms_a, forms_b, others_a, others_b, strict=True):
            short = other_forms(oa) | other_forms(ob)
            out.append(max(similarity(tuple(a), tuple(b), short, near, weights) for a in fa for b in fb))
        return pd.Series(out)

    return both.select("block", "a", "b", alike("forms_a", "forms_b", "others_a", "others_b").alias("alike")).where("alike > 0")


def similarity(a: tuple[str, ...], b: tuple[str, ...], short: dict[str, tuple[str, ...]], near: Callable[[str, str], bool], weights: np.ndarray) -> float:
    """Similarity of two names: the cosine of the whole names, from 0.5 for none to 1, if no part contradicts, else 0.

    The check may also leave it open (names in Chinese characters that differ in one sound): then it is 0.5, which links
    nobody by itself and counts in the mean of two clusters.
    """
    checked = names_alike(a, b, short, near)
    if checked < LINKED:
        return min(checked, ONE_SOUND)
    return 0.5 + 0.5 * cosine_of(whole_vector(a, short, weights), whole_vector(b, short, weights))


def average_linkage(edges: list[tuple[str, str, float]], linked: float = LINKED) -> dict[str, str]:
    """The cluster of every node that joins one, by average linkage in memory; the same groups as :func:`clustered`."""
    sums: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        sums.setdefault(a, {})[b] = sums.setdefault(b, {})[a] = w
    size = dict.fromkeys(sums, 1)
    cluster: dict[str, list[str]] = {x: [x] for x in sums}
    while True:
        best = {}
        for x, others in sums.items():
            near = [(-w / (size[x] * size[y]), min(x, y), max(x, y), y) for y, w in others.items() if w / (size[x] * size[y]) >= linked]
            if near:
                best[x] = min(near)[3]
        merged = [(x, y) for x, y in best.items() if x < y and best.get(y) == x]
        if not merged:
            return {node: name for name, nodes_ in cluster.items() if len(nodes_) > 1 for node in nodes_}
        for lo, hi in merged:
            cluster[lo] += cluster.pop(hi)
            size[lo] += size.pop(hi)
            for other, w in sums.pop(hi).items():
                del sums[other][hi]
                if other != lo:
                    sums[lo][other] = sums[other][lo] = sums[lo].get(other, 0.0) + w


def clustered_in_blocks(edges: DataFrame, linked: float = LINKED) -> DataFrame:
    """node, cluster for every node that joins a cluster of more than one; ``edges`` are block, a, b, alike within blocks.

    A block of up to MANY_LINKS links is clustered in one task, block by block as they come sorted; blocks of more links go
    through the distributed rounds of :func:`clustered`.
    """
    edges = stored(edges)
    size = edges.groupBy("block").agg(F.count("*").alias("n"))
    sized = edges.join(size, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out: list[tuple[str, str]] = []
            for block, a, b, w in zip(batch["block"], batch["a"], batch["b"], batch["alike"], strict=True):
                if block != at:
                    out += average_linkage(held, linked).items()
                    at, held = block, []
                held.append((a, b, w))
            yield pd.DataFrame(out, columns=["node", "cluster"])
        yield pd.DataFrame(list(average_linkage(held, linked).items()), columns=["node", "cluster"])

    few = sized.where(F.col("n") <= MANY_LINKS).select("block", "a", "b", "alike").repartition("block").sortWithinPartitions("block").mapInPandas(run, "node string, cluster string")
    many = sized.where(F.col("n") > MANY_LINKS).select("a", "b", "alike")
    return few if size.where(F.col("n") > MANY_LINKS).isEmpty() else few.unionByName(clustered(many, linked))


def clustered(edges: DataFrame, linked: float = LINKED) -> DataFrame:
    """node, cluster for every node of ``edges`` that joins a cluster of more than one, by average linkage.

    Pairs without an edge count as 0. Each round merges all pairs of clusters that are each other's nearest, which
    gives the same groups as merging one pair at a time, since average linkage never brings clusters nearer. Ties go to
    the lesser name. A cluster is named by its least node.
    """
    now = checkpointed(edges.select("a", "b", F.col("alike").alias("total"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")))
    labels = None
    while True:
        near = now.withColumn("mean", F.col("total") / (F.col("na") * F.col("nb"))).where(F.col("mean") >= linked)
        sides = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "mean", F.col("na").alias("nx"), F.col("nb").alias("ny")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "mean", F.col("nb").alias("nx"), F.col("na").alias("ny")))
        # of equal means the pair of the lesser names, the same seen from either side
        best = sides.groupBy("x").agg(F.min(F.struct((-F.col("mean")).alias("m"), F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "y", "nx", "ny")).alias("best")).select("x", "best.*")
        mutual = best.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.max(F.col("nx") + F.col("ny")).alias("size")).where("n = 2")
        merged = checkpointed(mutual.select(F.col("hi").alias("old"), F.col("lo").alias("new"), "size"))
        if merged.isEmpty():
            break
        step = merged.select("old", "new")
        labels = step.select(F.col("old").alias("node"), F.col("new").alias("cluster")) if labels is None else checkpointed(
            labels.join(step, labels["cluster"] == step["old"], "left").select("node", F.coalesce("new", "cluster").alias("cluster")).unionByName(step.select(F.col("old").alias("node"), F.col("new").alias("cluster")))
        )
        size = merged.select(F.col("new").alias("c"), F.col("size"))
        moved = now
        for side in ("a", "b"):
            n = f"n{side}"
            moved = moved.join(step.withColumnsRenamed({"old": side, "new": "to"}), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
            moved = moved.join(size.withColumnsRenamed({"c": side, "size": "grown"}), side, "left").withColumn(n, F.coalesce("grown", n)).drop("grown")
        turned = moved.where("a <> b").select(
            F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "total", F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("n1"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("n2")
        )
        now = checkpointed(turned.groupBy(F.col("lo").alias("a"), F.col("hi").alias("b")).agg(F.sum("total").alias("total"), F.max("n1").alias("na"), F.max("n2").alias("nb")))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("cluster")).limit(0)
    return labels.unionByName(labels.select(F.col("cluster").alias("node"), "cluster").distinct())


def students(attempts: DataFrame, ref: str = "student_ref", name: str = "student_name", block: str = "class_id") -> DataFrame:
    """ref, block, student: the student of every ref that has a name and a block, named by the least ref."""
    names = stored(spellings(attempts, ref, name, block))
    heads, members = nodes(names)
    groups = clustered_in_blocks(links(heads))
    placed = members.join(heads.select("node", "block"), "node").join(groups, "node", "left")
    return placed.select("ref", "block", F.coalesce("cluster", "node").alias("student"))


def same_student(found: DataFrame) -> DataFrame:
    """ref_a, ref_b (ref_a < ref_b): the pairs of refs of one student."""
    a = found.select("student", F.col("ref").alias("ref_a"))
    b = found.select("student", F.col("ref").alias("ref_b"))
    return a.join(b, "student").where("ref_a < ref_b").select("ref_a", "ref_b")

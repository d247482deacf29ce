"""Visually identical text to one form.

Ignorable characters go, compatibility forms that look like the plain character are opened, accents are separated.
What is left of a token is a lattice: each character stands for its look-alike class, and the classes partition the
characters. Viterbi search picks the most likely reading of the lattice under character n-gram scores that favour one
script within a token; accents are composed again. Texts that look alike have the same lattice and hence the same
reading; texts that differ visibly differ in some class and hence in the reading.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.session import shipped

# Letters of other scripts by the Latin letter that they look like. Letters that seem alike only in some fonts
# (Greek beta, rho, nu, upsilon, chi in lower case, some Armenian ones) are apart, since there telling them apart matters more.
LETTERS = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟО",
    "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅᏚ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү",
    "æ": "ӕ", "ə": "ә", "Ω": "Ω", "μ": "µ", "φ": "ϕɸ", "θ": "ϑ", "ε": "ϵ", "π": "ϖ", "κ": "ϰ", "Δ": "∆", "Σ": "∑", "Π": "∏",
}
# Signs by the sign that they look like. All hyphens, minus signs and dashes count as one.
SIGNS = {
    "-": "‐‑‒–—―−⁃˗﹘﹣－➖⸺⸻־᠆", "/": "∕⁄⧸", "'": "’‘‛ʼʹ′＇", '"': "“”‟″＂", ":": "∶：", ".": "․．", ",": "‚，", ";": ";；", "*": "∗＊", "~": "∼˜～", "|": "∣ǀ｜", "!": "ǃ！",
    "·": "⋅∙‧•・", "=": "꞊＝", "+": "＋᛭", "<": "‹＜", ">": "›＞", "^": "ˆ", "×": "✕⨯", "°": "˚", "√": "⎷", "(": "（", ")": "）", "?": "？",
}
# Format characters that print something, and characters outside the format class that print nothing.
PRINTING_FORMATS = frozenset("؀؁؂؃؄؅۝܏࣢\U000110bd")
SILENT = frozenset("͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ")
#: Kinds of compatibility forms that keep their look when opened; superscripts, fractions and encircled signs do not.
OPENED = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>", "<square>")
#: Texts and tokens that one worker remembers.
REMEMBERED = 100_000
#: Penalty, in natural logs, of each change of script inside a token.
SWITCH = 4.0


@lru_cache(maxsize=1)
def classes() -> tuple[dict[str, str], dict[str, str]]:
    """The class leader of every character that has look-alikes, and the members of every class, leader first."""
    members = {}
    for table in (LETTERS, SIGNS):
        for leader, others in table.items():
            members[leader] = leader + others
    return {c: leader for leader, all_ in members.items() for c in all_}, members


@lru_cache(maxsize=REMEMBERED)
def opened(char: str) -> str:
    """What one character is when separated from its accents and, where the look stays, from its compatibility form.

    Nothing for characters that print nothing, a plain space for every printing blank.
    """
    if " " < char < "\x7f":
        return char
    kind = unicodedata.category(char)
    if char in "\t\n\x0b\x0c\r\x85" or kind in ("Zs", "Zl", "Zp") or char == "⠀":
        return " "
    if kind == "Cc" or char in SILENT or (kind == "Cf" and char not in PRINTING_FORMATS) or "︀" <= char <= "️" or "\U000e0100" <= char <= "\U000e01ef":
        return ""
    leader, _ = classes()
    if char in leader:
        return leader[char]
    form = unicodedata.decomposition(char)
    if not form:
        return char
    tag, *codes = form.split() if form.startswith("<") else ("", *form.split())
    parts = "".join(chr(int(c, 16)) for c in codes)
    if tag and (tag not in OPENED or (tag == "<compat>" and parts.startswith(" "))):
        return char
    return "".join(opened(c) for c in parts)


def lattice(text: str) -> str:
    """Class leaders of the text with accents separated in canonical order: equal exactly for texts that look alike."""
    if text.isascii() and text.isprintable():
        return text
    parts = unicodedata.normalize("NFD", "".join(map(opened, text)))
    leader, _ = classes()
    return "".join(leader.get(c, c) for c in parts)


@lru_cache(maxsize=4096)
def script(char: str) -> str:
    """Script of a letter by the first word of its name; empty for anything else."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def symbol(char: str) -> str:
    """The n-gram model's symbol: the character itself if it has look-alikes, else its script or kind.

    So the model has at most the square of the look-alike table and the scripts, whatever the corpus.
    """
    leader, _ = classes()
    return char if char in leader else script(char) or unicodedata.category(char)[0]


def bigrams(text: str) -> Iterator[tuple[str, str]]:
    """Neighbouring symbols within each token of a text, with an empty symbol before the first."""
    before = ""
    for char in text:
        if char == " ":
            before = ""
        elif not unicodedata.combining(char):
            now = symbol(char)
            yield before, now
            before = now


def bigram_counts(texts: DataFrame, column: str) -> DataFrame:
    """before, now, n over all texts. Each worker adds up its batches, so a few thousand rows leave each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text, n in batch[column].value_counts().items():
                for pair in bigrams(unicodedata.normalize("NFD", "".join(c if c in classes()[0] else opened(c) for c in text))):
                    total[pair] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["before", "now", "n"])

    shipped(texts.sparkSession)
    return texts.select(column).where(F.col(column).isNotNull()).mapInPandas(run, "before string, now string, n bigint").groupBy("before", "now").agg(F.sum("n").alias("n"))


class Reader:
    """Viterbi readings of lattices under bigram scores."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = counts
        self.totals: Counter = Counter()
        for (before, _), n in counts.items():
            self.totals[before] += n
        self.symbols = len({b for _, b in counts}) + 1
        self.tokens: dict[str, str] = {}
        self.scores: dict[tuple[str, str], float] = {}

    def score(self, before: str, now: str) -> float:
        """Log probability with one added to every count, less the penalty where the script changes."""
        if (kept := self.scores.get((before, now))) is not None:
            return kept
        if len(self.scores) >= REMEMBERED:
            self.scores.clear()
        a, b = symbol(before) if before else "", symbol(now)
        value = math.log((self.counts.get((a, b), 0) + 1) / (self.totals[a] + self.symbols))
        s, t = script(before) if before else "", script(now)
        self.scores[before, now] = value = value - (SWITCH if s and t and s != t else 0.0)
        return value

    def token(self, token: str) -> str:
        """The best reading of one token; of equal ones the first in the order of the classes."""
        if (kept := self.tokens.get(token)) is not None:
            return kept
        _, members = classes()
        paths: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for char in token:
            if unicodedata.combining(char):
                paths = {last: (value, text + char) for last, (value, text) in paths.items()}
                continue
            step = {}
            for now in members.get(char, char):
                best = None
                for last, (value, text) in paths.items():
                    candidate = value + self.score(last, now)
                    if best is None or candidate > best[0]:
                        best = (candidate, text + now)
                step[now] = best
            paths = step
        best = None
        for value, text in paths.values():
            if best is None or value > best[0]:
                best = (value, text)
        result = best[1] if best else ""
        if len(self.tokens) >= REMEMBERED:
            self.tokens.clear()
        if len(token) <= 64:
            self.tokens[token] = result
        return result

    def read(self, text: str | None) -> str | None:
        """One form of a text; null stays null, the empty text stays empty."""
        if text is None:
            return None
        return unicodedata.normalize("NFC", " ".join(self.token(t) for t in lattice(text).split(" ")))


_READERS: dict[int, Reader] = {}


def one_form(df: DataFrame, columns: dict[str, str], counts: DataFrame) -> DataFrame:
    """``df`` with a new column of one form per text column; ``counts`` are the corpus's bigrams.

    Null stays null and empty stays empty; nothing is trimmed or shortened, blanks are replaced one by one. The model
    is at most the square of some 300 symbols, so it is sent to every worker.
    """
    shipped(df.sparkSession)
    model = {(r["before"], r["now"]): r["n"] for r in counts.collect()}
    sent = df.sparkSession.sparkContext.broadcast(model)

    def reader() -> Reader:
        counts = sent.value
        if (kept := _READERS.get(id(counts))) is None:
            _READERS.clear()
            kept = _READERS[id(counts)] = Reader(counts)  # holds the counts, so their id stays theirs
        return kept

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)  # null is -1
        forms = [reader().read(t) for t in distinct]
        return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)

    return df.withColumns({out: form(F.col(text)) for text, out in columns.items()})


def unlike(text: Column) -> Column:
    """Whether a text holds anything but printable ASCII; two texts without can look alike only if they are equal."""
    return text.rlike(r"[^ -~]")


def looking_alike(pairs: DataFrame, id_column: str, answer: str, reference: str, counts: DataFrame) -> DataFrame:
    """Distinct ids of the rows whose two texts are non-empty, differ in code points and look the same.

    Rows with a null or empty text are no case. Only rows that can be one are read by the search.
    """
    a, b = F.col(answer), F.col(reference)
    possible = pairs.where(F.col(id_column).isNotNull() & (a != "") & (b != "") & (a != b) & (unlike(a) | unlike(b)))
    read = one_form(possible, {answer: "__form_a", reference: "__form_b"}, counts)
    return read.where(F.col("__form_a") == F.col("__form_b")).select(id_column).distinct()

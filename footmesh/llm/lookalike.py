"""Visually identical text with different characters (problem 8).

Text is exploded to positioned code points, joined with the decomposition and look-alike mappings,
its combining marks are put in order of class and recomposed, and the strings are rebuilt. The
exploded form is columnar and lives within an Arrow batch: one array of code points with the
positions where each text starts; the mappings are broadcast as one dense array, so the join is a
gather. No code point ever crosses a shuffle; only hashes of the results do.

The normal form keeps what a reader can see: letter case, accents, punctuation, digits, line breaks and
the number of blanks. It does not keep: full-width and half-width forms, ligatures, whether an accent
is a character of its own, characters that show nothing where they stand, which kind of blank or font is used, and which of
several alphabets a letter of the same shape comes from. Joiners, variation selectors and tags are kept
where they show: within scripts that join, between the parts of an emoji, after what they vary.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footmesh.llm.pairs import crossed, paired
from footmesh.runtime import cut

# Letters of other scripts that have the shape of the Latin letter beneath them.
LOOKALIKES = (
    # Cyrillic
    ("аеорсухіѕјԁһԛԝѵүАВЕКМНОРСТУХІЈЅԌԚԜѴҮҺ", "aeopcyxisjdhqwvyABEKMHOPCTYXIJSGQWVYh"),
    # Greek
    ("αινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "aivopucjABEZHIKMNOPTYXCC"),
    # Armenian
    ("օոսհցզ", "onuhgq"),
    # phonetic
    ("ɑɡ", "ag"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᏙᏔᏃ", "ABCDEGHJKLMPSVWZ"),
)
# The Cyrillic and Armenian capitals that Unicode pairs with small look-alikes above have other shapes; Palochka is the letter I.
LOOKALIKES += (("Ӏӏ", "Il"),)

# Ranges of code points that show nothing (default ignorable), without the visible marks among the format characters.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
             (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))

# What is invisible by itself but shows in its place: joiners, variation selectors and tags, and the places.
JOINERS, SELECTORS, TAGS = (0x200C, 0x200D), ((0xFE00, 0xFE0F), (0x180B, 0x180D), (0xE0100, 0xE01EF)), (0xE0020, 0xE007F)
JOINING = ((0x600, 0x8FF), (0x900, 0xDFF), (0x1780, 0x18AF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE), (0x10D00, 0x10FFF), (0x11000, 0x11FFF))
PICTURES = ((0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2190, 0x2BFF), (0x3030, 0x303D), (0x3297, 0x3299), (0x1F000, 0x1FAFF))
IDEOGRAPHS = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
# Kinds of compatibility forms that show the same letters.
SAME_LETTERS = ("<wide>", "<narrow>", "<font>", "<noBreak>")

DROP = 0x110000
MULTI = 0x120000
SLICE = 2_000_000

Maps = tuple[np.ndarray, list[str], np.ndarray]


def _in(cp: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def shows(points: np.ndarray, at: int, begin: int, end: int) -> bool:
    """Whether the joiner, selector or tag at ``at`` shows, by what stands around it within its text."""
    cp = int(points[at])
    before = int(points[at - 1]) if at > begin else 0
    after = int(points[at + 1]) if at + 1 < end else 0
    if cp in JOINERS:
        if _in(before, JOINING) and _in(after, JOINING):
            return True
        return cp == 0x200D and (_in(before, PICTURES) or before == 0xFE0F) and _in(after, PICTURES)
    if TAGS[0] <= cp <= TAGS[1]:
        k = at
        while k > begin and TAGS[0] <= points[k] <= TAGS[1]:
            k -= 1
        return int(points[k]) == 0x1F3F4
    if cp in (0xFE0E, 0xFE0F):
        return _in(before, PICTURES) or after == 0x20E3
    return _in(before, JOINING if 0x180B <= cp <= 0x180D else IDEOGRAPHS)


def confusables(spark) -> dict[int, str]:
    """Letters of other alphabets with the shape of a Latin letter, by the Unicode confusables data that the engine's ICU library carries.

    Only letters that have case, and whose prototype is one Latin letter, count: so no two letters of one
    alphabet become equal. Without a JVM to ask there are none, and the fixed ones hold.
    """
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (AttributeError, TypeError):
        return {}
    every = [c for c in map(chr, range(0x370, 0x1E944)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.name(c, "LATIN").startswith(("LATIN", "MATHEMATICAL", "FULLWIDTH")) and not unicodedata.decomposition(c)]
    shown = checker.getSkeleton("\x01".join(every)).split("\x01")
    out = {}
    for c, to in zip(every, shown):
        if len(to) == 1 and to.isascii() and to.isalpha():
            # the prototype of capital I and small l is the same
            out[ord(c)] = "I" if to == "l" and c.isupper() else to
    return out


def build_maps(others: dict[int, str] | None = None) -> Maps:
    """(target by code point, strings of the targets that are longer, whether a code point may join the one before it)."""
    alike = dict(others or {}) | {ord(a): b for xs, ys in LOOKALIKES for a, b in zip(xs, ys)}
    table = np.arange(0x110000, dtype=np.int32)
    joins = np.zeros(0x110000, bool)
    longer: list[str] = []

    def spread(c: str) -> str:
        """Decomposition by the rules kept here: canonical, width, font, ligature, roman numeral."""
        kind = unicodedata.decomposition(c)
        tag, _, rest = kind.partition(" ") if kind.startswith("<") else ("", "", kind)
        letters = tag in SAME_LETTERS or (tag == "<compat>" and any(w in unicodedata.name(c, "") for w in ("LIGATURE", "ROMAN NUMERAL")))
        if not kind or (tag and not letters):
            return alike.get(ord(c), c)
        return "".join(spread(chr(int(x, 16))) for x in rest.split())

    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        kind = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            joins[cp] = True
        if kind and not kind.startswith("<") and " " in kind:
            joins[int(kind.split()[-1], 16)] = True
        if unicodedata.category(c) == "Zs":
            table[cp] = 0x20
        elif kind or cp in alike:
            to = unicodedata.normalize("NFC", spread(c))
            if len(to) == 1:
                table[cp] = ord(to)
            else:
                table[cp] = MULTI + len(longer)
                longer.append(to)
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True
    for a, b in INVISIBLE:
        table[a : b + 1] = DROP
    return table, longer, joins


@lru_cache(maxsize=1)
def mapping() -> Maps:
    """The maps of the fixed look-alikes alone."""
    return build_maps()


_sent: dict = {}


def shared_maps(spark):
    """The maps, made once on the driver and broadcast: two arrays over all code points, 5.5 MB whatever the data."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        _sent.clear()
        _sent[sc.applicationId] = sc.broadcast(build_maps(confusables(spark)))
    return _sent[sc.applicationId]


_context = np.zeros(0x110000, bool)
_context[list(JOINERS)] = True
for _a, _b in (*SELECTORS, TAGS):
    _context[_a : _b + 1] = True


def normal_texts(texts: list[str], maps: Maps | None = None) -> list[str]:
    """The normal form of each text, in order."""
    table, longer, joins = maps or mapping()
    out = list(texts)
    todo = [i for i, t in enumerate(texts) if not t.isascii()]
    while todo:
        part, size = [], 0
        while todo and (not part or size + len(texts[todo[-1]]) <= SLICE):
            part.append(todo.pop())
            size += len(texts[part[-1]])
        points = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        ends = np.cumsum([len(texts[i]) for i in part])
        got = table[points]
        for at in np.flatnonzero(_context[points]).tolist():
            k = int(np.searchsorted(ends, at, side="right"))
            if shows(points, at, int(ends[k - 1]) if k else 0, int(ends[k])):
                got[at] = points[at]
        counts = np.ones(len(got), np.int64)
        counts[got == DROP] = 0
        many = np.flatnonzero(got >= MULTI)
        if len(many):
            counts[many] = [len(longer[k - MULTI]) for k in got[many]]
        starts = np.r_[0, np.cumsum(counts)]
        flat = np.repeat(got, counts)
        for k in many:
            s = longer[got[k] - MULTI]
            flat[starts[k] : starts[k] + len(s)] = [ord(x) for x in s]
        marks = np.r_[0, np.cumsum(joins[flat])]
        begin = 0
        for i, end in zip(part, starts[ends]):
            text = flat[begin:end].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            # order of marks by class and recomposition; without marks nothing is left to compose
            out[i] = unicodedata.normalize("NFC", text) if marks[end] > marks[begin] else text
            begin = end
    return out


def _normal(texts: pd.Series) -> pd.Series:
    got = texts.copy()
    there = texts.notna()
    got[there] = normal_texts(texts[there].tolist())
    return got


def normal_form(text: Column) -> Column:
    """The text's normal form; null stays null, empty text stays empty."""
    return F.pandas_udf(_normal, T.StringType())(text)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, raw, form: digests (128 bits) of the text and of its normal form. Rows with a null key or text are left out."""
    shared = shared_maps(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["t"].tolist()
            forms = normal_texts(texts, shared.value)
            raw = [digest(t) for t in texts]
            yield pd.DataFrame({"id": frame["id"], "raw": raw, "form": [r if f is t or f == t else digest(f) for r, f, t in zip(raw, forms, texts)]})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, raw binary, form binary")


def lookalike_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: id, class_id (the smallest id of its class), n_variants, n_docs of its class."""
    rows = cut(form_digests(docs, key, text))
    sizes = rows.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sizes = sizes.groupBy("form").agg(F.min("first").alias("class_id"), F.count("*").alias("n_variants"), F.sum("n").alias("n_docs"))
    return rows.join(sizes, "form").select("id", "class_id", "n_variants", "n_docs")


def lookalike_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_a, doc_b: documents that look the same but are not equal character by character, the smaller first.

    Pairs are formed between the different texts of a class first, and only those are expanded to
    documents, both in blocks, so that neither a class with many texts nor a text with many copies makes one
    task's work; a text that a third of all documents share but that has no variant is left out before any
    pair is formed. Null texts match nothing; a repeated row with the same key counts once.
    """
    rows = cut(form_digests(docs, key, text).distinct())
    texts = rows.select("form", "raw").distinct()
    pairs = paired(texts, ["form"], "raw").select("form", F.col("x").alias("raw_a"), F.col("y").alias("raw_b"))
    a = rows.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("doc_x"))
    b = rows.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("doc_y"))
    # each pair of texts is a key of its own: its first text's documents, then the second's
    out = crossed(pairs.join(a, ["form", "raw_a"]).select("raw_a", "raw_b", "doc_x"), pairs.join(b, ["form", "raw_b"]).select("raw_a", "raw_b", "doc_y"), ["raw_a", "raw_b"]).where("doc_x <> doc_y")
    return out.select(F.least("doc_x", "doc_y").alias("doc_a"), F.greatest("doc_x", "doc_y").alias("doc_b")).distinct()
